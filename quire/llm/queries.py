"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.op1_decontamination import op1_template_decontamination
from quire.llm.op2_html import op2_html_density
from quire.llm.op3_minmax import op3_minmax_dedup
from quire.llm.op4_toxicity import op4_toxicity_kneser_ney
from quire.llm import op3_minmax, op6_topk, op9_substring, op12_variants, op13_middle
from quire.llm.op5_attention import op5_attention_scores
from quire.llm.op6_topk import op6_impact_topk
from quire.llm.op7_bpe import op7_bpe_tree
from quire.llm.op8_quality import op8_quality_bytenet
from quire.llm.op9_substring import op9_substring_dedup
from quire.llm.op10_wordpiece import op10_token_counts
from quire.llm.op11_token_files import op11_token_files
from quire.llm.op12_variants import op12_spelling_variants
from quire.llm.op13_middle import op13_middle_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_html_density": op2_html_density,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op4_toxicity_kneser_ney": op4_toxicity_kneser_ney,
    "op5_attention_scores": op5_attention_scores,
    "op6_impact_topk": op6_impact_topk,
    "op7_bpe_tree": op7_bpe_tree,
    "op8_quality_bytenet": op8_quality_bytenet,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_token_files": op11_token_files,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_middle_stream": op13_middle_stream,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minmax_dedup": op3_minmax.ORACLE,
    "op6_impact_topk": op6_topk.ORACLE,
    "op9_substring_dedup": op9_substring.ORACLE,
    "op12_spelling_variants": op12_variants.ORACLE,
    "op13_middle_stream": op13_middle.ORACLE,
}
