"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept, and its decisions take effect: toxic documents go, one document of each group of near copies stays,
repeated windows of words leave the texts, documents that leak a benchmark item go, and what is left is encoded.

Defined results: stages decide by row (doc_id and text), so rows that share a doc_id, or have none, are judged each by its own text; null texts count as empty, and
empty texts stay; of near copies, and of rows repeated in full, one stays; extra columns, whatever their names, pass through all stages but the last; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op1_decontamination, op3_minmax, op4_toxicity, op7_bpe, op9_substring
from quire.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the models learn from labelled rows among them."""
    return op4_toxicity.keep_ordinary(docs, *op4_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that of the least doc_id, null ids last; of rows that agree in doc_id and
    text one. Texts without words are no copies of anything and all stay."""
    rows = op9_substring.identified(docs)
    links = written(op3_minmax.link_documents(rows.select(F.col("key").alias("doc_id"), "text"), k=5).filter("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct(), "row-links")
    members = rows.select("doc_id", "id", "key").join(links, "key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "id", "key")
    groups = written(members.groupBy("component_id").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("component_id", "one.id", "one.key"), "row-groups")
    stays = groups.select("id", "key")
    grouped = written(links.join(groups.select("component_id"), "component_id", "left_semi").select(F.col("key").alias("__key")), "row-members")
    named = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__key", op9_substring.row_key())
    first = named.join(stays.select(F.col("id").alias("__id"), F.col("key").alias("__key")), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return named.join(grouped, "__key", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that start at two places or more; n_chars follows the text."""
    return op9_substring.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; another row of the same doc_id, or of none, is judged by its own text."""
    keyed = docs.select(op9_substring.row_key().alias("doc_id"), "text")
    leaks = op1_decontamination.find_leaks(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", op9_substring.row_key()).join(leaks, "__key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, and the hashes of the ids and of the decoded text."""
    return op7_bpe.encode_documents(docs, op7_bpe.tokenizer_source(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, hash and tokenise; SQL expresses none of them. Tested against a brute-force version instead.
ORACLE_SQL = None
