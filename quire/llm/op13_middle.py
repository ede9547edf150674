"""Fill-in-middle: texts rearranged so that a model learns to fill a gap.

A text is cut into units (runs of A-Z and a-z, or one other code point) by a lazy matcher that runs twice: the first pass counts the units, the second is an iterator
that is advanced to the ranks of both cuts and then dropped. No list of units or places is ever made: besides the text and its output, a row needs constant memory.
The ranks and the form come from the sha256 of the id, so that a row is transformed alike wherever and whenever it is met.

Defined results: a null text counts as empty; an empty text, one that contains a mark, and the plain share stay as they are (form ``plain``, null lengths); a null
doc_id is hashed as the empty string; repeated rows give repeated results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, those that stay plain and, of the others, those with the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of outputs from which a batch is handed on.
BYTES = 1 << 22


def n_units(text: str) -> int:
    """First pass: the number of units."""
    counter = count()
    deque(zip(UNIT.finditer(text), counter), maxlen=0)
    return next(counter)


def places(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first ``low`` and the first ``high`` units end."""
    units, a = UNIT.finditer(text), 0
    if low:
        a = next(islice(units, low - 1, None)).end()
    return a, next(islice(units, high - low - 1, None)).end() if high > low else a


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """The first four unsigned 32-bit numbers of the id's hash."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transformed(doc_id: int | None, text: str, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the output."""
    n = n_units(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= plain_from or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, z = places(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < suffix_first:
        return n, "spm", a, z - a, f"{SUFFIX}{text[z:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:z]}"
    return n, "psm", a, z - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[z:]}{MIDDLE}{text[a:z]}"


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form. A transformed text contains no mark, and no mark can arise across the border of a part and a mark, so the first ones found are
    the ones that were set."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    b = F.locate(SUFFIX, output, 4)
    b = F.when(form == "psm", b).otherwise(F.locate(PREFIX, output, 4))
    m = F.locate(MIDDLE, output, 4)
    n = F.length(second)
    first, other, middle = F.substring(output, F.lit(4), b - 4), F.substring(output, b + n, m - b - n), F.substring(output, m + 3, F.length(output))
    return F.when(form == "psm", F.concat(first, middle, other)).when(form == "spm", F.concat(other, middle, first)).otherwise(output)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row. A map: nothing is shuffled, texts are met one at a time and handed on in batches of some
    megabytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            held, size = [], 0
            for i, t in zip(b.column(0), b.column(1), strict=True):
                i = i.as_py()
                row = i, *transformed(i, t.as_py(), plain_from, suffix_first)
                held.append(row)
                size += len(row[-1])
                if size >= BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def op13_middle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed and restored: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS z,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:z], '') AS mid, array_to_string(u[z + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
