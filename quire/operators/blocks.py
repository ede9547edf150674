"""Documents as ordered, addressable blocks, and what is read from them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clipped

_LINE = re.compile(r"\r?\n")
_FENCE = re.compile(r"\s*(```|~~~)")
_HEADING = re.compile(r"(#{1,6})\s")
_LIST = re.compile(r"\s*([-*+]|\d+[.)])\s")
_CELL = re.compile(r"\s*\|")
BLOCK_SCHEMA = "ordinal int, kind string, level int, text string"


def markdown_blocks(text: str) -> list[tuple[int, str, int | None, str]]:
    """The blocks of one Markdown text: (ordinal, kind, heading level, source text). An open fence runs to the end and only its own kind closes it."""
    if not text:
        return []
    lines, out = _LINE.split(text), []

    def put(kind: str, first: int, last: int, level: int | None = None) -> int:
        out.append((len(out) + 1, kind, level, "\n".join(lines[first : last + 1])))
        return last + 1

    i, n = 0, len(lines)
    if lines[0] == "---" and "---" in lines[1:]:
        i = put("other", 0, lines.index("---", 1))
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif f := _FENCE.match(line):
            close = next((j for j in range(i + 1, n) if lines[j].strip().startswith(f[1])), n - 1)
            i = put("code", i, close)
        elif h := _HEADING.match(line):
            i = put("heading", i, i, len(h[1]))
        elif _LIST.match(line):
            i = put("list", i, i)
        elif _CELL.match(line):
            i = put("table-cell", i, i)
        else:
            last = i
            while last + 1 < n and lines[last + 1].strip() and not any(r.match(lines[last + 1]) for r in (_HEADING, _LIST, _CELL, _FENCE)):
                last += 1
            i = put("quote" if line.lstrip().startswith(">") else "paragraph", i, last)
    return out


def with_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: int = 0) -> DataFrame:
    """One row a block: id, ordinal, ref, kind, level, text. Fences make the grammar sequential, so each document is folded where it is read; no shuffle."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blocks = markdown_blocks(t)
                ids += [i] * len(blocks)
                found += blocks
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True))], names=[id_col, "ordinal", "kind", "level", "text"])

    out = rows.mapInArrow(run, f"`{id_col}` {kind}, {BLOCK_SCHEMA}")
    return out.select(id_col, "ordinal", F.concat(F.lit("B"), F.col("ordinal"), F.lit(f"@v{version}")).alias("ref"), "kind", "level", "text")


_SPACES = re.compile("[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
COUNTS = "block_count char_count headings list_items tables quotes code_blocks".split()


def summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each document's blocks; ``tables`` says whether there is one. A text is counted where it is read; rows of one id are added up."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def one(text: str) -> list[int]:
        found = markdown_blocks(text)
        n = lambda k: sum(b[1] == k for b in found)
        return [len(found), sum(len(_SPACES.sub("", b[3])) for b in found), n("heading"), n("list"), int(n("table-cell") > 0), n("quote"), n("code")]

    def run(batches):
        for b in batches:
            out = [one(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in range(len(COUNTS)))], names=[id_col, *COUNTS])

    each = rows.mapInArrow(run, f"`{id_col}` long, " + ", ".join(f"{c} long" for c in COUNTS)).filter("block_count > 0")
    return each.groupBy(id_col).agg(*((F.max if c == "tables" else F.sum)(c).alias(c) for c in COUNTS))


def rendered(ref: Column, location: Column, text: Column, most: int = 1500) -> Column:
    """One line that shows a block."""
    return F.concat(F.lit("["), ref, F.lit("] ("), location, F.lit(") "), F.when(text == "", F.lit("（空段落）")).otherwise(clipped(text, most)))


def read_page(blocks: DataFrame, offset: int = 0, limit: int = 40, most: int = 200, id_col: str = "doc_id") -> DataFrame:
    """``limit`` blocks of each document from the block after ``offset``, at most ``most``, shown as lines."""
    page = blocks.filter((F.col("ordinal") > offset) & (F.col("ordinal") <= offset + min(limit, most)))
    return page.select(id_col, "ordinal", rendered(F.col("ref"), F.col("kind"), F.col("text")).alias("line"))


def read_part(blocks: DataFrame, part: str, start: int = 1, limit: int = 40, most: int = 200, prefix: bool = False) -> DataFrame:
    """Blocks (doc_id, ordinal, ref, location, text) of one part: whose location contains it, or begins with it where ``prefix``; ``limit`` of them from the ``start``-th, with what is left:
    position, number of all, and the offset to read on from (NULL at the end)."""
    pool = blocks.filter(F.col("location").startswith(part) if prefix else F.contains("location", F.lit(part)))
    w = Window.partitionBy("doc_id")
    n = pool.withColumn("pos", F.row_number().over(w.orderBy("ordinal"))).withColumn("total", F.count(F.lit(1)).over(w))
    last = start + min(limit, most) - 1
    page = n.filter(F.col("pos").between(start, last))
    return page.select("doc_id", "pos", rendered(F.col("ref"), F.col("location"), F.col("text")).alias("line"), "total", F.when(F.col("total") > last, F.lit(last + 1)).alias("read_on"))


def detailed(blocks: DataFrame, full: bool = False) -> DataFrame:
    """Blocks (ref, location, style, level, flags, text) as lines: [ref] (location · style · level · flags) text."""
    about = F.concat_ws(" · ", "location", "style", F.when(F.col("level") > 0, F.concat(F.lit("标题"), "level")), F.array_join("flags", "、"))
    text = F.when(F.col("text") == "", F.lit("（空段落）")).otherwise(F.replace("text", F.lit("\n"), F.lit("⏎")) if full else clipped(F.col("text"), 1500))
    return blocks.select("doc_id", "ordinal", F.concat(F.lit("["), "ref", F.lit("] ("), about, F.lit(") "), text).alias("line"))


def outline(headings: DataFrame) -> DataFrame:
    """Headings indented by level, with their link targets."""
    from quire.functions.text import slug

    indent = F.repeat(F.lit(" "), F.greatest(2 * (F.col("level") - 1), F.lit(0)))
    text = F.regexp_replace("text", "⟨分栏符⟩|⟨分页符⟩", "")
    return headings.select("doc_id", "ordinal", F.concat(indent, text).alias("line"), slug(text).alias("slug"))


def moved(blocks: DataFrame) -> DataFrame:
    """Blocks marked ``moved`` stand after the one marked ``anchor``, in their own order; ordinals are given anew."""
    w = Window.partitionBy("doc_id")
    anchor = F.max(F.when(F.col("anchor"), F.col("ordinal"))).over(w)
    place = F.when(F.col("moved"), anchor).otherwise(F.col("ordinal"))
    keyed = blocks.select("doc_id", "ordinal", "text", place.alias("place"), F.col("moved").cast("int").alias("late"))
    return keyed.select("doc_id", F.col("ordinal").alias("was"), F.row_number().over(w.orderBy("place", "late", "ordinal")).alias("ordinal"), "text")


def inserted(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks with new ones after the ordinals that they name (0: at the start), numbered anew."""
    both = blocks.select("doc_id", F.col("ordinal").alias("at"), F.lit(0).alias("pos"), "text").unionByName(new.select("doc_id", F.col("after").alias("at"), "pos", "text"))
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "pos")).alias("ordinal"), "text")


def deleted(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """Blocks without those named, numbered anew; a document's only block is protected and stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    marked = blocks.withColumn("n", n).join(gone.withColumn("gone", F.lit(True)), ["doc_id", "ordinal"], "left")
    kept = marked.filter(F.col("gone").isNull() | (F.col("n") == 1))
    status = F.when(F.col("gone").isNotNull(), "protected").otherwise("ok")
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")).alias("ordinal"), "text", status.alias("status"))


def table_of_contents(headings: DataFrame, deepest: int = 3) -> DataFrame:
    """Each document's contents as a list of links, indented by level, down to ``deepest``."""
    from quire.functions.text import slug

    h = headings.filter(F.col("level").between(1, deepest) & (F.trim("text") != ""))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), F.trim("text"), F.lit("](#"), slug(F.col("text")), F.lit(")"))
    each = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return h.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("toc"))
