"""Edits as transformations: formatting, levels, comments, table rows and columns, guards, versions. Every edit carries a status instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a placeholder of an object that text edits must not touch.
ATOM = "⟨[^⟩]*⟩"


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences from the left; none of an empty needle."""
    return F.when(needle == "", F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"))


def formatted(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks (doc_id, ordinal, text) with marks around a target or the whole block (edits: target or NULL, bold, italic, strike): status and new text, in that nesting."""
    e = blocks.join(edits, ["doc_id", "ordinal"])
    open_ = F.concat(*(F.when(F.col(c), m).otherwise("") for c, m in (("bold", "**"), ("italic", "*"), ("strike", "~~"))))
    close = F.concat(*(F.when(F.col(c), m).otherwise("") for c, m in (("strike", "~~"), ("italic", "*"), ("bold", "**"))))
    n = F.when(F.col("target").isNull(), 1).otherwise(occurrences(F.col("text"), F.col("target")))
    status = F.when(n == 0, "not_found").when(n > 1, "ambiguous").when(open_ == "", "unsupported").otherwise("ok")
    new = F.when(F.col("target").isNull(), F.concat(open_, "text", close)).otherwise(F.replace("text", F.col("target"), F.concat(open_, "target", close)))
    return e.select("doc_id", "ordinal", status.alias("status"), F.when(status == "ok", new).otherwise(F.col("text")).alias("text"))


def _level(style: Column) -> Column:
    """The heading level that a style name means, NULL for none."""
    named = F.coalesce(F.nullif(F.regexp_extract(style, r"^(?i:heading|标题)\s*(\d)$", 1), F.lit("")), F.nullif(F.regexp_extract(style, r"^[hH](\d)$", 1), F.lit("")))
    return named.cast("int")


def relevelled(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks made headings or body text by a style name (edits: style): status and new text."""
    e = blocks.join(edits, ["doc_id", "ordinal"])
    body, level = F.regexp_replace("text", r"^#{1,6}\s+", ""), _level(F.col("style"))
    plain = F.col("style").rlike("^(?i:normal|正文|paragraph|p)$")
    status = F.when(level.isNotNull() | plain, "ok").otherwise("unsupported")
    return e.select("doc_id", "ordinal", status.alias("status"), F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body)).when(plain, body).otherwise(F.col("text")).alias("text"))


def styled(text: Column, style: Column) -> Column:
    """New text as a block of a style: a heading, a list item or a paragraph."""
    level = F.regexp_extract(style, r"(\d)$", 1)
    heading = style.rlike(r"(?i)heading|标题|^h\d") & (level != "")
    return F.when(heading, F.concat(F.repeat(F.lit("#"), F.nullif(level, F.lit("")).cast("int")), F.lit(" "), text)).when(style.rlike("(?i)list|列表"), F.concat(F.lit("- "), text)).otherwise(text)


def commented(blocks: DataFrame, comments: DataFrame) -> DataFrame:
    """Blocks with a hidden note before them (comments: author, comment), numbered anew; double hyphens in a note become a dash."""
    note = F.concat(F.lit("<!-- 批注（"), "author", F.lit("）："), F.replace("comment", F.lit("--"), F.lit("—")), F.lit(" -->"))
    notes = comments.join(blocks.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_semi").select("doc_id", F.col("ordinal").alias("at"), F.lit(0).alias("pos"), note.alias("text"))
    both = blocks.select("doc_id", F.col("ordinal").alias("at"), F.lit(1).alias("pos"), "text").unionByName(notes)
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "pos", "text")).alias("ordinal"), "text")


def listed_comments(blocks: DataFrame) -> DataFrame:
    """Author and text of the notes in each block."""
    whole = r"<!-- 批注（([^）]*)）：(.*?) -->"
    each = blocks.select("doc_id", "ordinal", F.explode(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("note"))
    return each.select("doc_id", "ordinal", F.regexp_extract("note", whole, 1).alias("author"), F.regexp_extract("note", whole, 2).alias("comment"))


def without_comments(blocks: DataFrame, author: str | None = None) -> DataFrame:
    """Blocks without notes, or without those of one author; a block that held nothing else goes."""
    import re

    who = "[^）]*" if author is None else re.escape(author)
    out = blocks.withColumn("text", F.regexp_replace("text", rf"<!-- 批注（{who}）：.*? -->\n?", "")).filter("text <> ''")
    return out.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")).cast("int").alias("ordinal"), "text")


def with_rows(tables: DataFrame, edits: DataFrame) -> DataFrame:
    """Tables as rows (doc_id, tab, r, cells) with new ones before or after row r (edits: r, after, cells); one of another width is invalid and left out."""
    e = edits.select("doc_id", "tab", "r", "after", F.col("cells").alias("new")).join(tables, ["doc_id", "tab", "r"])
    ok = e.filter(F.size("new") == F.size("cells")).select("doc_id", "tab", "r", F.when(F.col("after"), 1).otherwise(-1).alias("pos"), F.col("new").alias("cells"))
    both = tables.select("doc_id", "tab", "r", F.lit(0).alias("pos"), "cells").unionByName(ok)
    return both.select("doc_id", "tab", F.row_number().over(Window.partitionBy("doc_id", "tab").orderBy("r", "pos")).cast("int").alias("r"), "cells")


def row_status(tables: DataFrame, edits: DataFrame) -> DataFrame:
    """What inserting a row would do: ok, invalid (another number of cells) or not_found."""
    e = edits.select("doc_id", "tab", "r", F.size("cells").alias("given")).join(tables.select("doc_id", "tab", "r", F.size("cells").alias("want")), ["doc_id", "tab", "r"], "left")
    return e.select("doc_id", "tab", "r", F.when(F.col("want").isNull(), "not_found").when(F.col("want") != F.col("given"), "invalid").otherwise("ok").alias("status"))


def without_row(tables: DataFrame, gone: DataFrame) -> DataFrame:
    """Tables without some rows (doc_id, tab, r); a table's only row stays, as invalid."""
    w = Window.partitionBy("doc_id", "tab")
    t = tables.withColumn("n", F.count(F.lit(1)).over(w)).join(gone.withColumn("gone", F.lit(True)), ["doc_id", "tab", "r"], "left")
    kept = t.filter("gone IS NULL OR n = 1")
    return kept.select("doc_id", "tab", F.row_number().over(w.orderBy("r")).cast("int").alias("r"), "cells", F.when(F.col("gone"), "invalid").otherwise("ok").alias("status"))


def without_column(tables: DataFrame, c: Column) -> DataFrame:
    """Tables without column ``c`` (from 1); a table's only column stays."""
    cut = F.concat(F.slice("cells", 1, c - 1), F.slice("cells", c + 1, F.size("cells")))
    return tables.select("doc_id", "tab", "r", F.when((F.size("cells") > 1) & (c <= F.size("cells")), cut).otherwise(F.col("cells")).alias("cells"))


def with_column(tables: DataFrame, c: Column, values: DataFrame) -> DataFrame:
    """Tables with a column after column ``c`` (0: first) whose texts ``values`` gives by row; '' where it has none."""
    t = tables.join(values.select("doc_id", "tab", "r", "value"), ["doc_id", "tab", "r"], "left")
    return t.select("doc_id", "tab", "r", F.concat(F.slice("cells", F.lit(1), c), F.array(F.coalesce("value", F.lit(""))), F.slice("cells", c + 1, F.size("cells"))).alias("cells"))


def merged_cells(tables: DataFrame, areas: DataFrame) -> DataFrame:
    """Tables with rectangles (doc_id, tab, r1, c1, r2, c2) merged: their texts go to the upper left cell, joined by line feeds; the others are empty."""
    t = tables.join(areas, ["doc_id", "tab"], "left")
    inside = F.coalesce(F.col("r").between(F.col("r1"), F.col("r2")), F.lit(False))
    part = F.filter(F.slice("cells", F.coalesce("c1", F.lit(1)), F.coalesce(F.col("c2") - F.col("c1") + 1, F.lit(0))), lambda x: x != "")
    own = t.withColumn("inside", inside).withColumn("part", F.when(inside, part).otherwise(F.array().cast("array<string>")))
    all_ = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "part")).over(Window.partitionBy("doc_id", "tab"))), lambda x: x["part"]))
    cells = F.transform("cells", lambda x, i: F.when(F.col("inside") & (i + 1 >= F.col("c1")) & (i + 1 <= F.col("c2")), F.when((F.col("r") == F.col("r1")) & (i + 1 == F.col("c1")), F.col("whole")).otherwise(F.lit(""))).otherwise(x))
    return own.withColumn("whole", F.array_join(all_, "\n")).select("doc_id", "tab", "r", cells.alias("cells"))


def atom_guard(edits: DataFrame) -> DataFrame:
    """Whether an edit (id, text, start, end: code points) touches a placeholder: protected, else ok."""
    parts, atoms = F.split("text", ATOM, -1), F.regexp_extract_all("text", F.lit(ATOM), F.lit(0))
    begin = lambda i: F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("atoms", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    e = edits.select("id", "start", "end", parts.alias("parts"), atoms.alias("atoms"))
    hit = F.exists(F.transform("atoms", lambda x, i: (F.col("start") < begin(i) + F.length(x)) & (F.col("end") > begin(i))), lambda x: x)
    return e.select("id", F.when(hit, "protected").otherwise("ok").alias("status"))


def delete_guard(paras: DataFrame) -> DataFrame:
    """Whether each paragraph (doc_id, ordinal, cell or NULL, section_break, deleted: inside a tracked deletion) may be deleted: a section break and a cell's only paragraph may not,
    nor what a tracked deletion holds."""
    alone = F.col("cell").isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy("doc_id", "cell")) == 1)
    return paras.select("doc_id", "ordinal", F.when(F.col("deleted") | F.col("section_break") | alone, "protected").otherwise("ok").alias("status"))


def guarded(pairs: DataFrame) -> DataFrame:
    """Edits (doc_id, old, new) that must keep every placeholder: the new text where it does, else the old one, reverted."""
    atoms = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(ATOM), F.lit(0)))
    ok = atoms("old") == atoms("new")
    return pairs.select("doc_id", F.when(ok, "ok").otherwise("reverted").alias("status"), F.when(ok, F.col("new")).otherwise(F.col("old")).alias("text"))


def rolled_back(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """An append-only log (session, v, label, text) with one more version for each session that is to return to an earlier one (session, to); nothing is lost."""
    last = log.groupBy("session").agg(F.max("v").alias("last"))
    old = wanted.select("session", F.col("to").alias("v")).join(log.select("session", "v", "text"), ["session", "v"]).select("session", F.col("v").alias("to"), "text")
    new = old.join(last, "session").select("session", (F.col("last") + 1).cast("int").alias("v"), F.concat(F.lit("回滚到 v"), "to").alias("label"), "text")
    return log.select("session", "v", "label", "text").unionByName(new)


def capped_pages(pages: DataFrame, most: int = 500) -> DataFrame:
    """The first ``most`` pages (doc_id, page) of each document, and whether it has more."""
    w = Window.partitionBy("doc_id")
    n = F.row_number().over(w.orderBy("page"))
    return pages.select("doc_id", "page", n.alias("n"), (F.count(F.lit(1)).over(w) > most).alias("truncated")).filter(F.col("n") <= most).drop("n")


def exports(wanted: DataFrame) -> DataFrame:
    """What exporting (id, source, target format) does: the same format is the document itself, without loss; another needs an external converter and may lose."""
    known = [F.col(c).isin("docx", "pdf", "html", "markdown") for c in ("source", "target")]
    same = F.col("source") == F.col("target")
    return wanted.select("id", F.when(~(known[0] & known[1]), "invalid").when(same, "identity").otherwise("unsupported").alias("status"), (~same).alias("lossy"))
