"""Finding text: literal and typography-tolerant matches, regular expressions, snippets, replacement."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import PLAIN, TYPOGRAPHIC, literal_hits

_FOLD = str.maketrans(TYPOGRAPHIC, PLAIN)


def find_all(text: str, needle: str, case_sensitive: bool = True) -> list[tuple[int, int, bool]]:
    """(start, end, fuzzy) of the exact matches; only if there is none, of those after folding typography and runs of spaces. Offsets are code points."""
    if not needle:
        return []
    if not case_sensitive:
        low = text.lower()
        text, needle = low if len(low) == len(text) else "".join(c.lower()[:1] for c in text), needle.lower()
    found, at = [], text.find(needle)
    while at >= 0:
        found.append((at, at + len(needle), False))
        at = text.find(needle, at + len(needle))
    if found:
        return found
    flat, place = [], []
    for i, c in enumerate(text.translate(_FOLD)):
        c = " " if c in "\n\r" else c
        if c == " " and flat and flat[-1] == " ":
            continue
        flat.append(c)
        place.append(i)
    folded = "".join(flat)
    want = " ".join(x for x in needle.translate(_FOLD).replace("\n", " ").replace("\r", " ").split(" ") if x)
    if not want:
        return []
    at = folded.find(want)
    while at >= 0:
        found.append((place[at], place[at + len(want) - 1] + 1, True))
        at = folded.find(want, at + len(want))
    return found


def hit_counts(docs: DataFrame, needle: str) -> DataFrame:
    """Documents with the needle and how often, case aside."""
    return docs.select("doc_id", literal_hits(F.col("text"), needle).alias("hits")).filter("hits > 0")


def fuzzy_matches(docs: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """One row a match: id, start, end (code points), fuzzy."""

    def run(batches):
        for b in batches:
            out = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in find_all(t or "", needle, case_sensitive)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "start", "end", "fuzzy"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, end long, fuzzy boolean")


def snippets(docs: DataFrame, needle: str, most: int = 30, around: int = 60, cap: int = 200) -> DataFrame:
    """The first ``most`` matches of each document (at most ``cap``), case aside, with their surroundings, line breaks shown as marks, and the number of all matches."""
    import re

    n = len(needle)
    parts = F.split(F.lower("text"), re.escape(needle.lower()), -1)
    begin = lambda i: (F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * n).cast("int")
    d = docs.select("doc_id", "text", parts.alias("parts")).filter(F.size("parts") > 1)
    each = d.select("doc_id", "text", (F.size("parts") - 1).alias("total"), F.posexplode(F.transform(F.slice("parts", F.lit(1), F.least(F.size("parts") - 1, F.lit(min(most, cap)))), lambda _, i: begin(i))).alias("hit", "at"))
    before = F.greatest(F.col("at") - around, F.lit(0))
    cut = F.concat(
        F.when(before > 0, F.lit("…")).otherwise(F.lit("")), F.substring("text", before + 1, F.col("at") - before), F.lit("【"), F.substring("text", F.col("at") + 1, F.lit(n)), F.lit("】"),
        F.substring("text", F.col("at") + n + 1, F.lit(around)), F.when(F.length("text") > F.col("at") + n + around, F.lit("…")).otherwise(F.lit("")),
    )
    return each.select("doc_id", (F.col("hit") + 1).alias("hit"), F.col("at").cast("long").alias("index"), F.replace(cut, F.lit("\n"), F.lit("⏎")).alias("snippet"), "total")


def replace_status(docs: DataFrame, old: str, new: str, every: bool = False) -> DataFrame:
    """What replacing would do to each document: invalid, not_found, ambiguous or ok, and the number of places."""
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(old), F.lit("")))) / max(len(old), 1)
    hits = F.lit(0).cast("long") if not old else n.cast("long")
    status = F.when(F.lit(not old or old == new), "invalid").when(hits == 0, "not_found").when((hits > 1) & F.lit(not every), "ambiguous").otherwise("ok")
    return docs.select("doc_id", hits.alias("places"), status.alias("status"))


def replaced_tolerant(docs: DataFrame, old: str, new: str, every: bool = False) -> DataFrame:
    """Status, places and the new text of each document (doc_id, text), by exact matches or, where there is none, by typography-tolerant ones; replaced from the right."""

    def one(text: str) -> tuple[str, int, str]:
        if not old or old == new:
            return "invalid", 0, text
        found = find_all(text, old)
        if not found or len(found) > 1 and not every:
            return ("ambiguous" if found else "not_found"), len(found), text
        for a, z, _ in reversed(found):
            text = text[:a] + new + text[z:]
        return "ok", len(found), text

    def run(batches):
        for b in batches:
            out = [one(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))], names=["doc_id", "status", "places", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, status string, places long, text string")


def replaced(docs: DataFrame, old: str, new: str, version: int = 1) -> DataFrame:
    """The new version of every document that has the text; the others keep their version and make no row."""
    return docs.filter(F.contains("text", F.lit(old))).select("doc_id", F.lit(version).alias("version"), F.replace(F.col("text"), F.lit(old), F.lit(new)).alias("text"))
