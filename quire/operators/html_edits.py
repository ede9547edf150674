"""Edits of HTML pages on their source: only the bytes of what changes are touched, whatever mark-up, references or errors stand around them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.compare import hunks
from quire.operators.search import find_all
from quire.sources.html import page_blocks
from quire.sources.tree import Element, decoded

Splice = tuple[int, int, str]


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class BlockText:
    """A block's text and, of every character, where it stands in the source."""

    def __init__(self, src: str, element: Element, pieces: list[tuple[int, int, bool]]):
        self.element, texts, self.spans, at = element, [], [], 0
        for p in pieces:
            text, places = decoded(src, *p)
            texts.append(text)
            self.spans.append((at, at + len(text), places))
            at += len(text)
        self.text = "".join(texts)

    def splices(self, start: int, end: int, text: str) -> list[Splice]:
        """Source edits that put ``text`` in place of a range: it goes to the first source piece met, the rest of the range leaves the others."""
        met = [s for s in self.spans if s[1] > start and s[0] < end]
        if not met:
            a, z, places = next((s for s in reversed(self.spans) if s[1] <= start), None) or next(s for s in self.spans if s[0] >= end)
            at = places[min(max(start - a, 0), z - a)]
            return [(at, at, escaped(text))]
        return [(places[max(start, a) - a], places[min(end, z) - a], escaped(text) if k == 0 else "") for k, (a, z, places) in enumerate(met)]


def spliced(src: str, edits: list[Splice]) -> str:
    """The source with all edits, from the right."""
    for s, e, t in sorted(edits, key=lambda x: (-x[0], -x[1])):
        src = src[:s] + t + src[e:]
    return src


def replace_text(src: str, old: str, new: str, every: bool) -> tuple[str, int, list[int], str]:
    """Status, places, changed blocks and the new source. Matches are exact or, where a block has none, typography-tolerant, and lie within one block."""
    if not old or old == new:
        return "invalid", 0, [], src
    blocks = [BlockText(src, *b) for b in page_blocks(src)]
    found = [(n, b, s, e) for n, b in enumerate(blocks, 1) for s, e, _ in find_all(b.text, old)]
    if not found or len(found) > 1 and not every:
        return "ambiguous" if found else "not_found", len(found), [], src
    edits = [x for _, b, s, e in found for hs, he, t in hunks(b.text[s:e], new) for x in b.splices(s + hs, s + he, t)]
    return "ok", len(found), sorted({f[0] for f in found}), spliced(src, edits)


def replaced_in_pages(pages: DataFrame, old: str, new: str, every: bool = True) -> DataFrame:
    """``page_id, status, places, blocks, html`` of every page: the text replaced in its blocks, all else as it was. A null page counts as empty. A map over rows."""

    def run(batches):
        for b in batches:
            for i, src in zip(b.column(0), b.column(1), strict=True):
                out = replace_text(src.as_py(), old, new, every)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), *(pa.array([x], t) for x, t in zip(out, (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string()), strict=True))], names=["page_id", "status", "places", "blocks", "html"])

    return pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, status string, places long, blocks array<int>, html string")


_TAGS = re.compile("h[1-6]|p|li|blockquote|pre")


def _line(src: str, at: int) -> tuple[int, str]:
    """Where the line of a place begins, and its indentation."""
    begin = src.rfind("\n", 0, at) + 1
    return begin, re.match(r"[ \t]*", src[begin:at])[0]


def edit_block(src: str, e: Element, kind: str, value: str, author: str) -> tuple[str, list[Splice]]:
    """Status and source edits of one block edit: delete, insert (``value`` as a block of the same kind after it), comment, retag (``value``: the new element)."""
    if e.start < 0:
        return "unsupported", []
    if kind == "comment":
        return "ok", [(e.start, e.start, f"<!-- 批注（{author}）：{value.replace('--', '—')} -->")]
    begin, indent = _line(src, e.start)
    if kind == "delete":
        whole = src[begin : e.start].strip(" \t") == ""
        rest = re.compile(r"[ \t]*\r?\n").match(src, e.end) if whole else None
        return "ok", [(begin if whole else e.start, rest.end() if rest else e.end, "")]
    if kind == "insert":
        opening = re.sub(r'\sid="[^"]*"', "", src[e.start : e.inner], count=1, flags=re.I)
        eol = "\r\n" if "\r\n" in src else "\n"
        return "ok", [(e.end, e.end, f"{eol}{indent}{opening}{escaped(value)}</{e.tag}>")]
    if kind == "retag":
        tag = value.lower()
        if not _TAGS.fullmatch(tag):
            return "invalid", []
        if e.end == e.close:
            return "unsupported", []
        return "ok", [(e.start, e.start + 1 + len(e.tag), f"<{tag}"), (e.close, e.end, f"</{tag}>")]
    return "invalid", []


def edited_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """``page_id, statuses, html`` of the pages that ``edits`` (page_id, ordinal, kind, value, author) name: all edits of a page against its blocks as they stand before,
    in the order of ordinal and kind. A page's edits are gathered beside it (they are few); what two edits both touch is left to the first."""

    def run(batches):
        for b in batches:
            for i, src, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks, statuses, done = page_blocks(src), [], []
                for w in sorted(wanted, key=lambda w: (w["ordinal"], w["kind"], w["value"] or "")):
                    n = w["ordinal"]
                    status, cuts = edit_block(src, blocks[n - 1][0], w["kind"], w["value"] or "", w["author"] or "") if 0 < n <= len(blocks) else ("not_found", [])
                    if any(s < z and a < e for s, e, _ in cuts for a, z, _ in done):
                        status, cuts = "protected", []
                    statuses.append(f"{n} {w['kind']} {status}")
                    done += cuts
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([statuses], pa.list_(pa.string())), pa.array([spliced(src, done)])], names=["page_id", "statuses", "html"])

    gathered = edits.filter("page_id IS NOT NULL AND ordinal IS NOT NULL").groupBy("page_id").agg(F.collect_list(F.struct("ordinal", "kind", "value", "author")).alias("edits"))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html")).join(gathered, "page_id")
    return rows.select("page_id", "html", "edits").mapInArrow(run, "page_id long, statuses array<string>, html string")
