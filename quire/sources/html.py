"""HTML pages as ordered blocks of the tree that browsers build, with the place of every character in the source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tree import Builder, Element, Text, decoded

#: Elements that make a block, containers whose direct text does, and what is passed over.
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre figcaption caption title blockquote summary".split())
CONTAINERS = frozenset("div section article header footer main aside nav body blockquote".split())
SKIPPED = frozenset("script style template noscript svg math".split())
KINDS = {"li": "list", "td": "table-cell", "th": "table-cell", "blockquote": "quote", "pre": "code", "title": "title"}


def page_blocks(src: str) -> list[tuple[Element, list[tuple[int, int, bool]]]]:
    """The blocks of a page in document order: element and source pieces of its text. A text belongs to the nearest block around it; one without such a block to none."""
    found, waiting = [], [(Builder(src).root, None)]
    while waiting:
        node, block = waiting.pop()
        if isinstance(node, Text):
            if block is not None:
                block[1].extend(node.pieces)
            continue
        if node.tag in SKIPPED:
            continue
        if node.tag in BLOCK_TAGS or node.tag in CONTAINERS and any(isinstance(k, Text) and "".join(decoded(src, *p)[0] for p in k.pieces).strip() for k in node.kids):
            block = (node, [])
            found.append(block)
        waiting += [(k, block) for k in reversed(node.kids)]
    return [(e, pieces) for e, pieces in found if any(decoded(src, *p)[0].strip() for p in pieces)]


def html_blocks(page: str) -> list[tuple[int, str, int | None, str]]:
    """(ordinal, kind, heading level, text) of one page; white space collapsed."""
    out = []
    for n, (e, pieces) in enumerate(page_blocks(page), 1):
        text = " ".join("".join(decoded(page, *p)[0] for p in pieces).split())
        level = int(e.tag[1]) if e.tag[0] == "h" and e.tag[1:].isdigit() else 0 if e.tag == "title" else None
        out.append((n, "heading" if level else KINDS.get(e.tag, "paragraph"), level, text))
    return out


def with_html_blocks(pages: DataFrame) -> DataFrame:
    """One row a block: page_id, ordinal, ref, kind, level, text. A map over rows."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            out = [(i, *x) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in html_blocks(h)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["page_id", "ordinal", "kind", "level", "text"])

    out = rows.mapInArrow(run, "page_id long, ordinal int, kind string, level int, text string")
    return out.select("page_id", "ordinal", F.concat(F.lit("H"), "ordinal", F.lit("@v0")).alias("ref"), "kind", "level", "text")
