"""Figures with their labels, and pictures set in rows and columns. What grows box by box runs by page."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.pages import CAPTION, PAGE, _by_page, clusters, is_figure

#: The mark of a part of a figure, the beginning of a caption under a picture, the width that a box gains on all sides.
MARK = re.compile(r"^\(?[a-zA-Z0-9]{1,3}[).]?$")
CAPTION_HEAD = re.compile(r"^(fig\.?|figure|table|tab\.|图|表)\s*\d*", re.I)
PAD = 1.0
Box = tuple[float, float, float, float]


def _box(r: dict) -> Box:
    return r["x0"], r["y0"], r["x1"], r["y1"]


def union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def near(a: Box, b: Box, gap: float) -> bool:
    return a[0] <= b[2] + gap and b[0] <= a[2] + gap and a[1] <= b[3] + gap and b[1] <= a[3] + gap


def shared(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a: Box) -> float:
    return (a[2] - a[0]) * (a[3] - a[1])


def centred(s: Box, r: Box, tol: float = 0.5) -> bool:
    x, y = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
    return r[0] - tol < x < r[2] + tol and r[1] - tol < y < r[3] + tol


def within(a: Box, r: Box, tol: float) -> bool:
    return a[0] >= r[0] - tol and a[2] <= r[2] + tol and a[1] >= r[1] - tol and a[3] <= r[3] + tol


def _overlaps(a: Box, b: Box) -> tuple[float, float]:
    """What two boxes share of their heights (negative: the gap), and the gap between them from left to right."""
    return min(a[3], b[3]) - max(a[1], b[1]), max(a[0], b[0]) - min(a[2], b[2])


def _cut(spans: list[dict], box: Box) -> bool:
    """A line of text runs over the edge of the box: what it holds stands beside text of its own."""
    return any(len(s["text"].strip()) >= 4 and not within(_box(s), box, 0.5) and shared(_box(s), box) > 0.2 * area(_box(s)) for s in spans)


def _merged(boxes: list[Box], meet) -> list[Box]:
    """Boxes grown together, the first pair that meets first, until none meets."""
    boxes = list(boxes)
    found = True
    while found:
        found = next(((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if meet(boxes[i], boxes[j])), None)
        if found:
            boxes[found[0]] = union(boxes[found[0]], boxes.pop(found[1]))
    return boxes


def _grids(rows: list[dict]) -> list[tuple]:
    """(grid, x0, y0, x1, y1, images, marks, text) of one page."""
    images = [r for r in rows if r["kind"] == "image" and area(_box(r)) > 400]
    spans = sorted((r for r in rows if r["kind"] == "span" and r["text"].strip()), key=lambda s: s["pos"])
    if len(images) < 2:
        return []
    body, width = images[0]["body"], images[0]["width"]
    heads = [s for s in spans if CAPTION_HEAD.match(s["text"].strip())]

    def meet(a: Box, b: Box) -> bool:
        high, gap = _overlaps(a, b)
        row = high > 0.5 * min(a[3] - a[1], b[3] - b[1]) and gap < 0.15 * width
        if not (row or near(a, b, 3 * body)):
            return False
        top, bottom = min(a[3], b[3]), max(a[1], b[1])
        return not (bottom - top > 4 and any(s["y0"] >= top - 1 and s["y1"] <= bottom + 1 and s["x1"] > min(a[0], b[0]) and s["x0"] < max(a[2], b[2]) for s in heads))

    out = []
    boxes = [_box(i) for i in sorted(images, key=lambda i: i["pos"])]
    for r0 in _merged(boxes, meet):
        held = [b for b in boxes if within(b, r0, 0)]
        if len(held) < 2:
            continue
        alone = lambda s: all(MARK.match(o["text"].strip()) or abs((o["y0"] + o["y1"]) - (s["y0"] + s["y1"])) / 2 > 0.4 * (s["y1"] - s["y0"] + 1) for o in spans)
        r = r0
        for s in spans:
            below = MARK.match(s["text"].strip()) and s["x0"] >= r0[0] - 2 and s["x1"] <= r0[2] + 2 and -2 <= s["y0"] - r0[3] < 1.6 * body and alone(s)
            if centred(_box(s), r) or below:
                r = union(r, _box(s))
        inner = [s for s in spans if centred(_box(s), r)]
        marks = [s for s in inner if MARK.match(s["text"].strip())]
        box = (r[0] - PAD, r[1] - PAD, r[2] + PAD, r[3] + PAD)
        if sum(len(s["text"].strip()) for s in inner if s not in marks) <= 80 and not _cut(spans, box):
            out.append((len(out) + 1, *box, len(held), len(marks), " ".join(s["text"].strip() for s in inner)))
    return out


def _labelled(rows: list[dict]) -> list[tuple]:
    """(figure, x0, y0, x1, y1, labels, text) of one page."""
    drawn = [r for r in rows if r["kind"] in ("path", "image")]
    if not drawn:
        return []
    spans = sorted((r for r in rows if r["kind"] == "span" and r["text"].strip()), key=lambda s: s["pos"])
    tables = [_box(r) for r in rows if r["kind"] == "table"]
    turned = [r for r in rows if r["kind"] == "rotated"]
    body, width = drawn[0]["body"], drawn[0]["width"]
    figs, weak = [], []
    for box, held in clusters([{**r, "image": int(r["kind"] == "image"), "area": r["width"] * r["height"]} for r in drawn]):
        box = tuple(box)
        curvy = sum(r["curvy"] for r in held)
        if is_figure(box, held) and (sum(shared(t, box) for t in tables) <= 0.6 * area(box) or curvy >= 4):
            figs.append(box)
        elif (curvy or any(r["image"] for r in held)) and box[2] - box[0] >= 6 and box[3] - box[1] >= 6:
            weak.append(box)

    def captioned(b: Box) -> bool:
        return any(re.match(CAPTION, s["text"]) and b[0] - 20 <= s["x0"] < b[2] and s["x1"] > b[0] and (abs(s["y1"] - b[1]) < 40 or abs(s["y0"] - b[3]) < 40) for s in spans)

    def meet(a: Box, b: Box) -> bool:
        if near(a, b, 4):
            return True
        high, gap = _overlaps(a, b)
        least = min(a[3] - a[1], b[3] - b[1])
        level = abs(a[1] - b[1]) < 0.2 * least + 4 and abs(a[3] - b[3]) < 0.2 * least + 4
        if not (high > 0.5 * least and gap < 0.1 * width and level):
            return False
        both = union(a, b)
        between = any(s["size"] >= 0.9 * body and len(s["text"].strip()) > 1 and centred(_box(s), both) and not centred(_box(s), a, 2) and not centred(_box(s), b, 2) for s in spans)
        return not between and not (captioned(a) and captioned(b))

    merged = _merged(sorted(figs, key=lambda b: b[1]), meet)
    # Lone shapes of a drawing, between which and the figure no word stands.
    words = [s for s in spans if re.search(r"[^\W\d_]{3,}", s["text"])]
    for k in range(len(merged)):
        joins = True
        while joins:
            r = merged[k]

            def beside(c: Box, r: Box = r) -> bool:
                high, gap = _overlaps(r, c)
                if high < 0.5 * min(r[3] - r[1], c[3] - c[1]) or gap > 0.15 * width:
                    return False
                hole = (min(r[2], c[2]), max(r[1], c[1]) - 2, max(r[0], c[0]), min(r[3], c[3]) + 2)
                return not any(centred(_box(s), hole, 0) for s in words)

            joins = next((c for c in weak if beside(c)), None)
            if joins:
                weak.remove(joins)
                merged[k] = union(r, joins)
    out = []
    for r in merged:
        for _ in range(4):
            before = r
            for s in spans:
                if centred(_box(s), r) or s["size"] < 0.92 * body and near(_box(s), r, 6) and not re.match(CAPTION, s["text"]):
                    r = union(r, _box(s))
            for t in turned:
                if near(_box(t), r, 8) and t["size"] <= 1.5 * body:
                    r = union(r, _box(t))
            if r == before:
                break
        inner = [s for s in spans if centred(_box(s), r)]
        box = (r[0] - PAD, r[1] - PAD, r[2] + PAD, r[3] + PAD)
        if sum(len(s["text"].strip()) for s in inner if s["size"] >= 0.95 * body) <= 160 and not _cut(spans, box):
            out.append((len(out) + 1, *box, len(inner), " ".join(s["text"].strip() for s in inner)))
    return out


def _drawing(drawn: DataFrame, spans: DataFrame, pages: DataFrame, *others: DataFrame) -> DataFrame:
    """All that stands on pages with drawings, one kind of row after another; pages without any make no row. The pages' sizes are rows of their own, so that all is dealt by page once."""
    cols = [*PAGE, "kind", "pos", "text", "x0", "y0", "x1", "y1", "size", "curvy", "coloured"]
    s = spans.select(*PAGE, F.lit("span").alias("kind"), F.col("elem").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), "size", F.lit(0).alias("curvy"), F.lit(0).alias("coloured"))
    rows = drawn.select(*cols, F.lit(True).alias("drawn")).unionByName(s.withColumn("drawn", F.lit(False)))
    for o in others:
        rows = rows.unionByName(o.select(*cols, F.lit(False).alias("drawn")))
    rows = rows.filter("x0 <= x1 AND y0 <= y1").unionByName(pages.select(*PAGE, "width", "height", "body", F.lit("page").alias("kind")), allowMissingColumns=True).dropna(subset=PAGE)
    w = Window.partitionBy(*PAGE)
    known = F.bool_or("drawn").over(w) & F.bool_or(F.col("kind") == "page").over(w)
    return rows.select(*cols, *(F.max(c).over(w).alias(c) for c in ("width", "height", "body")), known.alias("known")).filter("known AND kind <> 'page'").drop("known")


def _plain(rows: DataFrame, kind: str, pos: str, size: str = "0.0D", curvy: str = "0", coloured: str = "0") -> DataFrame:
    return rows.select(*PAGE, F.lit(kind).alias("kind"), F.col(pos).cast("long").alias("pos"), F.lit("").alias("text"), "x0", "y0", "x1", "y1", F.expr(size).alias("size"), F.expr(curvy).cast("int").alias("curvy"), F.expr(coloured).cast("int").alias("coloured"))


def image_grids(images: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Pictures of each page that form one figure: neighbours side by side (half their height shared, a gap under 15 % of the page) or closer than three body sizes, unless a caption
    stands between; with the marks (a), (b), ... inside and right below, which must have their line to themselves. More than 80 other characters inside, or a line of
    text over the edge, make it none.

    ``images``: doc_id, page, image, x0, y0, x1, y1 (those of 400 square points or less take no part); ``spans``: doc_id, page, elem, text, x0, x1, top, bottom, size; ``pages``:
    doc_id, page, width, height, body (size of the text). Returns doc_id, page, grid, x0, y0, x1, y1, images, marks, text. Boxes with a missing or negative side are left out; pages that ``pages`` lacks make no row.
    """
    return _by_page(_drawing(_plain(images, "image", "image"), spans, pages), _grids, "grid int, x0 double, y0 double, x1 double, y1 double, images int, marks int, text string")


def labelled_figures(paths: DataFrame, images: DataFrame, spans: DataFrame, pages: DataFrame, tables: DataFrame, rotated: DataFrame) -> DataFrame:
    """Drawings with all that belongs to them: level panels side by side become one figure unless body text or a caption of each stands apart, lone shapes in the row join where no word is between,
    small texts within 6 points and turned ones within 8 are absorbed, as often as four times. What lies on a table for the most part, holds more than 160 characters in
    the body's size or cuts a line of text is no figure.

    ``paths``: doc_id, page, path, x0, y0, x1, y1, curvy, coloured (0 or 1); ``images``, ``spans``, ``pages`` as in ``image_grids``; ``tables``: doc_id, page, tab, x0, y0, x1, y1;
    ``rotated``: doc_id, page, elem, x0, y0, x1, y1, size. Returns doc_id, page, figure, x0, y0, x1, y1, labels, text.
    """
    drawn = _plain(paths, "path", "path", curvy="curvy", coloured="coloured").unionByName(_plain(images, "image", "image"))
    rows = _drawing(drawn, spans, pages, _plain(tables, "table", "tab"), _plain(rotated, "rotated", "elem", "size"))
    return _by_page(rows, _labelled, "figure int, x0 double, y0 double, x1 double, y1 double, labels int, text string")
