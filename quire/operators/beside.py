"""Two blocks of text side by side, as on the first pages of articles: keywords to the left, the abstract to the right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.pages import PAGE, _by_page, _gutter, with_lines

Interval = tuple[float, float]
#: Room between a cell's text and its border.
MARGIN = 3.0


def without(free: list[Interval], a: float, b: float) -> list[Interval]:
    """What of disjoint intervals is left when [a, b] is taken."""
    out: list[Interval] = []
    for p, q in free:
        if b <= p or a >= q:
            out.append((p, q))
        else:
            out += [(p, a)] * (a > p) + [(b, q)] * (b < q)
    return out


def merged_rules(rules: list[dict], gap: float = 2.0) -> list[dict]:
    """Horizontal rules at one height that touch, as one."""
    out: list[dict] = []
    for r in sorted(rules, key=lambda r: (round(r["top"]), r["x0"])):
        last = out[-1] if out else None
        if last and abs(last["top"] - r["top"]) <= 1.0 and r["x0"] <= last["x1"] + gap:
            last["x1"] = max(last["x1"], r["x1"])
        else:
            out.append(dict(r))
    return out


def _runs(lines: list[dict], low: float, high: float, off_centre) -> list[tuple[list[dict], list[Interval]]]:
    """Runs of lines with a corridor that none of them crosses: what is free is carried from line to line, and a run ends where nothing is left or the lines part."""
    out, i = [], 0
    while i < len(lines):
        free, j = [(low, high)], i
        while j < len(lines):
            if j > i and lines[j]["top"] - lines[j - 1]["bottom"] >= 2.5 * max(lines[j]["size"], lines[j - 1]["size"]):
                break
            left = free
            for s in lines[j]["spans"]:
                left = without(left, s["x0"] - 3, s["x1"] + 3)
            left = [v for v in left if v[1] - v[0] >= 8 and off_centre(v)]
            if not left:
                break
            free, j = left, j + 1
        if j > i:
            out.append((lines[i:j], free))
        i = max(j, i + 1)
    return out


def _beside(rows: list[dict]) -> list[tuple]:
    """The blocks of one page: number, extent, border between the sides, height of the rule under the heads, lines, texts."""
    spans = [r for r in rows if r["kind"] == "span" and r["text"].strip()]
    rules = merged_rules([r for r in rows if r["kind"] == "rule"])
    if len(spans) < 12:
        return []
    by: dict[int, list[dict]] = {}
    for s in spans:
        by.setdefault(s["line"], []).append(s)
    lines = [{"spans": sorted(v, key=lambda s: s["x0"]), "top": min(s["top"] for s in v), "bottom": max(s["bottom"] for s in v), "size": max(s["size"] for s in v)} for v in by.values()]
    lines.sort(key=lambda n: n["top"])
    x0, x1 = min(s["x0"] for s in spans), max(s["x1"] for s in spans)
    width = x1 - x0
    if width < 200:
        return []
    columns = None
    out: list[tuple] = []
    for run, free in _runs(lines, x0 + 0.12 * width, x0 + 0.88 * width, lambda v: not x0 + 0.4 * width <= (v[0] + v[1]) / 2 <= x0 + 0.6 * width):
        if len(run) < 6:
            continue
        a, b = max(free, key=lambda v: v[1] - v[0])
        held = [s for n in run for s in n["spans"]]
        ends, starts = [s["x1"] for s in held if s["x1"] <= (a + b) / 2], [s["x0"] for s in held if s["x0"] >= (a + b) / 2]
        if not ends or not starts:
            continue
        left, right = max(ends), min(starts)
        border = (left + right) / 2
        sides = [[[s for s in n["spans"] if (s["x1"] <= border if k == 0 else s["x0"] >= border)] for n in run] for k in (0, 1)]
        filled = [sum(map(bool, side)) for side in sides]
        chars = [sum(len(s["text"].strip()) for n in side for s in n) for side in sides]
        if min(filled) < 3 or min(chars) < 40:
            continue
        top, bottom = min(s["top"] for s in held) - 1, max(s["bottom"] for s in held) + 1
        on_left = lambda r: (r["x0"] + r["x1"]) / 2 < border and r["x1"] < right - 1
        on_right = lambda r: (r["x0"] + r["x1"]) / 2 > border and r["x0"] > left + 1
        inside = [r for r in rules if top < r["top"] < bottom and r["x1"] - r["x0"] > 30 and (on_left(r) or on_right(r))]
        level = all(abs(r["top"] - inside[0]["top"]) <= 1.5 for r in inside)
        both = len(inside) >= 2 and level and any(map(on_left, inside)) and any(map(on_right, inside))
        front = run[0]["spans"][0]["page"] == 1 and top < 0.5 * run[0]["spans"][0]["height"] and len(run) >= 8 and min(filled) >= 4
        rule = inside[0]["top"] if inside else None
        if not (both or front) or rule is not None and any(s["top"] < rule < s["bottom"] for s in held):
            continue
        columns = _gutter(spans) if columns is None else columns  # only where all else holds: it costs as much as the rest
        if columns and (abs(right - columns[0][2]) <= 4 or abs(left - columns[0][1]) <= 4):
            continue
        texts = ["\n".join(" ".join(s["text"].strip() for s in n) for n in side if n) for side in sides]
        out.append((len(out) + 1, min(s["x0"] for s in held) - MARGIN, border, max(s["x1"] for s in held) + MARGIN, top, bottom, rule if rule is not None and level else None, len(run), *texts))
    return out


def side_by_side(spans: DataFrame, lines: DataFrame | None, rules: DataFrame) -> DataFrame:
    """Blocks side by side of each page: a corridor off the centre that six lines or more leave free, text of some length on both sides, and a rule under each side's head
    or, on the upper half of a first page, eight lines. A corridor that is the gutter of the page's columns makes none.

    ``spans``: doc_id, page, elem, text, x0, x1, top, bottom, size, height (of the page); ``lines``: doc_id, page, elem, line, or None: assembled in the same pass; ``rules``: doc_id, page, y, x0, x1.
    Returns doc_id, page, block, x0, border, x1, y0, y1, rule, lines, left, right. Pages without spans make no row; empty texts take no part.
    """
    known = spans.withColumn("line", F.lit(0)) if lines is None else spans.join(lines, [*PAGE, "elem"])
    s = known.select(*PAGE, F.lit("span").alias("kind"), "elem", F.col("line").cast("int").alias("line"), F.coalesce("text", F.lit("")).alias("text"), "x0", "x1", "top", "bottom", "size", "height")
    r = rules.select(*PAGE, F.lit("rule").alias("kind"), F.lit(-1).alias("elem"), F.lit(0).alias("line"), F.lit("").alias("text"), "x0", "x1", F.col("y").alias("top"), F.col("y").alias("bottom"), F.lit(0.0).alias("size"), F.lit(0.0).alias("height"))

    alone = lines is None

    def blocks(rows: list[dict]) -> list[tuple]:
        if alone:
            rows = with_lines([x for x in rows if x["kind"] == "span"]) + [x for x in rows if x["kind"] == "rule"]
        return _beside(rows)

    return _by_page(s.unionByName(r), blocks, "block int, x0 double, border double, x1 double, y0 double, y1 double, rule double, lines int, left string, right string")
