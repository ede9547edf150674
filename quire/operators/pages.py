"""Page geometry: lines, columns, paragraphs, tables, figures, equations, headers. Inputs are spans and segments of pages; what is sequential runs by page."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.layout import merged_rules

#: What begins a list item, a clause, a numbered heading.
BULLET = r"^(\[\d{1,4}\]|[•·▪■□◆◇○●➢➤►▸☐☑☒\-–—*]|\(?\d{1,3}[.)、]|\(?[a-zA-Z][.)]|\([ivxIVX]+\)|[ivxIVX]+[.)]|[一二三四五六七八九十]+[、.．])$"
CLAUSE = r"^(\d{1,3}(\.\d{1,3}){1,4}\.?|第[一二三四五六七八九十百零〇\d]+[条章节款项]|[（(]\s*(\d{1,3}|[a-zA-Z]{1,2}|[ivxlcIVXLC]{1,6}|[一二三四五六七八九十]{1,3})\s*[)）]|[一二三四五六七八九十]{1,3}[、.．]|(Article|ARTICLE|Section|SECTION|Clause|CLAUSE)\s+\d{1,3}(\.\d{1,3})*\.?)$"
HEADING_NUMBER = r"^(第[一二三四五六七八九十百\d]+[章节部分篇]|[一二三四五六七八九十]+[、.．]|（[一二三四五六七八九十]+）|\d+(\.\d+){0,3}[.)]?\s|[IVX]+\.\s|[A-Z]\.\s|APPENDIX|ACKNOWLEDG|REFERENCES)"
#: Relations that mark an equation, its number, and the caption of a figure or table.
RELATION = r"[=≈≃≅≡≠≤≥≪≫∈∉⊂⊆←→↦∝]|:="
EQUATION_NUMBER = r"\(\s*\d{1,3}[a-z]?\s*\)\s*$"
CAPTION = r"^(?i:((fig\.?|figure|table)\s*[\dIVXLC]+[a-z]?\s*[:.．：]|TABLE\s+[IVXLC\d]+\b|[图表]\s*\d+))"
TABLE_HEAD = r"^(?i:(table|tab\.)\s*[\dIVXLC]+\b|表\s*\d)"
_TABLE_HEAD = re.compile(TABLE_HEAD)
#: Spacing accents and the combining ones that they become.
ACCENTS, COMBINING = "ˆ^˜~¯˙¨´`ˇ→⃗", "̂̂̃̃̄̇̈́̀̌⃗⃗"
PAGE = ["doc_id", "page"]


def label_kinds(texts: DataFrame) -> DataFrame:
    """What the first word and the text of each row (id, text) begin: a list item, a clause, a numbered heading."""
    first = F.element_at(F.split(F.trim("text"), r"\s+"), 1)
    return texts.select("id", first.rlike(BULLET).alias("bullet"), first.rlike(CLAUSE).alias("clause"), F.col("text").rlike(HEADING_NUMBER).alias("numbered"))


def _by_page(rows: DataFrame, f, columns: str) -> DataFrame:
    """Applies ``f`` (rows as dicts, returns tuples) to each page by itself.

    A window over the page tells how many rows it has and leaves them side by side, so many pages go to Python in one batch and a task holds a batch and a page; a page that
    a batch cuts waits for its rest. Rows that a join or a window has dealt by page already are not shuffled again.
    """
    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in PAGE)
    schema = _arrow(f"{keys}, {columns}")
    names = rows.columns

    def run(batches):
        held, whole = [], 0
        for batch in batches:
            *cols, counts = map(_values, batch.columns)
            met = [dict(zip(names, v, strict=True)) for v in zip(*cols, strict=True)]
            out, i = [], 0
            while i < len(met):
                whole = whole if held else counts[i]
                part = met[i : i + whole - len(held)]
                i += len(part)
                held = held + part if held else part
                if len(held) == whole:
                    key = tuple(held[0][k] for k in PAGE)
                    out += [(*key, *t) for t in f(held)]
                    held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.withColumn("rows_of_page", F.count(F.lit(1)).over(Window.partitionBy(*PAGE))).mapInArrow(run, f"{keys}, {columns}")


def _values(column: pa.Array) -> list:
    """A column of a batch as Python values."""
    return column.to_pylist() if column.null_count and not pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _assemble(spans: list[dict]) -> list[tuple]:
    """(elem, line) of one page: from the top, each span joins the nearest of the last lines whose baseline and height agree and where it covers nothing."""
    lines: list[tuple[list, list]] = []  # of each line the largest span's size, top and bottom, and the extents of all
    out = []
    for s in sorted(spans, key=lambda s: (s["bottom"], s["x0"], s["elem"])):
        x0, x1, top, bottom, size = s["x0"], s["x1"], s["top"], s["bottom"], s["size"]
        best, near = None, float("inf")
        for k in range(len(lines) - 1, max(len(lines) - 13, -1), -1):
            (high, upper, base), extents = lines[k]
            off = abs(base - bottom)
            if off >= near or off > (0.2 * size if abs(high - size) < 0.6 else 0.5 * max(high, size)):
                continue
            if min(base, bottom) - max(upper, top) < 0.45 * min(base - upper, bottom - top):
                continue
            if any(min(z, x1) - max(a, x0) > 0.3 * min(z - a, x1 - x0) for a, z in extents):
                continue
            best, near = k, off
        if best is None:
            best = len(lines)
            lines.append(([size, top, bottom], []))
        elif size > lines[best][0][0]:
            lines[best][0][:] = size, top, bottom
        lines[best][1].append((x0, x1))
        out.append((s["elem"], best + 1))
    return out


def assembled_lines(spans: DataFrame) -> DataFrame:
    """The line of its page that each span belongs to: doc_id, page, elem, line."""
    return _by_page(spans.select(*PAGE, "elem", "x0", "x1", "top", "bottom", "size"), _assemble, "elem int, line int")


def line_table(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Assembled lines: text from left to right, extent, the size of most of its characters (of equal ones the larger), number of spans."""
    s = spans.join(lines, [*PAGE, "elem"])
    size = s.groupBy(*PAGE, "line", "size").agg(F.sum(F.length(F.trim("text"))).alias("chars")).groupBy(*PAGE, "line").agg(F.max_by("size", F.struct("chars", "size")).alias("size"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "elem", "text"))), lambda x: x["text"]), " ")
    box = s.groupBy(*PAGE, "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("spans"))
    return box.join(size, [*PAGE, "line"])


def attached_marks(spans: DataFrame) -> DataFrame:
    """Small spans (at most 85 % of the size) and the larger span of their page whose script they are: the one with the nearest baseline that spans them sideways."""
    small = spans.select(*PAGE, F.col("elem").alias("mark"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("bottom").alias("u"), F.col("size").alias("s"), F.length(F.regexp_replace("text", r"\s", "")).alias("n"))
    off = F.abs(F.col("bottom") - F.col("u"))
    met = spans.join(small, PAGE).filter((F.col("s") <= 0.85 * F.col("size")) & F.col("n").between(1, 30) & (F.col("a") >= F.col("x0") - 2) & (F.col("b") <= F.col("x1") + 2.5 * F.col("size")) & (off <= 0.75 * F.col("size")))
    best = met.groupBy(*PAGE, "mark").agg(F.min_by(F.struct("elem", (F.col("u") < F.col("bottom")).alias("above")), F.struct(off, "elem")).alias("host"))
    return best.select(*PAGE, "mark", F.col("host.elem").alias("host"), F.when(F.col("host.above"), "superscript").otherwise("subscript").alias("script"))


def folded_accents(rows: DataFrame) -> DataFrame:
    """Texts (id, text, x0, x1) with an accent that stands over them at ``cx`` set on the letter under it."""
    n = F.length("text")
    at = F.least(n - 1, F.greatest(F.lit(0), F.floor((F.col("cx") - F.col("x0")) / F.greatest(F.lit(0.1), F.col("x1") - F.col("x0")) * n))).cast("int")
    over = (F.col("x0") - 0.5 <= F.col("cx")) & (F.col("x1") + 0.5 >= F.col("cx")) & (n > 0)
    mark = F.translate(F.trim("accent"), ACCENTS, COMBINING)
    return rows.select("id", F.when(over, F.concat(F.left("text", at + 1), mark, F.substring("text", at + 2, n))).otherwise(F.col("text")).alias("text"))


def _gutter(spans: list[dict], least: int = 4) -> list[tuple]:
    """The column gutter of one page (x, left edge, right edge), or none."""
    import numpy as np

    lines: dict = {}
    for s in spans:
        lines.setdefault(s["line"], []).append(s)
    if len(lines) < 6:
        return []
    lo, hi = min(s["x0"] for s in spans), max(s["x1"] for s in spans)
    width = hi - lo
    xs = np.arange(lo + 0.3 * width, lo + 0.7 * width + 1e-9, 1.0)
    most = max(map(len, lines.values()))
    # The k-th spans of all lines together; a line without one has a span that lies left of everything.
    spans_at = [[np.array([line[k][c] if k < len(line) else -np.inf for line in lines.values()])[:, None] for c in ("x0", "x1")] for k in range(most)]
    tight = 0.8 * np.array([max(s["size"] for s in line) for line in lines.values()])[:, None]

    def measured(x):
        """Of each line at each place: whether it crosses it, and the ends of what lies left and right of it."""
        over, end, start = np.zeros((len(lines), len(x)), bool), np.full((len(lines), len(x)), -np.inf), np.full((len(lines), len(x)), np.inf)
        for x0, x1 in spans_at:
            on_left = (x0 + x1) / 2 < x
            np.maximum(end, x1, out=end, where=on_left)
            np.minimum(start, x0, out=start, where=~on_left)
            over |= (x0 < x - 1) & (x1 > x + 1)
        return over | (start - end < tight), end, start

    over, end, start = measured(xs)
    two = (~over & np.isfinite(end) & np.isfinite(start)).sum(0)
    left, right = (~over & (end - lo > 0.2 * width)).sum(0), (~over & (hi - start > 0.2 * width)).sum(0)
    score = np.maximum(two, np.minimum(left, right) - over.sum(0))
    top = int(score.max(initial=0))
    if top < least or top < 0.15 * len(lines):
        return []
    runs = np.split(np.flatnonzero(score == top), np.flatnonzero(np.diff(np.flatnonzero(score == top)) > 1) + 1)
    run = max(runs, key=len)
    x = float(xs[run[0]] + xs[run[-1]]) / 2
    crossed = measured(np.array([x]))[0][:, 0]
    parts = [([s for s in line if (s["x0"] + s["x1"]) / 2 < x], [s for s in line if (s["x0"] + s["x1"]) / 2 >= x]) for line, c in zip(lines.values(), crossed, strict=True) if not c]
    ends, starts = [max(s["x1"] for s in a) for a, _ in parts if a], [min(s["x0"] for s in b) for _, b in parts if b]

    def edge(values, outer):
        bins: dict = {}
        for v in values:
            k = np.floor(v * 2 + 0.5) / 2
            bins[k] = bins.get(k, 0) + 1
        near = [k for k in bins if sum(bins.get(k + d, 0) for d in (-0.5, 0, 0.5)) >= max(3, -(-15 * len(values) // 100))]
        return float(outer(near or values))

    g0, g1 = edge(ends, max), edge(starts, min)
    if g1 - g0 < 6:
        return []
    tol = max(3.0, 0.5 * max(s["size"] for s in spans))
    if sum(any(s["x1"] > g0 + tol and s["x0"] < g1 - tol for s in a + b) for a, b in parts) > max(2, 0.2 * len(parts)):
        return []
    col = g0 - min(s["x0"] for a, _ in parts for s in a), max(s["x1"] for _, b in parts for s in b) - g1
    full = sum(bool(a) and max(s["x1"] for s in a) <= g0 + tol and max(s["x1"] for s in a) - min(s["x0"] for s in a) >= 0.6 * col[0] for a, _ in parts), sum(bool(b) and min(s["x0"] for s in b) >= g1 - tol and max(s["x1"] for s in b) - min(s["x0"] for s in b) >= 0.6 * col[1] for _, b in parts)
    need = [min(3, -(-len(v) // 2)) for v in (ends, starts)]
    return [(x, g0, g1)] if min(col) >= 0.15 * width and full[0] >= need[0] and full[1] >= need[1] else []


def column_gutters(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """x, g0, g1 of each page set in two columns. A page of one column, of few lines, with lines across or short labels side by side makes no row."""
    s = spans.join(lines, [*PAGE, "elem"]).select(*PAGE, "line", "x0", "x1", "size")
    return _by_page(s, _gutter, "x double, g0 double, g1 double")


def with_lines(spans: list[dict]) -> list[dict]:
    """The spans of one page with the line that each belongs to."""
    line = dict(_assemble(spans))
    for s in spans:
        s["line"] = line[s["elem"]]
    return spans


def page_columns(spans: DataFrame, middle: float = 306.0) -> DataFrame:
    """Of each page, in one pass: its gutter (x, g0, g1; NULL without one), how many spans cross it (or the page's middle), and how many there are (lines)."""

    def columns(page: list[dict]) -> list[tuple]:
        gutter = _gutter(with_lines(page)) or [(None, None, None)]
        x = middle if gutter[0][0] is None else gutter[0][0]
        return [(*gutter[0], sum(s["x0"] < x < s["x1"] for s in page), len(page))]

    return _by_page(spans.select(*PAGE, "elem", "x0", "x1", "top", "bottom", "size"), columns, "x double, g0 double, g1 double, crossing int, lines int")


def agreed_gutters(pages: DataFrame, near: float = 12.0) -> DataFrame:
    """Each page's gutter by its document's (doc_id, page, x, g0, g1, crossing, lines): the upper medians replace a page's own near them and serve pages without one where at
    most 30 % of four lines or more cross. A document's pages, a row each, are ranked where they lie."""
    doc = Window.partitionBy("doc_id")
    p = pages.withColumn("known", F.count("x").over(doc)).filter("known > 0")
    at = (F.floor(F.col("known") / 2) + 1).cast("int")
    for c in ("x", "g0", "g1"):
        rank = F.row_number().over(doc.orderBy(F.col(c).asc_nulls_last()))
        p = p.withColumn("rank", rank).withColumn(f"m_{c}", F.max(F.when(F.col("rank") == at, F.col(c))).over(doc))
    own = F.col("x").isNotNull()
    take = own & (F.col("known") >= 2) & (F.abs(F.col("x") - F.col("m_x")) <= near) | ~own & (F.col("lines") >= 4) & (F.col("crossing") <= 0.3 * F.col("lines"))
    return p.select(*PAGE, *(F.when(take, F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in ("x", "g0", "g1"))).filter("x IS NOT NULL")


def gutter_consensus(gutters: DataFrame, pages: DataFrame, near: float = 12.0) -> DataFrame:
    """``agreed_gutters`` of pages (doc_id, page, crossing, lines) whose gutters (doc_id, page, x, g0, g1) are another table; a gutter whose page ``pages`` lacks counts, but makes no row."""
    both = gutters.join(pages.withColumn("met", F.lit(True)), PAGE, "full")
    known = agreed_gutters(both, near)
    return known.join(pages.select(*PAGE), PAGE, "left_semi")


def _paragraphs(lines: list[dict]) -> list[tuple]:
    """(elem, paragraph) of one page's lines, from the top of each column down."""
    bullet, clause = re.compile(BULLET), re.compile(CLAUSE)
    lines = sorted(lines, key=lambda s: (s["side"], s["top"], s["x0"]))
    out, para, held = [], 0, []
    for i, s in enumerate(lines):
        a = held[-1] if held else None
        joins = False
        if a is not None and a["side"] == s["side"]:
            gap, size = s["bottom"] - a["bottom"], max(a["size"], s["size"])
            pitch = a["bottom"] - held[-2]["bottom"] if len(held) > 1 else 0
            word = s["text"].strip().split(" ")[0] if s["text"].strip() else ""
            edge = max((o["x1"] for o in lines[max(0, i - 5) : i + 5] if o["side"] == s["side"] and abs(o["x0"] - a["x0"]) <= 20), default=a["x1"])
            body = held[1]["x0"] if len(held) > 1 else None
            left = abs(s["x0"] - body) <= 3 if body is not None else s["x0"] <= held[0]["x0"] + 3 or bool(bullet.match(held[0]["text"].split(" ")[0]))
            joins = (
                abs(s["size"] - a["size"]) <= 0.15 * a["size"] and 0.5 * a["size"] < gap <= 1.75 * size and (not pitch or abs(gap - pitch) <= 0.2 * pitch + 0.6)
                and not bullet.match(word) and not clause.match(word) and a["x1"] + len(word) * 0.5 * s["size"] + 0.25 * a["size"] > edge - 0.5 and left
            )
        if not joins:
            para += 1
            held = []
        held.append(s)
        out.append((s["elem"], para))
    return out


def paragraphs(lines: DataFrame) -> DataFrame:
    """The paragraph of its page that each line (with its column ``side``) belongs to: same size and pitch, the line before full, the same left edge, no new item."""
    return _by_page(lines.select(*PAGE, "elem", "side", "text", "x0", "x1", "top", "bottom", "size"), _paragraphs, "elem int, para int")


def paragraph_shapes(lines: DataFrame, paras: DataFrame, left: Column, right: Column) -> DataFrame:
    """Of each paragraph: number of lines, first-line indent, alignment (both: four fifths of its lines but the last, three at least, end at its right edge; center; left), full last line."""
    s = lines.join(paras, [*PAGE, "elem"])
    w = Window.partitionBy(*PAGE, "para")
    s = s.withColumn("r", F.row_number().over(w.orderBy("top", "x0"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("edge", F.max("x1").over(w)).withColumn("l", left).withColumn("rt", right)
    inner = F.col("r") < F.col("n")
    at_edge = F.sum((inner & (F.col("edge") - F.col("x1") <= 1.5)).cast("int"))
    centred = F.min(((F.abs((F.col("x0") - F.col("l")) - (F.col("rt") - F.col("x1"))) <= 3) & (F.col("x0") - F.col("l") > 6)).cast("int")) == 1
    g = s.groupBy(*PAGE, "para").agg(F.count(F.lit(1)).alias("lines"), F.round(F.min_by("x0", "r") - F.min(F.when(F.col("r") > 1, F.col("x0"))), 3).alias("indent"), at_edge.alias("full"), centred.alias("centred"), F.max_by(F.col("edge") - F.col("x1") <= 1.5, "r").alias("last_full"))
    both = (F.col("full") >= 3) & (F.col("full") >= 0.8 * (F.col("lines") - 1))
    return g.select(*PAGE, "para", "lines", "indent", F.when(both, "both").when(F.col("centred"), "center").otherwise("left").alias("align"), "last_full")


def merged_paragraphs(paras: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, ordinal, text, size, align, first_line, last_full, heading) that a column or page break cut, as one: first and last ordinal, text."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    before = lambda c: F.lag(c).over(w)
    word = F.element_at(F.split(F.trim("text"), r"\s"), 1)
    goes_on = (
        before("last_full") & before("align").isin("both", "left") & F.col("align").isin("both", "left") & (F.abs(F.col("size") - before("size")) <= 0.3) & (F.abs("first_line") <= 0.3 * F.col("size"))
        & ~F.col("heading") & ~before("heading") & (F.trim("text") != "") & (F.trim(before("text")) != "") & ~word.rlike(BULLET) & ~word.rlike(CLAUSE) & ~F.col("text").rlike(CAPTION)
        & (~F.rtrim(before("text")).rlike("[.!?。！？:：][\"'”’)\\]]?$") | F.col("text").rlike("^[a-z]"))
    )
    run = paras.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: F.trim(x["text"]))
    glue = lambda a, b: F.when(a == "", b).when(a.rlike("[-‐]$") | a.rlike("[⺀-鿿]$") & b.rlike("^[⺀-鿿]"), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    return run.groupBy("doc_id", "run").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), texts.alias("t")).select("doc_id", "first", "last", F.aggregate("t", F.lit(""), glue).alias("text"))


def ruled_tables(components: DataFrame, segments: DataFrame | None = None, tol: float = 2.0) -> DataFrame:
    """Tables drawn with rules: components of two horizontal and two vertical segments at least, at least 20 wide and 8 high, with their rows and columns (places within ``tol`` are one).
    ``components`` may bring the segments' columns along (``layout.with_components``); they are dealt by page, so all that follows stays where it lies."""
    s = (components.repartition(*PAGE) if segments is None else components.join(segments, [*PAGE, "seg"])).select(*PAGE, "root", "horizontal", F.when(F.col("horizontal"), F.col("y0")).otherwise(F.col("x0")).alias("v"))
    w = Window.partitionBy(*PAGE, "root", "horizontal").orderBy("v")
    runs = s.withColumn("run", F.sum(F.when(F.col("v") - F.lag("v").over(w) > tol, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = runs.groupBy(*PAGE, "root", "horizontal", "run").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("k"))
    of = lambda f, h: f(F.when(F.col("horizontal") == F.lit(h), F.col("v")))
    n = lambda h: F.sum((F.col("horizontal") == F.lit(h)).cast("int"))
    k = lambda h: F.sum(F.when(F.col("horizontal") == F.lit(h), F.col("k")).otherwise(0))
    t = lines.groupBy(*PAGE, "root").agg(*(of(f, h).alias(a) for a, f, h in (("x0", F.min, False), ("x1", F.max, False), ("y0", F.min, True), ("y1", F.max, True))), n(True).alias("ys"), n(False).alias("xs"), k(True).alias("hs"), k(False).alias("vs"))
    big = t.filter("hs >= 2 AND vs >= 2 AND xs >= 2 AND ys >= 2 AND x1 - x0 >= 20 AND y1 - y0 >= 8")
    return big.select(*PAGE, F.col("root").alias("tab"), "x0", "x1", "y0", "y1", (F.col("ys") - 1).cast("int").alias("n_rows"), (F.col("xs") - 1).cast("int").alias("n_cols"))


def cell_grid(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """Merged cells of a grid of unit cells (r, c) by missing borders: first row and column, row and column span. Neighbours in a row are one cell where no border stands between;
    cells over one another are one where no border lies between and they span the same columns."""
    has = borders.groupBy(*PAGE, "cell").agg(F.bool_or((F.col("edge") == "left") & F.col("border")).alias("left"), F.bool_or((F.col("edge") == "top") & F.col("border")).alias("top"))
    row = Window.partitionBy(*PAGE, "r").orderBy("c")
    g = cells.select(*PAGE, "cell", "r", "c").join(has, [*PAGE, "cell"]).withColumn("g", F.sum(F.when(F.col("left") | (F.row_number().over(row) == 1), 1).otherwise(0)).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    wide = g.groupBy(*PAGE, "r", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.bool_or("top").alias("top"))
    column = Window.partitionBy(*PAGE, "c0", "c1").orderBy("r")
    on = ~F.col("top") & (F.lag("r").over(column) == F.col("r") - 1)
    runs = wide.withColumn("run", F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(column.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*PAGE, "c0", "c1", "run").agg(F.min("r").alias("r"), F.count(F.lit(1)).cast("int").alias("row_span")).select(*PAGE, "r", F.col("c0").alias("c"), "row_span", (F.col("c1") - F.col("c0") + 1).alias("col_span"))


def _parted(rules: list[dict], spans: list[dict]) -> list[list[dict]]:
    """Rules of one extent, parted where a caption of a table or a line of prose (over 60 % of the width, six words at least, no gap as between columns) stands between two."""
    out = [rules[:1]]
    for a, b in zip(rules, rules[1:], strict=False):
        x0, x1 = min(a["x0"], b["x0"]), max(a["x1"], b["x1"])
        between = [s for s in spans if a["top"] < (s["top"] + s["bottom"]) / 2 < b["top"] and s["x1"] > x0 - 2 and s["x0"] < x1 + 2 and s["text"].strip()]
        lines: dict[int, list[dict]] = {}
        by = {s["elem"]: s for s in between}
        for elem, line in _assemble(between):
            lines.setdefault(line, []).append(by[elem])
        ends = False
        for line in lines.values():
            line.sort(key=lambda s: s["x0"])
            text = " ".join(s["text"] for s in line).strip()
            prose = line[-1]["x1"] - line[0]["x0"] > 0.6 * (x1 - x0) and len(text.split()) >= 6
            if prose:
                gap = max((q["x0"] - p["x1"] for p, q in zip(line, line[1:], strict=False)), default=0)
                prose = gap < max(4, 0.6 * max(s["size"] for s in line))
            ends |= prose or bool(_TABLE_HEAD.match(text))
        if ends:
            out.append([b])
        else:
            out[-1].append(b)
    return out


def _booktabs(rows: list[dict]) -> list[tuple]:
    """(table, row, column, text) of one page's tables with horizontal rules only."""
    rules = sorted((r for r in rows if r["rule"] and r["x1"] - r["x0"] >= 60), key=lambda r: r["top"])
    spans = [r for r in rows if not r["rule"]]
    groups: list[list[dict]] = []
    for r in rules:
        g = next((g for g in groups if abs(g[0]["x0"] - r["x0"]) <= 3 and abs(g[0]["x1"] - r["x1"]) <= 3), None)
        groups.append([r]) if g is None else g.append(r)
    out, n = [], 0
    for g in (part for group in groups if len(group) > 1 for part in _parted(group, spans)):
        x0, x1, y0, y1 = g[0]["x0"], g[0]["x1"], g[0]["top"], g[-1]["top"]
        if len(g) < 2 or y1 - y0 < 10:
            continue
        inside = [s for s in spans if y0 < (s["top"] + s["bottom"]) / 2 < y1 and x0 - 2 < (s["x0"] + s["x1"]) / 2 < x1 + 2]
        if len(inside) < 4:
            continue
        bands: list[list[float]] = []
        for a, b in sorted((s["x0"], s["x1"]) for s in inside):
            if bands and a <= bands[-1][1] + 4:
                bands[-1][1] = max(bands[-1][1], b)
            else:
                bands.append([a, b])
        if not 2 <= len(bands) <= 12:
            continue
        borders = [(a[1] + b[0]) / 2 for a, b in zip(bands, bands[1:], strict=False)]
        row, cells, last = 0, {}, None
        for s in sorted(inside, key=lambda s: (s["top"], s["x0"], s["elem"])):
            k = bisect_right(borders, (s["x0"] + s["x1"]) / 2)
            if k == 0 and s["top"] != last:  # text in the first column begins a row
                row, last = row + 1, s["top"]
            row = max(row, 1)
            cells.setdefault((row, k + 1), []).append(s["text"])
        if sum(v >= 2 for v in Counter(r for r, _ in cells).values()) >= 2:
            n += 1
            out += [(n, r, c, " ".join(t)) for (r, c), t in sorted(cells.items())]
    return out


def booktabs(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Cells of tables that have horizontal rules of one extent and no vertical ones: columns by the gaps between texts, rows by texts in the first column. Rules
    of one extent with a caption or prose between them belong to different tables. Pages with fewer than two rules or four texts don't leave Spark."""
    text = spans.select(*PAGE, F.lit(False).alias("rule"), F.col("elem").cast("long").alias("elem"), (F.col("size") if "size" in spans.columns else F.col("bottom") - F.col("top")).alias("size"), F.coalesce("text", F.lit("")).alias("text"), "x0", "x1", "top", "bottom")
    rules = merged_rules(segments).filter("horizontal").select(*PAGE, F.lit(True).alias("rule"), F.lit(-1).cast("long").alias("elem"), F.lit(0.0).alias("size"), F.lit("").alias("text"), F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("at").alias("top"), F.col("at").alias("bottom"))
    w = Window.partitionBy(*PAGE)
    of = lambda rule: F.count_if(F.col("rule") == F.lit(rule)).over(w)
    both = text.unionByName(rules).dropna(subset=PAGE).withColumn("enough", (of(True) >= 2) & (of(False) >= 4))
    return _by_page(both.filter("enough").drop("enough"), _booktabs, "tab int, r int, c int, text string")


def decorations(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans that a horizontal rule underlines or strikes through; a rule that stands out over the text on either side is a line of its own and marks none."""
    h = merged_rules(segments).filter("horizontal").select(*PAGE, "at", "a", "b")
    over = F.least("b", "x1") - F.greatest("a", "x0")
    under = (F.col("at") >= F.col("bottom") - 0.5) & (F.col("at") <= F.col("bottom") + 0.3 * F.col("size"))
    strike = (F.col("at") < F.col("bottom") - 0.15 * F.col("size")) & (F.col("at") > F.col("bottom") - 0.45 * F.col("size"))
    kind = F.when(under, "underline").when(strike, "strike")
    met = spans.join(h, PAGE).filter(over >= 0.5 * (F.col("x1") - F.col("x0"))).withColumn("kind", kind).filter("kind IS NOT NULL")
    w = Window.partitionBy(*PAGE, "at", "a", "b")
    out = F.greatest(F.min("x0").over(w) - F.col("a"), F.col("b") - F.max("x1").over(w))
    return met.withColumn("out", out).withColumn("most", F.max("size").over(w)).filter("out <= greatest(2.0D, 0.6D * most)").select(*PAGE, "elem", "kind").distinct()


def clusters(boxes: list[dict], gap: float = 6.0) -> list[tuple[list[float], list[dict]]]:
    """Boxes of one page that grow together while any two are within ``gap``: the box around, and those in it."""
    groups = [([b["x0"], b["y0"], b["x1"], b["y1"]], [b]) for b in sorted(boxes, key=lambda b: (b["y0"], b["x0"]))]
    changed = True
    while changed:
        changed, out = False, []
        for box, held in groups:
            hit = next((g for g in out if box[0] <= g[0][2] + gap and g[0][0] <= box[2] + gap and box[1] <= g[0][3] + gap and g[0][1] <= box[3] + gap), None)
            if hit is None:
                out.append((box, held))
            else:
                hit[0][:] = [min(hit[0][0], box[0]), min(hit[0][1], box[1]), max(hit[0][2], box[2]), max(hit[0][3], box[3])]
                hit[1].extend(held)
                changed = True
        groups = out
    return groups


def is_figure(box, held: list[dict]) -> bool:
    """Curves, colours or annotated images make a figure of boxes that stand together."""
    w, h = box[2] - box[0], box[3] - box[1]
    curvy, coloured, images = (sum(b[k] for b in held) for k in ("curvy", "coloured", "image"))
    paths = len(held) - images
    return w >= 24 and h >= 14 and w * h <= 0.85 * held[0]["area"] and bool(curvy >= 2 or curvy and paths >= 3 or coloured >= 2 or images and paths >= 3)


def _figures(boxes: list[dict]) -> list[tuple]:
    """(figure, x0, y0, x1, y1, paths) of one page."""
    found = [(box, held) for box, held in clusters(boxes) if is_figure(box, held)]
    return [(k, *box, sum(not b["image"] for b in held)) for k, (box, held) in enumerate(found, 1)]


def figures(boxes: DataFrame) -> DataFrame:
    """Figures among a page's boxes (x0, y0, x1, y1, curvy, coloured, image as 0 or 1, area of the page)."""
    return _by_page(boxes, _figures, "figure int, x0 double, y0 double, x1 double, y1 double, paths int")


def equations(lines: DataFrame) -> DataFrame:
    """Display equations among lines (doc_id, page, elem, text, x0, x1, top, rx0, rx1: the column's edges): runs of lines with a relation and no prose, or short indented fragments,
    of which one is numbered or indented with a relation. First and last line, whether numbered."""
    words = F.size(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: x.rlike("^[a-z]{4,}$")))
    indented, numbered = F.col("x0") - F.col("rx0") > 0.06 * (F.col("rx1") - F.col("rx0")), F.col("text").rlike(EQUATION_NUMBER)
    strong = F.col("text").rlike(RELATION) & (words == 0) & (indented | numbered)
    fragment = (F.length(F.regexp_replace("text", r"\s", "")) <= 12) & (words == 0) & indented
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "elem")
    s = lines.select(*PAGE, "elem", "top", "x0", strong.alias("strong"), (strong | fragment).alias("cand"), numbered.alias("numbered"), (strong & (indented | numbered)).alias("sure"))
    runs = s.withColumn("run", F.sum(F.when(F.col("cand") & F.coalesce(F.lag("cand").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("cand")
    g = runs.groupBy(*PAGE, "run").agg(F.min("elem").alias("first"), F.max("elem").alias("last"), F.bool_or("numbered").alias("numbered"), F.bool_or("sure").alias("sure"))
    return g.filter("sure").select(*PAGE, "first", "last", "numbered")


def header_set(spans: DataFrame, offset: DataFrame, top: float = 80.0) -> DataFrame:
    """The header of a document's first, odd and even pages: its most frequent lines above ``top``, the printed page number (page plus the document's shift) as a field."""
    s = spans.filter(F.col("top") <= top).join(offset.select("doc_id", "shift"), "doc_id", "left")
    printed = (F.col("page") + F.col("shift")).cast("string")
    line = F.when(F.col("shift").isNotNull(), F.regexp_replace("text", F.concat(F.lit(r"\b"), printed, F.lit(r"\b")), F.lit("{PAGE}"))).otherwise(F.col("text"))
    kind = F.when(F.col("page") == 1, "first").when(F.col("page") % 2 == 1, "odd").otherwise("even")
    each = s.select("doc_id", "page", kind.alias("kind"), F.struct("top", "x0", line.alias("line")).alias("l")).groupBy("doc_id", "kind", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("header"))
    n = each.groupBy("doc_id", "kind", "header").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("p"))
    return n.groupBy("doc_id", "kind").agg(F.min_by("header", F.struct(-F.col("n"), F.col("p"))).alias("header"), F.max("n").alias("pages"))


def grid_spacing(paras: DataFrame) -> DataFrame:
    """Space before and after paragraphs (before, after, content height, line height, pitch) so that each takes whole lines of the baseline grid."""
    total, p = F.col("before") + F.col("after"), F.col("pitch")
    k = F.floor(total / p + 0.5)
    on_grid = F.abs(F.col("line_height") - p) < 0.3
    keep = on_grid & (F.abs(total - k * p) < 0.05)
    after1 = F.least("after", k * p)
    h = F.floor((F.col("before") + F.col("content") + F.col("after")) / p + 0.5) * p
    height = F.when(h < F.col("content"), F.ceil(F.col("content") / p) * p).otherwise(h)
    b0 = height - F.col("content") - F.col("after")
    after2 = F.greatest(F.when(b0 < 0, F.col("after") + b0).otherwise(F.col("after")), F.lit(0.0))
    before = F.when(keep, F.col("before")).when(on_grid, k * p - after1).otherwise(F.greatest(b0, F.lit(0.0)))
    return paras.select("id", F.round(before, 4).alias("before"), F.round(F.when(keep, F.col("after")).when(on_grid, after1).otherwise(after2), 4).alias("after"))


def float_pages(words: DataFrame, refs: DataFrame, part: float = 0.35) -> DataFrame:
    """The page for a wide float: that of the word that refers to it (doc_id, page, line) if fewer than ``part`` of the page's words come before, else the next; never the first,
    and no page beyond the last."""
    pages = words.groupBy("doc_id").agg(F.max("page").alias("pages"))
    r = refs.select("doc_id", "ref", F.col("page").alias("p"), F.col("line").alias("l"))
    here = words.join(r, "doc_id").filter(F.col("page") == F.col("p")).groupBy("doc_id", "ref", "p").agg((F.count_if(F.col("line") < F.col("l")) / F.count(F.lit(1))).alias("share"))
    want = F.greatest(F.when((F.col("p") > 1) & (F.col("share") < part), F.col("p")).otherwise(F.col("p") + 1), F.lit(2))
    return here.join(pages, "doc_id").select("doc_id", "ref", F.when(want > F.col("pages"), F.greatest(F.lit(2), F.col("p"))).otherwise(want).cast("int").alias("page"))


def pitches(spans: DataFrame, least: int = 8, mass: float = 0.4) -> DataFrame:
    """The dominant distance between lines of one size: from each line to the nearest below it of that size and left edge, the half-point bin with most neighbours; sizes with fewer
    than ``least`` distances or under ``mass`` of them near the bin have none. The upper median of the distances within 0.75 of it."""
    w = Window.partitionBy("doc_id", "page", "size", F.floor("x0")).orderBy("top")
    d = spans.select("doc_id", "size", (F.lead("top").over(w) - F.col("top")).alias("d")).filter((F.col("d") > 0) & (F.col("d") >= 0.9 * F.col("size")) & (F.col("d") <= 3.5 * F.col("size")))
    size = Window.partitionBy("doc_id", "size")
    by = d.groupBy("doc_id", "size", F.floor(F.col("d") * 2 + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    scored = by.withColumn("near", F.sum("n").over(size.orderBy("bin").rangeBetween(-1, 1))).withColumn("pairs", F.sum("n").over(size))
    best = scored.groupBy("doc_id", "size").agg(F.max_by(F.struct("bin", "near", "pairs"), F.struct(F.col("near"), -F.col("bin"))).alias("b")).select("doc_id", "size", "b.*").filter((F.col("pairs") >= least) & (F.col("near") >= mass * F.col("pairs")))
    close = d.join(best, ["doc_id", "size"]).filter(F.abs(F.col("d") - F.col("bin") / 2) <= 0.75).groupBy("doc_id", "size", "pairs", "d").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(size.orderBy("d"))
    mid = close.withColumn("upto", upto).withColumn("half", F.floor(F.sum("n").over(size) / 2)).filter("upto > half")
    return mid.groupBy("doc_id", "size", "pairs").agg(F.min("d").alias("pitch")).select("doc_id", "size", "pitch", "pairs")


def _running(rows: list[dict]) -> list[tuple]:
    """(elem, page) of the lines of one text that stand at one height (within 3 points of the first) on enough pages."""
    rows = sorted(rows, key=lambda r: r["bottom"])
    out, s = [], 0
    while s < len(rows):
        e = s
        while e < len(rows) and rows[e]["bottom"] - rows[s]["bottom"] <= 3:
            e += 1
        grp, s = rows[s:e], e
        pages = {r["page"] for r in grp}
        numbers = [list(map(int, re.findall("[0-9]{1,9}", r["text"]))) for r in grp]
        counter = False
        for j in range(min(map(len, numbers))):
            shifts: dict = {}
            for r, n in zip(grp, numbers, strict=True):
                shifts[n[j] - r["page"]] = shifts.get(n[j] - r["page"], 0) + 1
            counter |= max(shifts.values()) >= max(2, 0.8 * len(grp)) and len({n[j] for n in numbers}) >= 2
        if len(pages) >= 2 and (counter or len(pages) >= max(2, 0.4 * rows[0]["pages"])):
            out += [(r["page"], r["elem"]) for r in grp]
    return out


def running_lines(spans: DataFrame, height: float = 792.0) -> DataFrame:
    """Headers and footers: lines in the top or bottom fifth of a page whose text, digits made alike, stands at one height on two pages at least, as a page counter or on 40 % of
    the document's pages."""
    pages = spans.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    norm = F.trim(F.regexp_replace(F.regexp_replace("text", "[0-9]+", "#"), r"\s+", " "))
    s = spans.filter((F.col("top") >= 0.8 * height) | (F.col("bottom") <= 0.2 * height)).select(*PAGE, "elem", "text", "bottom", norm.alias("norm")).filter("norm <> ''").join(pages, "doc_id")
    many = s.groupBy("doc_id", "norm").agg(F.countDistinct("page").alias("k")).filter("k >= 2")
    kind = spans.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        found = _running(t.to_pylist())
        return pa.table({"doc_id": pa.array([t.column("doc_id")[0].as_py()] * len(found), t.schema.field("doc_id").type), "page": pa.array([f[0] for f in found], pa.int32()), "elem": pa.array([f[1] for f in found], pa.int32())})

    return s.join(many.select("doc_id", "norm"), ["doc_id", "norm"], "left_semi").groupBy("doc_id", "norm").applyInArrow(run, f"doc_id {kind}, page int, elem int")


def uneven_pages(spans: DataFrame, gutter: DataFrame, pitch: float = 12.0, bottom: float = 740.0) -> DataFrame:
    """Pages of two columns whose ends differ by more than 0.6 lines while the longer one reaches the last two lines of the body; a document's last page isn't judged."""
    last = spans.groupBy("doc_id").agg(F.max("page").alias("last"))
    s = spans.filter(F.col("bottom") <= bottom).join(gutter.select(*PAGE, "x"), PAGE)
    mid = (F.col("x0") + F.col("x1")) / 2
    side = F.when((F.col("x0") < F.col("x") - 2) & (F.col("x1") > F.col("x") + 2), "F").when(mid < F.col("x"), "L").otherwise("R")
    g = s.groupBy(*PAGE).agg(F.max(F.when(side == "L", F.col("bottom"))).alias("l"), F.max(F.when(side == "R", F.col("bottom"))).alias("r")).join(last, "doc_id").filter("page < last")
    odd = (F.abs(F.col("l") - F.col("r")) > 0.6 * pitch) & (F.greatest("l", "r") > bottom - 2 * pitch)
    return g.select(*PAGE, F.col("l").alias("left_end"), F.col("r").alias("right_end"), F.coalesce(odd, F.lit(False)).alias("uneven"))


def _sentences(items: list[dict]) -> list[tuple]:
    """(paragraph, text) of one page's text items in reading order: lines by height, paragraphs by gaps."""
    lines, cur = [], None
    for it in sorted(items, key=lambda i: i["pos"]):
        if cur is None or abs(cur[0] - it["y"]) > max(2, (it["h"] or cur[1]) * 0.5):
            cur = [it["y"], it["h"] or 10, ""]
            lines.append(cur)
        cur[2] += it["text"]
        if it["eol"]:
            cur = None
    paras, last = [], None
    for y, h, text in lines:
        if not text.strip():
            continue
        if last is not None and not (last[0] - y > last[1] * 1.8 or last[0] < y):
            paras[-1] += ("" if paras[-1].endswith("-") else " ") + text.strip()
        else:
            paras.append(text.strip())
        last = (y, h)
    return [(k, t) for k, t in enumerate(paras, 1)]


def page_texts(items: DataFrame) -> DataFrame:
    """Paragraphs of pages given as text items (doc_id, page, pos, text, y upwards, h, eol)."""
    return _by_page(items, _sentences, "para int, text string")
