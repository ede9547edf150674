"""Statistics and geometry of page layouts: modes, medians, intervals, clusters, cells, columns, components."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dominant_edge(rows: DataFrame, key: str, value: str, largest: bool = True) -> DataFrame:
    """The outermost 0.5-wide bin whose count, with its neighbours', reaches max(3, 15 %) of the key's rows; else the raw extreme. NULL values are ignored."""
    b = rows.select(key, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    bins = b.groupBy(key, F.floor(F.col("v") * 2 + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    near = Window.partitionBy(key).orderBy("bin").rangeBetween(-1, 1)
    whole = Window.partitionBy(key)
    scored = bins.withColumn("score", F.sum("n").over(near)).withColumn("total", F.sum("n").over(whole))
    ok = F.col("score") >= F.greatest(F.lit(3), F.ceil(F.col("total") * 0.15))
    edge = F.max if largest else F.min
    raw = F.max("hi") if largest else F.min("lo")
    return scored.groupBy(key).agg(F.coalesce(edge(F.when(ok, F.col("bin"))) / 2, raw).alias("edge"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The element at floor(n / 2) of the sorted values, per key; rows without a key or a value take no part.

    A sketch of each key's quantiles brackets the middle (its error is a ten-thousandth of the rows, the bracket a hundredth); what lies below is only counted, and the
    few values inside are ranked, so no task sorts a key's values. Both passes aggregate before they shuffle.
    """
    v = rows.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, F.col(value).alias("v"))
    bracket = v.groupBy(key).agg(F.percentile_approx("v", [0.495, 0.505], 10_000).alias("q"), F.floor(F.count(F.lit(1)) / 2).alias("at")).select(key, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "at")
    near = v.join(bracket, key).filter("v <= high").groupBy(key, "at", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("upto", upto).filter("upto > at").groupBy(key).agg(F.min("v").alias("median"))


def weighted_mode(rows: DataFrame, key: str, value: str, weight: Column, order: Column) -> DataFrame:
    """The value with the greatest weight; of equal ones the one seen first."""
    by = rows.groupBy(key, value).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    return by.groupBy(key).agg(F.max_by(value, F.struct(F.col("w"), -F.col("first"))).alias("mode"), F.max("w").alias("weight"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages of each document as "1–5、8"."""
    w = Window.partitionBy("doc_id").orderBy("page")
    runs = pages.distinct().withColumn("run", F.col("page") - F.row_number().over(w)).groupBy("doc_id", "run").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    each = F.struct("a", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a"), F.lit("–"), F.col("b"))).alias("s"))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["s"]), "、").alias("ranges"))


def _bounded(digits: Column) -> Column:
    """A whole number of any length as an int, at most the greatest one; NULL for no digits."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(short) > 9, F.lit(2**31 - 1)).when(digits != "", F.coalesce(short.try_cast("int"), F.lit(0)))


def parsed_ranges(specs: DataFrame) -> DataFrame:
    """The pages that a specification names: "1-20", "1-5,8", "30-", "-3", 第3至5页, 前4, full-width digits and signs; none where a part is malformed or all are out of range."""
    flat = F.regexp_replace(F.translate("spec", "０１２３４５６７８９–—－~～至到，、;；", "0123456789" + "-" * 7 + "," * 4), "[第页頁\\s]", "")
    parts = F.filter(F.split(F.regexp_replace(flat, r"前(\d+)", "1-$1"), ","), lambda x: x != "")
    p = specs.select("doc_id", "total", parts.alias("parts")).filter(F.forall("parts", lambda x: x.rlike(r"^(\d+|\d+-\d*|-\d+)$"))).select("doc_id", "total", F.explode("parts").alias("part"))
    a, b = (_bounded(F.regexp_extract("part", p, 1)) for p in (r"^(\d+)", r"(\d+)$"))
    lo, hi = F.coalesce(a, F.lit(1)), F.when(F.col("part").endswith("-"), F.col("total")).otherwise(b)
    r = p.select("doc_id", F.greatest(F.least(lo, hi), F.lit(1)).alias("lo"), F.least(F.greatest(lo, hi), F.col("total")).alias("hi")).filter("lo <= hi")
    return r.select("doc_id", F.explode(F.sequence("lo", "hi")).alias("page")).distinct()


def merged_intervals(rows: DataFrame, key: str = "line", tol: float = 1.0) -> DataFrame:
    """Intervals that overlap or lie within ``tol`` of each other as one."""
    w = Window.partitionBy(key).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("x0") > reach + tol), 1).otherwise(0)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(key, "x0", "x1")


def centroids(rows: DataFrame, key: str = "axis", tol: float = 2.0) -> DataFrame:
    """Means of groups of values whose neighbours lie within ``tol``."""
    w = Window.partitionBy(key).orderBy("v")
    gap = F.when(F.col("v") - F.lag("v").over(w) > tol, 1).otherwise(0)
    runs = rows.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.round(F.avg("v"), 6).alias("centre"), F.count(F.lit(1)).alias("n")).select(key, "centre", "n")


def cell_texts(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Each span with the cell of its page that holds its centre, NULL outside all; the page is the join key, so the range part stays local to it."""
    s = spans.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("top") + F.col("bottom")) / 2).select("doc_id", "page", "elem", "cx", "cy")
    c = cells.select("doc_id", "page", "cell", "x0", "x1", "y0", "y1").alias("c")
    inside = (F.col("s.doc_id") == F.col("c.doc_id")) & (F.col("s.page") == F.col("c.page")) & (F.col("cx") >= F.col("c.x0")) & (F.col("cx") < F.col("c.x1")) & (F.col("cy") >= F.col("c.y0")) & (F.col("cy") < F.col("c.y1"))
    return s.alias("s").join(c, inside, "left").select("s.doc_id", "s.page", "elem", "cell")


def merged_rules(segments: DataFrame, tol: float = 1.5) -> DataFrame:
    """Segments of one direction that lie on one line (within half a point) and overlap or nearly meet, as one: horizontal, at (their place), a, b (from, to)."""
    level = F.when(F.col("horizontal"), F.col("y0")).otherwise(F.col("x0"))
    ends = F.when(F.col("horizontal"), F.struct(F.col("x0").alias("a"), F.col("x1").alias("b"))).otherwise(F.struct(F.col("y0").alias("a"), F.col("y1").alias("b")))
    s = segments.select("doc_id", "page", "horizontal", (F.round(level * 2) / 2).alias("at"), F.least(ends["a"], ends["b"]).alias("a"), F.greatest(ends["a"], ends["b"]).alias("b"))
    w = Window.partitionBy("doc_id", "page", "horizontal", "at").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = s.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach + tol), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "page", "horizontal", "at", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def edge_coverage(cells: DataFrame, segments: DataFrame, tol: float = 2.0, part: float = 0.6) -> DataFrame:
    """How much of each cell's four edges merged segments within ``tol`` cover, and whether that makes a border."""
    edge = lambda side, horizontal, at, a, b: F.struct(F.lit(side).alias("edge"), F.lit(horizontal).alias("horizontal"), F.col(at).alias("level"), F.col(a).alias("lo"), F.col(b).alias("hi"))
    sides = F.explode(F.array(edge("top", True, "y0", "x0", "x1"), edge("bottom", True, "y1", "x0", "x1"), edge("left", False, "x0", "y0", "y1"), edge("right", False, "x1", "y0", "y1")))
    e = cells.select("doc_id", "page", "cell", sides.alias("e")).select("doc_id", "page", "cell", "e.*")
    over = F.greatest(F.least("hi", "b") - F.greatest("lo", "a"), F.lit(0.0))
    near = F.when(F.abs(F.col("at") - F.col("level")) <= tol, over).otherwise(0.0)
    got = e.join(merged_rules(segments), ["doc_id", "page", "horizontal"], "left").groupBy("doc_id", "page", "cell", "edge").agg(F.sum(F.coalesce(near, F.lit(0.0))).alias("len"), F.max(F.col("hi") - F.col("lo")).alias("width"))
    share = F.least(F.col("len") / F.col("width"), F.lit(1.0))
    return got.select("doc_id", "page", "cell", "edge", F.round(share, 6).alias("share"), (share >= part).alias("border"))


def gutters(spans: DataFrame) -> DataFrame:
    """The best place for a column gutter on each page: of the whole points in the middle 40 % of its text's width, the leftmost with the greatest min(left, right) - crossing.

    Left, right and crossing lines come from running counts of where lines end and begin, so a page's lines and places are each met once.
    """
    lines = spans.select("doc_id", "page", "x0", "x1")
    page = lines.groupBy("doc_id", "page").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.count(F.lit(1)).alias("n"))
    xs = page.select("doc_id", "page", F.explode(F.sequence(F.ceil(F.col("lo") + 0.3 * (F.col("hi") - F.col("lo"))), F.floor(F.col("lo") + 0.7 * (F.col("hi") - F.col("lo"))))).alias("x"), "n", F.lit(0).alias("ended"), F.lit(0).alias("begun"))
    xs = xs.filter("x IS NOT NULL")
    no = F.lit(None).cast("long").alias("n")
    events = lines.select("doc_id", "page", F.ceil("x1").alias("x"), no, F.lit(1).alias("ended"), F.lit(0).alias("begun")).unionByName(lines.select("doc_id", "page", (F.floor("x0") + 1).alias("x"), no, F.lit(0).alias("ended"), F.lit(1).alias("begun")))
    upto = Window.partitionBy("doc_id", "page").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    counted = xs.unionByName(events).withColumn("left", F.sum("ended").over(upto)).withColumn("begun", F.sum("begun").over(upto)).filter("n IS NOT NULL")
    right = F.col("n") - F.col("begun")
    scored = counted.select("doc_id", "page", "x", (F.least(F.col("left"), right) - (F.col("n") - F.col("left") - right)).alias("score"))
    return scored.groupBy("doc_id", "page").agg(F.max_by("x", F.struct(F.col("score"), -F.col("x"))).cast("int").alias("x"), F.max("score").alias("score"))


def _connected(segments: list[dict], tol: float = 2.5) -> list[int]:
    """The least segment that each of one page's segments is connected with: horizontal and vertical ones that meet within ``tol`` are linked."""
    root = {s["seg"]: s["seg"] for s in segments}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    upright = sorted((s for s in segments if s["horizontal"] is False and s["x0"] is not None), key=lambda s: s["x0"])
    places = [v["x0"] for v in upright]
    for h in segments:
        if h["horizontal"] and None not in (h["x0"], h["x1"], h["y0"]):
            for v in upright[bisect_left(places, h["x0"] - tol) : bisect_right(places, h["x1"] + tol)]:
                if v["y0"] is not None and v["y1"] is not None and h["y0"] >= v["y0"] - tol and h["y0"] <= v["y1"] + tol:
                    x, y = find(h["seg"]), find(v["seg"])
                    root[max(x, y)] = min(x, y)
    return [find(s["seg"]) for s in segments]


def with_components(segments: DataFrame) -> DataFrame:
    """``segment_components`` with the segments' own columns: page by page in one pass, after one shuffle."""
    from quire.operators.pages import _by_page

    cols = [c for c in segments.columns if c not in ("doc_id", "page")]
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}

    def run(page: list[dict]) -> list[tuple]:
        return [(*(s[c] for c in cols), r) for s, r in zip(page, _connected(page), strict=True)]

    return _by_page(segments.dropna(subset=["doc_id", "page", "seg"]), run, ", ".join(f"{c} {kinds[c]}" for c in cols) + f", root {kinds['seg']}")


def segment_components(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """The least segment that each segment's page connects it with, however long the way; the segments of one page are one group."""
    from quire.operators.pages import _by_page

    kind = segments.schema["seg"].dataType.simpleString()
    s = segments.select("doc_id", "page", "seg", "x0", "y0", "x1", "y1", "horizontal").dropna(subset=["doc_id", "page", "seg"])
    return _by_page(s, lambda page: sorted(set(zip((s["seg"] for s in page), _connected(page), strict=True))), f"seg {kind}, root {kind}")


def longest_paths(edges: list[tuple[str, str]]) -> dict[str, int]:
    """The longest path from a source to each node; edges that close a cycle (met in the given order, depth first) are ignored."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    state, done, kept = dict.fromkeys(after, 0), [], []
    for start in after:
        if state[start]:
            continue
        state[start] = 1
        stack = [(start, iter(after[start]))]
        while stack:
            n, rest = stack[-1]
            for m in rest:
                if state[m] == 1:
                    continue  # a back edge
                kept.append((n, m))
                if not state[m]:
                    state[m] = 1
                    stack.append((m, iter(after[m])))
                    break
            else:
                state[n] = 2
                done.append(n)
                stack.pop()
    onward: dict = {}
    for a, b in kept:
        onward.setdefault(a, []).append(b)
    level = dict.fromkeys(after, 0)
    for n in reversed(done):  # sources first
        for m in onward.get(n, ()):
            level[m] = max(level[m], level[n] + 1)
    return level


def diagram_levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Longest path from a source to each node of each graph, back edges ignored; a diagram is one group."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        level = longest_paths(list(zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True)))
        return pa.table({"graph": t.column("graph").combine_chunks().take([0] * len(level)), "node": pa.array(level, t.schema.field("src").type), "level": pa.array(level.values(), pa.int32())})

    return edges.groupBy("graph").applyInArrow(run, f"graph {kinds['graph']}, node {kinds['src']}, level int")


def repeated_lines(lines: DataFrame, holder: str = "doc_id", least: int = 2) -> DataFrame:
    """Lines, with digits made alike, that at least ``least`` holders share."""
    norm = F.regexp_replace(F.trim("line"), "[0-9]+", "#")
    return lines.select(holder, norm.alias("line")).filter("line <> ''").groupBy("line").agg(F.countDistinct(holder).alias("holders"), F.count(F.lit(1)).alias("n")).filter(F.col("holders") >= least)


def page_counters(spans: DataFrame, least: float = 0.8) -> DataFrame:
    """Numbers in lines that follow the page: text with digits made alike, position of the number, its offset to the page, pages that agree."""
    nums = spans.select("doc_id", "page", F.regexp_replace("text", "[0-9]+", "#").alias("norm"), F.posexplode(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("pos", "n"))
    by = nums.groupBy("doc_id", "norm", "pos", (F.col("n").try_cast("long") - F.col("page")).alias("shift")).agg(F.countDistinct("page").alias("pages"), F.countDistinct("n").alias("numbers"))
    total = spans.groupBy("doc_id").agg(F.countDistinct("page").alias("total"))
    return by.join(total, "doc_id").filter((F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("total") * least))) & (F.col("numbers") >= 2)).select("doc_id", "norm", "pos", "shift", "pages")


def line_pitch(spans: DataFrame) -> DataFrame:
    """The most frequent distance to the next line below with the same size and left edge, in bins of half a point, by size."""
    w = Window.partitionBy("doc_id", "page", "size", F.floor("x0")).orderBy("top")
    d = spans.withColumn("d", F.lead("top").over(w) - F.col("top")).filter("d > 0").withColumn("bin", F.floor(F.col("d") * 2 + 0.5) / 2)
    by = d.groupBy("doc_id", "size", "bin").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("doc_id", "size").agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("pitch"), F.sum("n").alias("pairs"))


def page_backgrounds(fills: DataFrame) -> DataFrame:
    """Fills of at least 85 % of a page's width and height."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    return fills.filter((w >= 0.85 * F.col("width")) & (h >= 0.85 * F.col("height")) & (w * h >= 0.7 * F.col("width") * F.col("height"))).select("doc_id", "page", "fill", "color")


def highlights(spans: DataFrame, fills: DataFrame) -> DataFrame:
    """The colour that covers at least half of each span's width, from fills of a line's height over its centre."""
    f = fills.filter("bottom - top <= 40 AND x1 - x0 <= 0.9 * width").select("doc_id", "page", F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("top").alias("t"), F.col("bottom").alias("u"), "color")
    mid = (F.col("top") + F.col("bottom")) / 2
    met = spans.join(f, ["doc_id", "page"]).filter((mid >= F.col("t")) & (mid <= F.col("u")) & ((F.col("u") - F.col("t")) / F.col("size")).between(0.6, 2.6))
    over = met.groupBy("doc_id", "page", "elem", "color").agg(F.sum(F.greatest(F.least("x1", "b") - F.greatest("x0", "a"), F.lit(0.0))).alias("over"), F.max(F.col("x1") - F.col("x0")).alias("w"))
    return over.filter("over >= 0.5 * w").groupBy("doc_id", "page", "elem").agg(F.max_by("color", F.struct("over", "color")).alias("color"))


def page_offset(spans: DataFrame) -> DataFrame:
    """The difference between printed and actual page number on which most pages agree, at least two and half of them; of equal ones the least."""
    nums = spans.select("doc_id", "page", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("n"))
    by = nums.groupBy("doc_id", (F.col("n").try_cast("long") - F.col("page")).alias("shift")).agg(F.countDistinct("page").alias("pages"))
    best = by.groupBy("doc_id").agg(F.max_by("shift", F.struct(F.col("pages"), -F.col("shift"))).alias("shift"), F.max("pages").alias("pages"))
    total = spans.groupBy("doc_id").agg(F.countDistinct("page").alias("total"))
    return best.join(total, "doc_id").filter((F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("total") / 2)))).select("doc_id", "shift", "pages")


def header_signatures(spans: DataFrame, top: float = 80.0) -> DataFrame:
    """The most repeated line above ``top`` of odd and of even pages, digits made alike; of equal ones the first."""
    head = spans.filter(F.col("top") <= top).select("doc_id", (F.col("page") % 2).alias("odd"), F.regexp_replace("text", "[0-9]+", "#").alias("line"))
    by = head.groupBy("doc_id", "odd", "line").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("doc_id", "odd").agg(F.min_by("line", F.struct(-F.col("n"), F.col("line"))).alias("line"), F.max("n").alias("n"))


def zones(spans: DataFrame, gutter: DataFrame) -> DataFrame:
    """Runs of lines that cross their page's gutter (doc_id, page, x; none: one column) and of lines beside it, from the top of each page down."""
    w = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    full = F.coalesce((F.col("x0") < F.col("x")) & (F.col("x1") > F.col("x")), F.lit(True))
    s = spans.join(gutter.select("doc_id", "page", "x"), ["doc_id", "page"], "left").select("doc_id", "page", "top", "x0", "bottom", full.alias("full"))
    run = s.withColumn("new", F.when(F.col("full") == F.lag("full").over(w), 0).otherwise(1)).withColumn("zone", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "page", "zone").agg(F.first("full").alias("full"), F.count(F.lit(1)).alias("lines"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def local_right_edges(spans: DataFrame, around: int = 4, tol: float = 1.5, least: int = 3) -> DataFrame:
    """For each line the right edge of its neighbourhood of the same left edge, where enough neighbours agree with it; else NULL."""
    w = Window.partitionBy("doc_id", "page", F.floor("x0")).orderBy("top").rowsBetween(-around, around)
    edges = F.collect_list("x1").over(w)
    near = spans.select("doc_id", "page", "elem", edges.alias("e")).withColumn("m", F.array_max("e"))
    agree = F.size(F.filter("e", lambda x: x >= F.col("m") - tol))
    return near.select("doc_id", "page", "elem", F.when(agree >= least, F.col("m")).alias("edge"))


def estimated_pages(blocks: DataFrame, per_page: int = 3000, breaks: Column | None = None, most: int = 50) -> DataFrame:
    """The page that each block begins on, from the characters before it since the last page break (``breaks``: blocks before which a page ends); only the first ``most`` pages."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    b = blocks.withColumn("cut", F.coalesce(breaks, F.lit(False)).cast("int") if breaks is not None else F.lit(0)).withColumn("part", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("doc_id", "part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    inner = b.select("doc_id", "ordinal", "part", F.floor(F.coalesce(F.sum(F.length("text")).over(own), F.lit(0)) / per_page).alias("p"))
    size = inner.groupBy("doc_id", "part").agg((F.max("p") + 1).alias("k"))
    first = size.select("doc_id", "part", F.coalesce(F.sum("k").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    page = (F.col("first") + F.col("p") + 1).cast("int")
    return inner.join(first, ["doc_id", "part"]).select("doc_id", "ordinal", page.alias("page")).filter(F.col("page") <= most)


def images_by_row(images: DataFrame, spans: DataFrame) -> DataFrame:
    """The text next to each image of a page: the span whose middle is nearest in height, of equal ones the first."""
    mid = F.abs((F.col("top") + F.col("bottom")) / 2 - F.col("cy"))
    i = images.select("doc_id", "page", "image", ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return i.join(spans, ["doc_id", "page"]).groupBy("doc_id", "page", "image").agg(F.min_by("elem", F.struct(mid, "elem")).alias("elem"))


def page_counts(spans: DataFrame, gutter: DataFrame) -> DataFrame:
    """Pages, pages of two columns (gutter score of four lines or more), lines and heading-sized lines of each document."""
    cols = gutter.filter("score >= 4").groupBy("doc_id").agg(F.count(F.lit(1)).alias("column_pages"))
    g = spans.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("lines"), F.count_if((F.col("size") > 10) | F.col("bold")).alias("headings"))
    return g.join(cols, "doc_id", "left").select("doc_id", "pages", F.coalesce("column_pages", F.lit(0)).alias("column_pages"), "lines", "headings")


def char_spacing(samples: DataFrame, key: str, extra: str, least: float = 0.03) -> DataFrame:
    """The spacing of each font (column ``key``) from measured extra widths a character: their upper median in steps of 0.05, which may be negative, for fonts with two samples or more
    and a median of note."""
    n = samples.filter(F.col(extra).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return upper_median(samples, key, extra).join(n, key).filter(F.abs("median") >= least).select(key, F.round(F.floor(F.col("median") * 20 + 0.5) / 20, 2).alias("spacing"), "n")


#: Fixed values, a part of a longer list that must match, in its order: how families begin, and what they are replaced by.
FAMILIES = {"times|tmsrm|nimbusrom|ptmr|tirom": "Times New Roman", "helvetica|helv|arial|phvr|formata|frutiger|univers|myriad|futura": "Arial", "minion|giovanni|utopia|charter|caslon|sabon": "Times New Roman", "courier|mono|lucidatypewriter|inconsolata|menlo": "Courier New"}


def font_parts(fonts: DataFrame) -> DataFrame:
    """Family, bold and italic of font names: subset prefixes and style suffixes are taken off, and known families are named by a common one."""
    base = F.regexp_replace("font", r"^[A-Z]{6}\+", "")
    family = F.regexp_replace(base, r"(?:PS)?[-,]?(?:BoldItalic|BoldOblique|Bold|Italic|Oblique)?(?:MT)?$", "")
    common = family
    for begin, name in FAMILIES.items():
        common = F.when(F.regexp_replace(F.lower(family), r"[\s_]", "").rlike(f"^({begin})"), name).otherwise(common)
    return fonts.select("id", family.alias("family"), common.alias("common"), base.rlike("Bold").alias("bold"), base.rlike("Italic|Oblique").alias("italic"))


def blank_pages(spans: DataFrame, top: float = 60.0, bottom: float = 780.0, most: float = 0.15) -> DataFrame:
    """The blank part below the last body line of each page, and whether it is too much."""
    low = spans.filter(F.col("bottom") <= 740).groupBy("doc_id", "page").agg(F.max("bottom").alias("low"))
    share = (bottom - F.col("low")) / (bottom - top)
    return low.select("doc_id", "page", F.round(share, 6).alias("blank"), (share > most).alias("too_blank"))


def fill_cells(cells: DataFrame, fills: DataFrame) -> DataFrame:
    """Each cell with the last fill that holds its centre, NULL for none."""
    f = fills.select("doc_id", "page", "fill", F.col("x0").alias("a"), F.col("x1").alias("b"), "top", "bottom", "color")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    met = cells.join(f, ["doc_id", "page"]).filter((cx >= F.col("a")) & (cx <= F.col("b")) & (cy >= F.col("top")) & (cy <= F.col("bottom")))
    return cells.select("doc_id", "page", "cell").join(met.groupBy("doc_id", "page", "cell").agg(F.max_by("color", "fill").alias("color")), ["doc_id", "page", "cell"], "left")


def heading_levels(spans: DataFrame, body: float = 10.0) -> DataFrame:
    """Levels 1 to 3 of each document's heading styles (size, weight, font): larger first, then bold; a style as frequent as body text (over max(3, 15 %)) is none."""
    style = ["doc_id", "size", "bold", "font"]
    s = spans.groupBy(*style).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("size") > body) | F.col("bold")).alias("c"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    valid = s.withColumn("total", total).filter((F.col("c") > 0) & (F.col("n") <= F.greatest(F.lit(3.0), F.col("total") * 0.15)))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("size").desc(), F.col("bold").desc(), "font"))
    return valid.select(*style, "n", F.least(F.lit(3), rank).alias("level"))
