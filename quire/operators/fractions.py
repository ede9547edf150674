"""Display equations with stacked fractions: rules joined with the lines over and under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.pages import EQUATION_NUMBER, PAGE, RELATION
from quire.sources.shared import shared_path

#: Names of operators, which are no prose, and operators drawn large.
NAMES = ("softmax", "concat", "argmax", "argmin", "sigmoid", "tanh", "relu", "mean", "clamp", "clip", "exp", "log", "max", "min", "sum", "where", "and", "for", "with", "head")
LARGE = "[∑∏∫∮⋃⋂]"
CJK = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{3000}-\x{303f}]"
#: A column of a page.
REGION = [*PAGE, "rx0", "rx1"]


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def line_signs(spans: DataFrame) -> DataFrame:
    """What speaks for an equation in each line: ``strong`` (mathematical fonts prevail, or a relation without prose), ``weak``, ``fragment`` (short and indented), ``only`` a number,
    ``numbered`` at the column's edge, ``indented``, ``large`` operators, ``rel``, characters in mathematical fonts (``math``)."""
    s = spans.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("formula", F.coalesce("math", F.lit(False)) & ~F.col("text").rlike(CJK))
    bare = F.length(F.regexp_replace("text", r"\s", ""))
    joined = lambda where, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("x0", "elem", "text")))), lambda x: x["text"]), sep)
    g = s.groupBy(*REGION, "line").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max_by("baseline", F.struct(bare, "x0")).alias("baseline"), F.max_by("size", F.struct(bare, "size")).alias("size"),
        F.sum(F.when(F.col("formula"), bare).otherwise(0)).alias("math"), F.trim(joined(F.lit(True), "")).alias("text"), joined(~F.col("formula"), " ").alias("prose"),
        F.count_if(F.col("italic") & F.trim("text").rlike("^[A-Za-z]{1,3}$")).alias("vars"), F.bool_or(F.col("formula") & F.col("text").rlike(LARGE)).alias("large"),
    )
    core = F.length(F.regexp_replace(F.regexp_replace("prose", EQUATION_NUMBER, ""), r"[\s.,;:()\[\]{}=+\-−–·×/|]", ""))
    english = F.size(F.filter(F.regexp_extract_all("prose", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: x.rlike("^[a-z]{4,}$") & ~x.isin(*NAMES)))
    width, inset = F.col("rx1") - F.col("rx0"), F.col("x0") - F.col("rx0")
    g = g.withColumns({"words": _count(F.col("prose"), "[A-Za-z]{4,}"), "english": english, "total": F.col("math") + core, "rel": F.col("text").rlike(RELATION), "only": F.col("text").rlike(r"^\(\s*\d{1,3}[a-z]?\s*\)$"), "indented": inset > 0.06 * width})
    g = g.withColumn("numbered", F.col("text").rlike(EQUATION_NUMBER) & (F.col("rx1") - F.col("x1") < 4))
    fonts = (F.col("math") >= 0.6 * F.col("total")) & ((F.col("words") == 0) | (F.col("words") <= 1) & F.col("indented"))
    signs = F.col("rel") & (F.col("numbered") | (inset > 0.04 * width)) & (F.col("english") == 0) & ((F.col("vars") >= 1) | F.col("numbered") | (F.col("math") >= 2)) & ~F.col("text").rlike(r"[.;,]\s+[A-Z][a-z]{3,}")
    g = g.withColumn("strong", ~F.col("only") & (F.col("total") > 0) & (fonts | signs))
    other = ~F.col("strong") & ~F.col("only")
    small = (F.col("total") <= 12) & (F.col("words") == 0) & F.col("indented")
    hint = F.col("rel") & (F.col("english") == 0) & (F.col("vars") >= 1) & (F.col("words") == 0) | F.col("numbered") & (F.col("english") == 0) & (F.col("words") <= 1) & (F.col("math") >= 3)
    return g.withColumns({"fragment": other & small, "weak": other & hint})


def fraction_parts(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines (doc_id, page, rx0, rx1, line) that stand over or under a bar with a line on its other side, or beside which such a bar is drawn at the height of a fraction in a line with a relation."""
    width = F.col("rx1") - F.col("rx0")
    bars = rules.filter("y1 - y0 < 1.5 AND x1 - x0 > 6").select(*PAGE, F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y0").alias("t"), F.col("y1").alias("u")).distinct()
    close = (F.col("baseline") > F.col("t") - 1.3 * F.col("size")) & (F.col("top") < F.col("u") + 1.3 * F.col("size")) & (F.col("x1") >= F.col("a") - 4) & (F.col("x0") <= F.col("b") + 4)
    inside = (F.col("b") - F.col("a") < 0.6 * width) & (F.col("a") >= F.col("rx0") - 3) & (F.col("b") <= F.col("rx1") + 3)
    m = lines.join(bars, PAGE).filter(close & inside)
    over = (F.col("bottom") <= F.col("t") + 2) & (F.col("baseline") > F.col("t") - 1.3 * F.col("size"))
    under = (F.col("top") >= F.col("u") - 2) & (F.col("top") < F.col("u") + 1.3 * F.col("size"))
    mid = ((F.col("x0") + F.col("x1")) / 2).between(F.col("a") - 2, F.col("b") + 2)
    w = Window.partitionBy(*REGION, "a", "b", "t", "u")
    m = m.withColumns({"over": over, "under": under, "above": (over & mid).cast("int"), "below": (under & mid).cast("int")})
    m = m.withColumns({"above": F.sum("above").over(w) - F.col("above"), "below": F.sum("below").over(w) - F.col("below")})
    main = (F.col("a") >= F.col("x0") - 2) & (F.col("b") <= F.col("x1") + 2) & (F.col("t") < F.col("baseline") - 0.1 * F.col("size")) & (F.col("t") > F.col("baseline") - 0.7 * F.col("size")) & F.col("rel")
    fits = (F.col("x0") >= F.col("a") - 4) & (F.col("x1") <= F.col("b") + 4) & (F.col("x1") - F.col("x0") <= 0.6 * width)
    part = F.when(main, (F.col("above") > 0) & (F.col("below") > 0)).otherwise(fits & F.when(F.col("over"), F.col("below") > 0).otherwise(F.col("under") & (F.col("above") > 0)))
    return m.filter(part).select(*REGION, "line").distinct()


def stacked_equations(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Display equations of each column: runs of lines that may belong to one (signs as in ``line_signs``, parts of a fraction), no more than 1.2 of their size apart. A strong line makes
    one if a line is numbered, indented or has a large operator, or a bar has text of the run over and under it; with such a bar weak lines make one too.

    ``spans``: doc_id, page, line, elem, text, x0, x1, top, bottom, baseline, size, math, italic (booleans), rx0, rx1 (the column's edges); ``rules``: doc_id, page, x0, y0, x1, y1.
    Returns doc_id, page, first and last line, numbered, fraction, and the box x0, y0, x1, y1, which ends before the neighbouring lines. Missing texts count as empty. The signs of
    all lines are written to the shared folder when the query is set up.
    """
    g = line_signs(spans)
    parts = fraction_parts(g, rules).withColumn("part", F.lit(True))
    cand = F.col("strong") | F.col("fragment") | F.col("only") | F.col("weak") | F.coalesce("part", F.lit(False))
    w = Window.partitionBy(*REGION).orderBy("top", "x0", "line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n = g.join(parts, [*REGION, "line"], "left").withColumns({"cand": cand, "at": F.row_number().over(w)}).withColumn("island", F.sum(F.when(F.col("cand"), 0).otherwise(1)).over(upto))
    # Signs are written once and read for runs, bars and neighbours, not computed for each.
    path = shared_path(spans.sparkSession, "equation-lines")
    n.select(*REGION, "line", "x0", "x1", "top", "bottom", "baseline", "size", "cand", "at", "island", "strong", "weak", "only", "numbered", "indented", "large", "rel", "math").write.parquet(path)
    n = spans.sparkSession.read.parquet(path)
    v = Window.partitionBy(*REGION, "island").orderBy("top", "x0", "line")
    # Where the gap counts, all earlier runs of the island end above: the greatest bottom before is that of the run.
    c = n.filter("cand").withColumn("deep", F.max("bottom").over(v.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("run", F.sum(F.when(F.col("deep").isNull() | (F.col("top") - F.col("deep") >= 1.2 * F.col("size")), 1).otherwise(0)).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    key = [*REGION, "island", "run"]
    of = c.select(*key, "line")
    bars = rules.filter("y1 - y0 < 1.5 AND x1 - x0 > 2").select(*PAGE, F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y0").alias("t"), F.col("y1").alias("u")).distinct()
    near = spans.join(of, [*REGION, "line"]).join(bars, PAGE).filter((F.col("x1") > F.col("a")) & (F.col("x0") < F.col("b")))
    over = (F.col("bottom") <= F.col("t") + 2) & (F.col("baseline") > F.col("t") - 1.2 * F.col("size"))
    under = (F.col("top") >= F.col("u") - 2) & (F.col("top") < F.col("u") + 1.2 * F.col("size"))
    stacked = near.groupBy(*key, "a", "b", "t", "u").agg(F.bool_or(over).alias("o"), F.bool_or(under).alias("n")).filter("o AND n").select(*key).distinct().withColumn("fraction", F.lit(True))
    e = c.groupBy(*key).agg(
        F.min_by("line", "at").alias("first"), F.max_by("line", "at").alias("last"), F.min("at").alias("p"), F.max("at").alias("q"), F.bool_or(F.col("numbered") | F.col("only")).alias("numbered"), F.bool_or("strong").alias("strong"),
        F.bool_or(F.col("numbered") | F.col("only") | F.col("large") | F.col("strong") & F.col("indented")).alias("sure"), F.bool_or(F.col("weak") | F.col("rel") & (F.col("math") >= 1)).alias("hint"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("y0"), F.max("bottom").alias("y1"),
    ).join(stacked, key, "left").withColumn("fraction", F.coalesce("fraction", F.lit(False)))
    e = e.filter("strong AND (fraction OR sure) OR fraction AND hint")
    held = e.join(bars, PAGE).filter((F.col("a") >= F.col("x0") - 3) & (F.col("b") <= F.col("x1") + 3) & (F.col("t") >= F.col("y0") - 4) & (F.col("u") <= F.col("y1") + 4))
    grown = held.groupBy(*key).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("t").alias("t"), F.max("u").alias("u"))
    e = e.join(grown, key, "left").withColumns({"x0": F.least("x0", "a"), "x1": F.greatest("x1", "b"), "y0": F.least("y0", "t"), "y1": F.greatest("y1", "u")}).drop("a", "b", "t", "u")
    others = n.select(*REGION, "at", F.col("x0").alias("a"), F.col("x1").alias("b"), "baseline", "size")
    by = e.join(others, REGION).filter(~F.col("at").between(F.col("p"), F.col("q")) & (F.col("b") > F.col("x0")) & (F.col("a") < F.col("x1")))
    limits = by.groupBy(*key).agg(
        F.max_by(F.when(F.col("at") < F.col("p"), F.col("baseline") + 0.28 * F.col("size")), F.when(F.col("at") < F.col("p"), F.col("at"))).alias("least"),
        F.min_by(F.when(F.col("at") > F.col("q"), F.col("baseline") - 0.8 * F.col("size")), F.when(F.col("at") > F.col("q"), F.col("at"))).alias("most"),
    )
    box = e.join(limits, key, "left").withColumns({"x0": F.greatest(F.col("x0") - 1.5, F.col("rx0") - 3), "x1": F.least(F.col("x1") + 1.5, F.col("rx1") + 3), "y0": F.greatest(F.col("y0") - 1.5, "least"), "y1": F.least(F.col("y1") + 1.5, "most")})
    return box.filter("y1 - y0 > 4").select(*PAGE, "first", "last", "numbered", "fraction", "x0", "y0", "x1", "y1")
