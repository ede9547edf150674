"""Tab stops and indents of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.pages import BULLET, CLAUSE, PAGE

PARA = [*PAGE, "para"]


def _twentieths(x: Column) -> Column:
    return F.floor(x * 20 + 0.5) / 20


def paragraph_indents(spans: DataFrame) -> DataFrame:
    """Left and first-line indent of each paragraph (doc_id, page, para). The second line tells the left edge; of a single line, the text behind its label, if that stands apart, else its
    beginning. ``hanging``: a label before the edge, its text at the edge or, where the label is wider than the indent, behind it.

    ``spans``: doc_id, page, para, line (from the top), elem, text, x0, x1, size, rx0, rx1 (the column's edges). Missing and empty texts are no labels.
    """
    w = Window.partitionBy(*PARA).orderBy("line", "x0", "elem")
    s = spans.withColumns({"n": F.row_number().over(w), "first": F.min("line").over(Window.partitionBy(*PARA))})
    at = lambda c, n: F.min(F.when((F.col("n") == n) & (F.col("line") == F.col("first")), F.col(c)))
    g = s.groupBy(*PARA).agg(
        F.countDistinct("line").alias("lines"), F.min("rx0").alias("rx0"), at("x0", 1).alias("a0"), at("x1", 1).alias("a1"), at("x0", 2).alias("b0"), at("text", 1).alias("label"), at("size", 1).alias("size"),
        F.min_by(F.when(F.col("line") > F.col("first"), F.col("x0")), F.when(F.col("line") > F.col("first"), F.struct("line", "x0"))).alias("second"),
    )
    labelled = F.coalesce(F.trim("label").rlike(BULLET) | F.trim("label").rlike(CLAUSE), F.lit(False))
    gap = F.col("b0") - F.col("a1")
    body = F.coalesce("second", F.when(labelled & (gap > 0.5 * F.col("size")), F.col("b0")), "a0")
    left = F.greatest(F.lit(0.0), body - F.col("rx0"))
    g = g.withColumn("left", left).withColumn("first_line", F.col("a0") - F.col("rx0") - F.col("left")).withColumn("edge", F.col("rx0") + F.col("left"))
    behind = (F.abs(F.col("b0") - F.col("edge")) <= 2) | (F.col("lines") >= 2) & (F.col("a1") > F.col("edge") - 1) & (F.col("b0") > F.col("edge"))
    hanging = F.coalesce(labelled & (gap > 0.1 * F.col("size")) & (F.col("first_line") < -0.5) & behind, F.lit(False))
    return g.select(*PARA, "lines", F.round("left", 3).alias("left"), F.round("first_line", 3).alias("first_line"), hanging.alias("hanging"))


def tab_stops(spans: DataFrame, indents: DataFrame) -> DataFrame:
    """Tab stops of each paragraph, from the left: a gap over 12 points and 1.2 sizes ends at one. What ends within 3 points of the column's right edge and is the last of its line hangs
    at a right-aligned stop. In reading order, a gap whose end is less than a point from a stop already there uses it. The text behind a hanging label needs a stop only
    where the indent isn't its place.

    ``spans`` as in ``paragraph_indents``, ``indents`` its result. Returns doc_id, page, para, stop (from 1), pos (from the column's left edge, in twentieths of a point), align, gaps (how many end
    within a point of it). Paragraphs without such gaps make no row. A paragraph's gaps are folded in one row.
    """
    line = Window.partitionBy(*PARA, "line")
    w = line.orderBy("x0", "elem")
    s = spans.join(indents.select(*PARA, "left", "hanging"), PARA)
    s = s.withColumns({"gap": F.col("x0") - F.lag("x1").over(w), "k": F.row_number().over(w), "end": F.max("x1").over(line), "first": F.min("line").over(Window.partitionBy(*PARA))})
    label = F.col("hanging") & (F.col("line") == F.col("first")) & (F.col("k") == 2)
    s = s.withColumns({"label": label, "wide": F.coalesce(F.col("gap") > F.greatest(1.2 * F.col("size"), F.lit(12.0)), F.lit(False))})
    later = F.sum(F.col("wide").cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing))
    last = (F.coalesce(later, F.lit(0)) == 0) & (F.col("rx1") - F.col("end") <= 3) & ~F.col("label")
    pos = _twentieths(F.when(last, F.least("end", "rx1")).otherwise(F.col("x0")) - F.col("rx0"))
    ends = s.withColumns({"pos": pos, "align": F.when(last, "right").otherwise("left")}).filter("CASE WHEN label THEN abs(x0 - rx0 - left) > 2 ELSE wide END")
    g = ends.groupBy(*PARA).agg(F.array_sort(F.collect_list(F.struct("line", "x0", "elem", "pos", "align"))).alias("ends"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<pos: DOUBLE, align: STRING>>)")
    kept = F.aggregate("ends", none, lambda acc, e: F.when(F.exists(acc, lambda a: F.abs(a["pos"] - e["pos"]) < 1), acc).otherwise(F.concat(acc, F.array(F.struct(e["pos"].alias("pos"), e["align"].alias("align"))))))
    each = g.withColumn("stops", F.array_sort(kept)).select(*PARA, "ends", F.posexplode("stops").alias("i", "s"))
    return each.select(*PARA, (F.col("i") + 1).alias("stop"), F.col("s.pos").alias("pos"), F.col("s.align").alias("align"), F.size(F.filter("ends", lambda e: F.abs(e["pos"] - F.col("s.pos")) < 1)).alias("gaps"))
