"""Grids of rules that are charts, not tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def _vivid(color: Column) -> Column:
    """Whether a colour of six hexadecimal digits is no grey; others are none."""
    parts = [F.conv(F.substring(color, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
    return color.rlike("^[0-9a-fA-F]{6}$") & (F.greatest(*parts) - F.least(*parts) >= 24)


def without_chart_grids(tables: DataFrame, paths: DataFrame, fills: DataFrame, spans: DataFrame) -> DataFrame:
    """Ruled tables (doc_id, page, tab, x0, x1, y0, y1, n_rows, n_cols) but for the grids of charts: those with a curve or a slanting line of some size in them, or three coloured
    fills, and hardly any text in their cells.

    ``paths``: doc_id, page, x0, y0, x1, y1, curved, diagonal; ``fills``: doc_id, page, x0, x1, top, bottom, color; ``spans``: doc_id, page, text, x0, x1, top, bottom. What lies in a
    grid is counted by one join on the page, so the tables are computed once; a page without any of it keeps its tables. Null texts and colours count for nothing.
    """
    edges = [F.col(c).alias(a) for a, c in (("l", "x0"), ("r", "x1"), ("t", "y0"), ("b", "y1"))]
    t = tables.select(*tables.columns, *edges).drop("x0", "x1", "y0", "y1")
    no = F.lit(None).cast("double")
    box = lambda kind, top, bottom, chars: [*PAGE, F.lit(kind).alias("kind"), "x0", "x1", F.col(top).alias("y0"), F.col(bottom).alias("y1"), chars.cast("long").alias("chars")]
    held = paths.filter("curved OR diagonal").select(*box("curve", "y0", "y1", no)).unionByName(fills.filter(_vivid(F.col("color"))).select(*box("fill", "top", "bottom", no))).unionByName(spans.select(*box("text", "top", "bottom", F.length(F.regexp_replace("text", r"\s", "")))))
    within = (F.col("x0") >= F.col("l") - 4) & (F.col("x1") <= F.col("r") + 4) & (F.col("y0") >= F.col("t") - 4) & (F.col("y1") <= F.col("b") + 4)
    part = lambda a, z, low, high: F.greatest(F.lit(0.0), F.least(a, high) - F.greatest(z, low))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    mostly = (part(F.col("x1"), F.col("x0"), F.col("l"), F.col("r")) >= 0.8 * wide) & (part(F.col("y1"), F.col("y0"), F.col("t"), F.col("b")) >= 0.8 * high)
    large = F.greatest(wide, high) > 0.15 * F.least(F.col("r") - F.col("l"), F.col("b") - F.col("t"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    centred = (cx > F.col("l")) & (cx < F.col("r")) & (cy > F.col("t")) & (cy < F.col("b"))
    is_ = lambda kind: F.col("kind") == F.lit(kind)
    own = [c for c in t.columns]
    met = t.join(held, PAGE, "left").groupBy(*own).agg(
        F.count_if(is_("curve") & (within | mostly) & large).alias("curves"), F.count_if(is_("fill") & within).alias("vivid"), F.coalesce(F.sum(F.when(is_("text") & centred, F.col("chars"))), F.lit(0)).alias("chars")
    )
    chart = ((F.col("curves") > 0) | (F.col("vivid") >= 3)) & (F.col("chars") <= F.greatest(F.lit(6), 2 * F.col("n_rows") * F.col("n_cols")))
    back = {"x0": "l", "x1": "r", "y0": "t", "y1": "b"}
    return met.filter(~F.coalesce(chart, F.lit(False))).select(*(F.col(back.get(c, c)).alias(c) for c in tables.columns))
