"""Tables and charts as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_rows(rows: DataFrame, key: str, cells: str) -> DataFrame:
    """Each key's rows (array column of cells, in ``pos`` order) as a Markdown table: padded to the widest row, pipes escaped, line breaks marked up."""
    wide = F.max(F.size(cells)).alias("w")
    g = rows.groupBy(key).agg(wide, F.array_sort(F.collect_list(F.struct("pos", F.col(cells).alias("c")))).alias("r"))
    cell = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    padded = lambda c, w: F.concat(F.transform(c, cell), F.array_repeat(F.lit(""), (w - F.size(c)).cast("int")))
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    lines = F.transform("r", lambda x: line(padded(x["c"], F.col("w"))))
    rule = line(F.array_repeat(F.lit("---"), F.col("w").cast("int")))
    return g.select(key, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n").alias("markdown"))


def chart_matrix(rows: DataFrame, category: str, series: str, value: str, names: list[str]) -> DataFrame:
    """One row a category, one column a series; 0 where there is none."""
    return rows.groupBy(category).pivot(series, names).agg(F.round(F.sum(value), 2)).na.fill(0.0, names)


def chart_ticks(rows: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """Evenly spaced ticks from the least to the greatest value, 0 included."""
    lim = rows.groupBy(key).agg(F.least(F.min(value), F.lit(0.0)).alias("lo"), F.greatest(F.max(value), F.lit(0.0)).alias("hi"))
    return lim.select(key, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(key, F.col("i").alias("tick"), F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (n - 1), 4).alias("at"))


def html_rows(rows: DataFrame, key: str, cells: str, caption: str | None = None) -> DataFrame:
    """Each key's rows (in ``pos`` order) as an HTML table: the first one heads, short ones are padded, text is escaped, line breaks marked up; with a caption if given."""
    escaped = lambda x: F.replace(F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br>"))
    g = rows.groupBy(key).agg(F.max(F.size(cells)).alias("w"), F.array_sort(F.collect_list(F.struct("pos", F.col(cells).alias("c")))).alias("r"))
    padded = lambda c: F.concat(F.transform(c, escaped), F.array_repeat(F.lit(""), (F.col("w") - F.size(c)).cast("int")))
    line = lambda c, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform("r", lambda x, i: F.when(i == 0, line(padded(x["c"]), "th")).otherwise(line(padded(x["c"]), "td"))), "")
    head = F.lit(f"<caption>{caption}</caption>") if caption else F.lit("")
    return g.select(key, F.concat(F.lit("<table>"), head, body, F.lit("</table>")).alias("html"))


def pie_angles(rows: DataFrame, key: str, category: str, value: str) -> DataFrame:
    """Where each category's slice of its key's pie begins and ends, in degrees from the top; negative sums count as 0."""
    from pyspark.sql import Window

    v = rows.groupBy(key, category).agg(F.greatest(F.sum(value), F.lit(0.0)).alias("v"))
    w = Window.partitionBy(key)
    upto = F.sum("v").over(w.orderBy(category).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("v").over(w)
    return v.withColumn("upto", upto).withColumn("total", total).filter("total > 0").select(key, category, F.round(360 * (F.col("upto") - F.col("v")) / F.col("total"), 6).alias("start"), F.round(360 * F.col("upto") / F.col("total"), 6).alias("end"))
