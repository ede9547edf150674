"""The operators' input tables derived from the driver's tables, in Spark and in SQL, so that every operator also runs over whole tables.

Lines of a document are its text split at line feeds. Page layouts are set from documents' words: eight words a line, two columns of forty lines a page, a title over both
columns and a footer with the printed page. Ruled grids are set from orders, a row for each of an order's lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.tables import table


class Corpus(str):
    """A tables folder whose queries take their inputs from the driver's tables, not from inline rows."""


def _lines(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """doc_id, n (from 1), text of every line of every document, and expressions over them."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", F.col("n") + 1)
    return each.selectExpr(*cols)


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.expr(r"filter(split(text, '[ \n\r\t]+'), x -> x <> '')").alias("w")).filter("size(w) > 0")
    k = w.select("doc_id", "w", F.explode(F.expr("sequence(0, (size(w) + 7) div 8 - 1)")).alias("k"))
    t = k.selectExpr("doc_id", "k", "k % 80 AS i", "k div 80 + 1 AS p", "array_join(slice(w, k * 8 + 1, 8), ' ') AS s")
    return t.selectExpr(
        "doc_id", "CAST(p AS INT) AS page", "k AS elem", "CASE WHEN i = 79 THEN concat('Page ', p + 4, ' of 9') ELSE s END AS text",
        "CASE WHEN i = 79 THEN 280.0D WHEN i = 0 THEN 72.0D ELSE 72.0D + 248.0D * (i div 40) END AS x0",
        "CASE WHEN i = 79 THEN 330.0D WHEN i = 0 THEN 540.0D ELSE 72.0D + 248.0D * (i div 40) + least(length(s) * 4.0D, 228.0D) END AS x1",
        "CASE WHEN i = 79 THEN 760.0D WHEN i = 0 THEN 60.0D ELSE 80.0D + 12.0D * (i % 40) END AS top", "CASE WHEN i = 79 THEN 768.0D WHEN i = 0 THEN 78.0D ELSE 90.0D + 12.0D * (i % 40) END AS bottom",
        "CASE WHEN i = 79 THEN 8.0D WHEN i = 0 THEN 18.0D ELSE 10.0D END AS size", "CASE WHEN i IN (0, 79) THEN 'Sans' ELSE 'Serif' END AS font", "i = 0 AS bold",
    )


_SPANS = r"""(SELECT doc_id, CAST(p AS INTEGER) AS page, CAST(k AS INTEGER) AS elem, CASE WHEN i = 79 THEN 'Page ' || (p + 4) || ' of 9' ELSE s END AS text, CAST(CASE WHEN i = 79 THEN 280 WHEN i = 0 THEN 72 ELSE 72 + 248 * (i // 40) END AS DOUBLE) AS x0,
CAST(CASE WHEN i = 79 THEN 330 WHEN i = 0 THEN 540 ELSE 72 + 248 * (i // 40) + least(length(s) * 4, 228) END AS DOUBLE) AS x1, CAST(CASE WHEN i = 79 THEN 760 WHEN i = 0 THEN 60 ELSE 80 + 12 * (i % 40) END AS DOUBLE) AS top,
CAST(CASE WHEN i = 79 THEN 768 WHEN i = 0 THEN 78 ELSE 90 + 12 * (i % 40) END AS DOUBLE) AS bottom, CAST(CASE WHEN i = 79 THEN 8 WHEN i = 0 THEN 18 ELSE 10 END AS DOUBLE) AS size, CASE WHEN i IN (0, 79) THEN 'Sans' ELSE 'Serif' END AS font, i = 0 AS bold
FROM (SELECT doc_id, k, k % 80 AS i, k // 80 + 1 AS p, array_to_string(w[k * 8 + 1 : k * 8 + 8], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 7) // 8)) AS k FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\r\t]+'), lambda x: x <> '') AS w FROM documents)))) AS spans"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("k"))


_ORDERS = "(SELECT l_orderkey AS doc_id, CAST(count(*) AS INTEGER) AS k FROM lineitem GROUP BY 1)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    r = _orders(spark, d).selectExpr("doc_id", "k", "explode(sequence(0, 2 * k - 1)) AS c")
    return r.selectExpr("doc_id", "1 AS page", "c + 1 AS cell", "70.0D + 230.0D * (c % 2) AS x0", "300.0D + 230.0D * (c % 2) AS x1", "90.0D + 20.0D * (c div 2) AS y0", "110.0D + 20.0D * (c div 2) AS y1")


_CELLS = f"(SELECT doc_id, 1 AS page, CAST(c + 1 AS INTEGER) AS cell, CAST(70 + 230 * (c % 2) AS DOUBLE) AS x0, CAST(300 + 230 * (c % 2) AS DOUBLE) AS x1, CAST(90 + 20 * (c // 2) AS DOUBLE) AS y0, CAST(110 + 20 * (c // 2) AS DOUBLE) AS y1 FROM (SELECT doc_id, k, unnest(range(0, 2 * k)) AS c FROM {_ORDERS})) AS cells"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    r = _orders(spark, d).selectExpr("doc_id", "k", "explode(sequence(0, k + 3)) AS s").filter("doc_id % 3 > 0 OR s <> 1")
    y = "90.0D + 20.0D * s"
    return r.selectExpr("doc_id", "1 AS page", "s AS seg", f"CASE WHEN s <= k THEN 70.0D ELSE 70.0D + 230.0D * (s - k - 1) END AS x0", f"CASE WHEN s <= k THEN {y} ELSE 90.0D END AS y0", "CASE WHEN s <= k THEN CASE WHEN doc_id % 5 = 0 THEN 200.0D ELSE 530.0D END ELSE 70.0D + 230.0D * (s - k - 1) END AS x1", f"CASE WHEN s <= k THEN {y} ELSE 90.0D + 20.0D * k END AS y1", "s <= k AS horizontal")


_SEGMENTS = f"(SELECT doc_id, 1 AS page, CAST(s AS INTEGER) AS seg, CAST(CASE WHEN s <= k THEN 70 ELSE 70 + 230 * (s - k - 1) END AS DOUBLE) AS x0, CAST(CASE WHEN s <= k THEN 90 + 20 * s ELSE 90 END AS DOUBLE) AS y0, CAST(CASE WHEN s <= k THEN CASE WHEN doc_id % 5 = 0 THEN 200 ELSE 530 END ELSE 70 + 230 * (s - k - 1) END AS DOUBLE) AS x1, CAST(CASE WHEN s <= k THEN 90 + 20 * s ELSE 90 + 20 * k END AS DOUBLE) AS y1, s <= k AS horizontal FROM (SELECT doc_id, k, unnest(range(0, k + 4)) AS s FROM {_ORDERS}) WHERE doc_id % 3 > 0 OR s <> 1) AS segments"


def _fills(spark: SparkSession, d: str) -> DataFrame:
    r = _orders(spark, d).selectExpr("doc_id", "k", "explode(sequence(0, k)) AS f").filter("f % 2 = 0")
    return r.selectExpr("doc_id", "1 AS page", "f AS fill", "CASE WHEN f = 0 THEN 0.0D ELSE 70.0D END AS x0", "CASE WHEN f = 0 THEN 600.0D ELSE 530.0D END AS x1", "CASE WHEN f = 0 THEN 0.0D ELSE 90.0D + 20.0D * (f - 1) END AS top", "CASE WHEN f = 0 THEN IF(doc_id % 4 = 0, 790.0D, 300.0D) ELSE 90.0D + 20.0D * f END AS bottom", "CASE WHEN f = 0 THEN 'eeeeee' ELSE 'ffff00' END AS color", "612.0D AS width", "792.0D AS height")


_FILLS = f"(SELECT doc_id, 1 AS page, CAST(f AS INTEGER) AS fill, CAST(CASE WHEN f = 0 THEN 0 ELSE 70 END AS DOUBLE) AS x0, CAST(CASE WHEN f = 0 THEN 600 ELSE 530 END AS DOUBLE) AS x1, CAST(CASE WHEN f = 0 THEN 0 ELSE 90 + 20 * (f - 1) END AS DOUBLE) AS top, CAST(CASE WHEN f = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 790 ELSE 300 END ELSE 90 + 20 * f END AS DOUBLE) AS bottom, CASE WHEN f = 0 THEN 'eeeeee' ELSE 'ffff00' END AS color, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height FROM (SELECT doc_id, k, unnest(range(0, k + 1)) AS f FROM {_ORDERS}) WHERE f % 2 = 0) AS fills"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("int").alias("graph"), F.row_number().over(w).alias("r"), F.col("o_orderkey").cast("string").alias("src"), F.array(F.lead("o_orderkey", 1).over(w), F.lead("o_orderkey", 3).over(w)).alias("to"))
    return o.select("graph", "r", "src", F.posexplode("to").alias("i", "t")).filter("t IS NOT NULL").selectExpr("graph", "r * 2 + i AS pos", "src", "CAST(t AS STRING) AS dst")


_EDGES = "(SELECT graph, CAST(r * 2 + i AS INTEGER) AS pos, src, CAST(t AS VARCHAR) AS dst FROM (SELECT CAST(o_custkey AS INTEGER) AS graph, row_number() OVER w AS r, CAST(o_orderkey AS VARCHAR) AS src, unnest([0, 1]) AS i, unnest([lead(o_orderkey, 1) OVER w, lead(o_orderkey, 3) OVER w]) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE t IS NOT NULL) AS edges"

_STYLE = "CASE WHEN length(text) < 60 THEN 'H1' WHEN n % 5 = 0 THEN 'CN' WHEN n % 7 = 0 THEN 'Own' END"

_TOOL = "CASE event_id % 5 WHEN 0 THEN 'doc_read' WHEN 1 THEN 'doc_delete' WHEN 2 THEN 'doc_replace' WHEN 3 THEN 'doc_insert' ELSE 'doc_move' END"
_CONTENT = "CASE event_id % 4 WHEN 0 THEN 'a secret b' WHEN 1 THEN 'chapter?1 x' WHEN 2 THEN 'chapterX1 x' ELSE '' END"
_ROLE = "CASE WHEN role = 'user' AND (turn + conv_id) % 4 < 2 THEN 'tool' ELSE role END"

#: name: (Spark, SQL to stand after FROM)
TABLES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "spans": (_spans, _SPANS),
    "cells": (_cells, _CELLS),
    "segments": (_segments, _SEGMENTS),
    "fills": (_fills, _FILLS),
    "edges": (_edges, _EDGES),
    "headings": (lambda s, d: _lines(s, d, "doc_id", "n AS ordinal", "n % 4 AS level", "text"), f"(SELECT doc_id, CAST(n AS INTEGER) AS ordinal, CAST(n % 4 AS INTEGER) AS level, text FROM {_LINES}) AS headings"),
    "revisions": (
        lambda s, d: _lines(s, d, "doc_id", "n AS ordinal", "CASE n % 3 WHEN 0 THEN 'ins' WHEN 1 THEN 'keep' ELSE 'del' END AS kind", "CASE WHEN n % 2 = 0 THEN 'ann' ELSE 'bob' END AS author", "text", "CASE WHEN n % 3 <> 1 THEN concat('r', n % 7) END AS rev_id"),
        f"(SELECT doc_id, CAST(n AS INTEGER) AS ordinal, CASE n % 3 WHEN 0 THEN 'ins' WHEN 1 THEN 'keep' ELSE 'del' END AS kind, CASE WHEN n % 2 = 0 THEN 'ann' ELSE 'bob' END AS author, text, CASE WHEN n % 3 <> 1 THEN 'r' || (n % 7) END AS rev_id FROM {_LINES}) AS revisions",
    ),
    "paras": (
        lambda s, d: _lines(s, d, "doc_id", "n AS ordinal", f"{_STYLE} AS style", "CASE WHEN n % 11 = 0 THEN 'header' ELSE 'body' END AS part", "text", "CASE WHEN n % 3 = 0 THEN 'Em' END AS run_style"),
        f"(SELECT doc_id, CAST(n AS INTEGER) AS ordinal, {_STYLE} AS style, CASE WHEN n % 11 = 0 THEN 'header' ELSE 'body' END AS part, text, CASE WHEN n % 3 = 0 THEN 'Em' END AS run_style FROM {_LINES}) AS paras",
    ),
    "blocks": (lambda s, d: _lines(s, d, "doc_id", "n AS ordinal", "CASE WHEN n % 4 = 1 THEN 'heading' ELSE 'paragraph' END AS kind", "text"), f"(SELECT doc_id, CAST(n AS INTEGER) AS ordinal, CASE WHEN n % 4 = 1 THEN 'heading' ELSE 'paragraph' END AS kind, text FROM {_LINES}) AS blocks"),
    "inserts": (lambda s, d: _lines(s, d, "doc_id", "n AS after", "1 AS pos", "left(text, 20) AS text").filter("after % 3 = 0"), f"(SELECT doc_id, CAST(n AS INTEGER) AS after, 1 AS pos, left(text, 20) AS text FROM {_LINES} WHERE n % 3 = 0) AS inserts"),
    "deletes": (lambda s, d: _lines(s, d, "doc_id", "n AS ordinal").filter("ordinal % 5 = 1"), f"(SELECT doc_id, CAST(n AS INTEGER) AS ordinal FROM {_LINES} WHERE n % 5 = 1) AS deletes"),
    "moves": (lambda s, d: _lines(s, d, "doc_id", "n AS ordinal", "text", "n % 4 = 2 AS moved", "n = 1 AS anchor"), f"(SELECT doc_id, CAST(n AS INTEGER) AS ordinal, text, n % 4 = 2 AS moved, n = 1 AS anchor FROM {_LINES}) AS moves"),
    "comments": (lambda s, d: _lines(s, d, "doc_id", "n AS comment_id", "'ann' AS author", "left(text, 10) AS text").filter("comment_id % 2 = 1"), f"(SELECT doc_id, CAST(n AS INTEGER) AS comment_id, 'ann' AS author, left(text, 10) AS text FROM {_LINES} WHERE n % 2 = 1) AS comments"),
    "anchors": (
        lambda s, d: _lines(s, d, "doc_id", "n div 2 * 2 + 1 AS c", "n AS ordinal", "concat('P', n, '@v0') AS ref").filter("ordinal % 7 <> 1").selectExpr("doc_id", "CAST(c AS INT) AS comment_id", "ordinal", "ref"),
        f"(SELECT doc_id, CAST(n // 2 * 2 + 1 AS INTEGER) AS comment_id, CAST(n AS INTEGER) AS ordinal, 'P' || n || '@v0' AS ref FROM {_LINES} WHERE n % 7 <> 1) AS anchors",
    ),
    "parts": (
        lambda s, d: _lines(s, d, "doc_id", "explode(sequence(0, 1)) AS version", "n", "text").filter("n % 9 <> 8 - version").selectExpr("doc_id", "version", "concat('part', n, '.xml') AS part", "CASE WHEN version = 1 THEN replace(text, 'tion', 'sion') ELSE text END AS body"),
        f"(SELECT doc_id, CAST(v AS INTEGER) AS version, 'part' || n || '.xml' AS part, CASE WHEN v = 1 THEN replace(text, 'tion', 'sion') ELSE text END AS body FROM (SELECT doc_id, unnest(range(0, 2)) AS v, n, text FROM {_LINES}) WHERE n % 9 <> 8 - v) AS parts",
    ),
    "tool_results": (
        lambda s, d: table(s, d, "conversations").selectExpr("conv_id AS session", "CAST(turn AS INT) AS idx", "CASE WHEN role = 'user' THEN 'tool' ELSE role END AS role", "repeat(text, 9) AS content"),
        "(SELECT conv_id AS session, CAST(turn AS INTEGER) AS idx, CASE WHEN role = 'user' THEN 'tool' ELSE role END AS role, repeat(text, 9) AS content FROM conversations) AS tool_results",
    ),
    "page_specs": (
        lambda s, d: table(s, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS doc_id", "CASE l_linenumber % 5 WHEN 0 THEN concat(l_linenumber, '-', CAST(l_quantity AS INT)) WHEN 1 THEN concat('第', l_linenumber, '至', CAST(l_quantity AS INT), '页') WHEN 2 THEN concat(CAST(l_quantity AS INT), '-') WHEN 3 THEN concat('前', l_linenumber, '，', CAST(l_quantity AS INT)) ELSE concat('-', l_linenumber) END AS spec", "40 AS total"),
        "(SELECT l_orderkey * 10 + l_linenumber AS doc_id, CASE l_linenumber % 5 WHEN 0 THEN l_linenumber || '-' || CAST(l_quantity AS INTEGER) WHEN 1 THEN '第' || l_linenumber || '至' || CAST(l_quantity AS INTEGER) || '页' WHEN 2 THEN CAST(l_quantity AS INTEGER) || '-' WHEN 3 THEN '前' || l_linenumber || '，' || CAST(l_quantity AS INTEGER) ELSE '-' || l_linenumber END AS spec, 40 AS total FROM lineitem) AS page_specs",
    ),
    "intervals": (
        lambda s, d: table(s, d, "lineitem").selectExpr("CAST(l_orderkey AS INT) AS line", "l_linenumber * 10.0D + l_quantity / 10 AS x0", "l_linenumber * 10.0D + l_quantity / 10 + l_quantity / 4 AS x1"),
        "(SELECT CAST(l_orderkey AS INTEGER) AS line, l_linenumber * CAST(10 AS DOUBLE) + l_quantity / 10 AS x0, l_linenumber * CAST(10 AS DOUBLE) + l_quantity / 10 + l_quantity / 4 AS x1 FROM lineitem) AS intervals",
    ),
    "positions": (lambda s, d: table(s, d, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS axis", "CAST(l_quantity AS DOUBLE) AS v"), "(SELECT CAST(l_orderkey AS VARCHAR) AS axis, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) AS positions"),
    "todos": (lambda s, d: table(s, d, "orders").selectExpr("o_custkey AS session", "CAST(o_orderkey AS INT) AS pos", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status"), "(SELECT o_custkey AS session, CAST(o_orderkey AS INTEGER) AS pos, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status FROM orders) AS todos"),
    "batch_calls": (lambda s, d: table(s, d, "events").selectExpr("CAST(user_id AS INT) AS turn", "CAST(event_id AS INT) AS pos", "event_type <> 'purchase' AS safe"), "(SELECT CAST(user_id AS INTEGER) AS turn, CAST(event_id AS INTEGER) AS pos, event_type <> 'purchase' AS safe FROM events) AS batch_calls"),
    "calls": (
        lambda s, d: table(s, d, "events").selectExpr("CAST(event_id AS INT) AS call_id", f"{_TOOL} AS tool", f"{_CONTENT} AS content", f"{_TOOL} = 'doc_read' AS readonly", f"{_TOOL} IN ('doc_delete', 'doc_move') AS destructive", f"CASE WHEN {_TOOL} = 'doc_read' THEN 'read' ELSE 'edit' END AS category", "CASE WHEN event_id % 11 = 0 THEN 'ask' END AS own"),
        f"(SELECT CAST(event_id AS INTEGER) AS call_id, {_TOOL} AS tool, {_CONTENT} AS content, {_TOOL} = 'doc_read' AS readonly, {_TOOL} IN ('doc_delete', 'doc_move') AS destructive, CASE WHEN {_TOOL} = 'doc_read' THEN 'read' ELSE 'edit' END AS category, CASE WHEN event_id % 11 = 0 THEN 'ask' END AS own FROM events) AS calls",
    ),
    "messages": (
        lambda s, d: table(s, d, "conversations").selectExpr("conv_id AS session", "CAST(turn AS INT) AS idx", f"{_ROLE} AS role", "left(text, 20) AS content", "CASE WHEN role = 'assistant' THEN 'a,b' END AS call_ids", f"CASE WHEN {_ROLE} = 'tool' THEN CASE WHEN conv_id % 3 = 0 THEN 'zzz' ELSE 'b' END END AS tool_call_id"),
        f"(SELECT conv_id AS session, CAST(turn AS INTEGER) AS idx, {_ROLE} AS role, left(text, 20) AS content, CASE WHEN role = 'assistant' THEN 'a,b' END AS call_ids, CASE WHEN {_ROLE} = 'tool' THEN CASE WHEN conv_id % 3 = 0 THEN 'zzz' ELSE 'b' END END AS tool_call_id FROM conversations) AS messages",
    ),
    "captions": (lambda s, d: _lines(s, d, "CAST(doc_id * 1000 + n AS INT) AS id", "CASE n % 4 WHEN 1 THEN concat('Fig. ', n, ' ', text) WHEN 2 THEN concat('表', n, text) ELSE text END AS text"), f"(SELECT CAST(doc_id * 1000 + n AS INTEGER) AS id, CASE n % 4 WHEN 1 THEN 'Fig. ' || n || ' ' || text WHEN 2 THEN '表' || n || text ELSE text END AS text FROM {_LINES}) AS captions"),
    "odd_texts": (lambda s, d: table(s, d, "documents").selectExpr("CAST(doc_id AS INT) AS id", "text"), "(SELECT CAST(doc_id AS INTEGER) AS id, text FROM documents) AS odd_texts"),
    "files": (lambda s, d: table(s, d, "pages").selectExpr("CAST(page_id AS INT) AS file_id", "concat('p', page_id % 7, '?', CASE page_id % 4 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.htm' WHEN 2 THEN '.pdf' ELSE '.xyz' END) AS name"), "(SELECT CAST(page_id AS INTEGER) AS file_id, 'p' || (page_id % 7) || '?' || CASE page_id % 4 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.htm' WHEN 2 THEN '.pdf' ELSE '.xyz' END AS name FROM pages) AS files"),
    "attempts": (lambda s, d: table(s, d, "events").selectExpr("CAST(event_id AS INT) AS id", "CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 401 WHEN 4 THEN 0 ELSE 404 END AS status", "CAST(event_id % 7 + 1 AS INT) AS attempt", "event_id % 13 = 0 AS aborted"), "(SELECT CAST(event_id AS INTEGER) AS id, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 401 WHEN 4 THEN 0 ELSE 404 END AS status, CAST(event_id % 7 + 1 AS INTEGER) AS attempt, event_id % 13 = 0 AS aborted FROM events) AS attempts"),
    "hooks": (lambda s, d: table(s, d, "events").selectExpr("CAST(event_id AS INT) AS id", "CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN 'p.*' WHEN 2 THEN 'click|view' END AS matcher", "event_type AS tool"), "(SELECT CAST(event_id AS INTEGER) AS id, CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN 'p.*' WHEN 2 THEN 'click|view' END AS matcher, event_type AS tool FROM events) AS hooks"),
}

def _same(name: str, source: str, columns: str, where: str = "TRUE", distinct: bool = False) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A table whose columns both engines compute by the same expressions."""
    pick = "SELECT DISTINCT" if distinct else "SELECT"
    return (lambda s, d: s.sql(f"{pick} {columns} FROM {{t}} WHERE {where}", t=table(s, d, source))), f"({pick} {columns} FROM {source} WHERE {where}) AS {name}"


_PRIORITY = "CASE p_size % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' END"
_FONT = "concat(CASE l_linenumber % 3 WHEN 0 THEN 'ABCDEF+' WHEN 1 THEN 'abcdef+' ELSE '' END, CASE l_partkey % 6 WHEN 0 THEN 'TimesNewRomanPS' WHEN 1 THEN 'Arial' WHEN 2 THEN 'CMR10' WHEN 3 THEN 'SimSun' WHEN 4 THEN 'Courier' ELSE 'Other' END, CASE l_suppkey % 4 WHEN 0 THEN '-BoldMT' WHEN 1 THEN ',Italic' WHEN 2 THEN '-BoldOblique' ELSE '' END)"
_ID = "l_orderkey * 10 + l_linenumber"
TABLES |= {
    "settings": _same("settings", "orders", "o_orderpriority AS layer, CAST(o_orderkey AS INTEGER) AS prio, concat('k', o_custkey) AS key, o_orderstatus AS value"),
    "setting_rules": _same("setting_rules", "lineitem", f"concat('layer', l_linenumber) AS layer, CAST(l_linenumber AS INTEGER) AS prio, CAST(l_orderkey AS INTEGER) AS pos, concat('rule', min(l_partkey), '(*)') AS rule", "TRUE GROUP BY l_linenumber, l_orderkey"),
    "names": _same("names", "lineitem", "concat(l_returnflag, l_suppkey) AS source, CAST(l_orderkey AS INTEGER) AS prio, CAST(l_linenumber AS INTEGER) AS pos, concat('n', l_partkey) AS name"),
    "tools": _same("tools", "part", f"concat('t', p_partkey) AS tool, {_PRIORITY} AS needs, p_size % 2 = 0 AS agent_ok"),
    "capabilities": _same("capabilities", "orders", "CASE o_orderkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'markdown' WHEN 2 THEN 'html' ELSE 'pdf' END AS format, o_orderpriority AS capability", "o_orderpriority <> '5-LOW' OR o_orderkey % 4 > 1", distinct=True),
    "fonts": _same("fonts", "lineitem", f"{_ID} AS id, {_FONT} AS font"),
    "accents": _same("accents", "lineitem", f"{_ID} AS id, concat(l_returnflag, l_linestatus, l_partkey) AS text, l_quantity AS x0, l_quantity + 20e0 AS x1, CASE l_linenumber % 4 WHEN 0 THEN '¯' WHEN 1 THEN 'ˆ' WHEN 2 THEN '~' ELSE '´' END AS accent, l_quantity + l_discount * 230e0 AS cx"),
    "grid_paras": _same("grid_paras", "lineitem", f"{_ID} AS id, l_quantity / 4e0 AS before, CAST(l_partkey % 24 AS DOUBLE) / 2e0 AS after, CAST(12 + l_suppkey % 40 AS DOUBLE) AS content, 11.5e0 + l_linenumber / 4e0 AS line_height, 12e0 AS pitch"),
}
_HOSTS = "l_orderkey AS doc_id, 1 AS page, CAST(2 * l_linenumber AS INTEGER) AS elem, concat('x', l_partkey) AS text, 72e0 AS x0, 172e0 + l_linenumber AS x1, CAST(90 + 20 * l_linenumber AS DOUBLE) AS top, CAST(100 + 20 * l_linenumber AS DOUBLE) AS bottom, 10e0 AS size"
_MARKS = "l_orderkey AS doc_id, 1 AS page, CAST(2 * l_linenumber + 1 AS INTEGER) AS elem, concat(l_returnflag, l_linenumber % 3) AS text, 170e0 + l_quantity AS x0, 175e0 + l_quantity AS x1, CAST(93 + 20 * l_linenumber + 2 * (l_partkey % 9 - 4) AS DOUBLE) AS top, CAST(100 + 20 * l_linenumber + 2 * (l_partkey % 9 - 4) AS DOUBLE) AS bottom, 5e0 + l_linenumber AS size"
_NUMBERED = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity FROM %s GROUP BY l_orderkey, l_linenumber)"
TABLES["scripts"] = (lambda s, d: s.sql(f"SELECT {_HOSTS} FROM {_NUMBERED % '{t}'} UNION ALL SELECT {_MARKS} FROM {_NUMBERED % '{t}'}", t=table(s, d, "lineitem"))), f"(SELECT {_HOSTS} FROM {_NUMBERED % 'lineitem'} UNION ALL SELECT {_MARKS} FROM {_NUMBERED % 'lineitem'}) AS scripts"
_PAIR = "regexp_extract(text, '([A-Za-z]{6,})', 1)"
_HYPHENS = "doc_id | CAST(doc_id * 1000 + n AS INTEGER) AS id | CASE WHEN n % 3 = 0 THEN concat(w, '-') ELSE concat(left(w, 3), '-') END AS a | CASE WHEN n % 3 = 0 THEN v ELSE concat(substr(w, 4), ' on') END AS b"
#: 32 bits hold the number of a line up to document 2,147,482; Spark's are wider.
_LINE_ID = "CAST(doc_id AS BIGINT) * 1000 + n"
TABLES |= {
    "hyphen_text": _same("hyphen_text", "documents", "doc_id, text"),
    "hyphens": (
        lambda s, d: _lines(s, d, "doc_id", "n", f"{_PAIR} AS w", "regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) AS v").selectExpr(*_HYPHENS.replace("CAST(doc_id * 1000 + n AS INTEGER)", _LINE_ID).split(" | ")),
        f"(SELECT {_HYPHENS.replace(' | ', ', ')} FROM (SELECT doc_id, n, {_PAIR} AS w, regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) AS v FROM {_LINES})) AS hyphens",
    ),
}
#: Styles by customer, each based on that of half its number; they stand in no other query's tables.
STYLES = _same(
    "styles", "customer", "concat('S', c_custkey) AS style_id, concat(CASE c_custkey % 13 WHEN 1 THEN 'heading ' WHEN 2 THEN '标题 ' WHEN 3 THEN 'H' ELSE 'Own ' END, c_custkey % 9 + 1, CASE c_custkey % 5 WHEN 0 THEN 'x' ELSE '' END) AS name, "
    "'paragraph' AS type, CASE WHEN c_custkey % 17 > 0 THEN concat('S', CAST(floor(c_custkey / 2) AS INTEGER)) END AS based_on, CAST(CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 10 END AS INTEGER) AS outline_lvl, c_custkey = 1 AS is_default",
)


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    return TABLES[name][0](spark, d)
