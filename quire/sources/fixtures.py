"""Small inline tables for operators whose inputs the driver's tables lack; the same rows serve Spark and the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

#: name: (schema, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "headings": ("doc_id long, ordinal int, level int, text string", [(1, 1, 0, "Title page"), (1, 2, 1, "Intro: What & Why?"), (1, 3, 2, "Two  words -- dashed"), (1, 4, 3, "Ünïcode 42 Text"), (2, 1, 1, "  Trim me  "), (2, 2, 2, "A/B (test)")]),
    "revisions": ("doc_id long, ordinal int, kind string, author string, text string, rev_id string", [(1, 1, "keep", None, "The ", None), (1, 2, "del", "ann", "old", "r1"), (1, 3, "ins", "bob", "new", "r2"), (1, 4, "keep", None, " text", None), (2, 1, "ins", "ann", "added", "r1"), (2, 2, "del", "bob", "gone", "r3"), (2, 3, "keep", None, ".", None), (2, 4, "ins", "ann", "!", "r1")]),
    "messages": ("session long, idx int, role string, content string, call_ids string, tool_call_id string", [(1, 1, "user", "go", None, None), (1, 2, "assistant", "", "a,b", None), (1, 3, "tool", "zzz result", None, "zzz"), (1, 4, "tool", "b result", None, "b"), (1, 5, "user", "next", None, None), (1, 6, "tool", "late a", None, "a"), (2, 1, "user", "hi", None, None), (2, 2, "assistant", "ok", "c", None), (2, 3, "tool", "c result", None, "c"), (2, 4, "assistant", "done", None, None), (3, 1, "assistant", None, "x", None)]),
    "tool_results": ("session long, idx int, role string, content string", [(s, i, "tool" if i % 2 == 0 else "assistant", ("line one of %d\n" % i) + "x" * (400 * i) if i % 2 == 0 else "call") for s in (1, 2) for i in range(1, 21 if s == 1 else 9)]),
    "rules": ("list string, idx int, rule string", [("deny", 1, "doc_delete"), ("deny", 2, "bad rule("), ("ask", 1, "doc_replace(*secret*)"), ("allow", 1, "doc_insert(*)"), ("allow", 2, "doc_replace(chapter?1*)"), ("allow", 3, "doc_format")]),
    "calls": ("call_id int, tool string, content string, readonly boolean, destructive boolean, category string, own string", [(1, "doc_read", "", True, False, "read", None), (2, "doc_delete", "B1", False, True, "edit", None), (3, "doc_replace", "a secret b", False, False, "edit", None), (4, "doc_replace", "chapter?1 x", False, False, "edit", None), (5, "doc_replace", "chapterX1 x", False, False, "edit", None), (6, "doc_insert", "p", False, False, "edit", None), (7, "doc_format", "p", False, False, "edit", "ask"), (8, "todo", "", False, False, "meta", "allow"), (9, "doc_move", "p", False, True, "edit", None)]),
    "settings": ("layer string, prio int, key string, value string", [("default", 0, "model", "flash"), ("default", 0, "maxTurns", "40"), ("user", 1, "model", "pro"), ("project", 2, "author", "team"), ("env", 3, "model", "flash-2"), ("cli", 4, "maxTurns", "10")]),
    "setting_rules": ("layer string, prio int, pos int, rule string", [("default", 0, 1, "doc_read"), ("user", 1, 1, "doc_insert(*)"), ("user", 1, 2, "doc_read"), ("project", 2, 1, "doc_format")]),
    "capabilities": ("format string, capability string", [("docx", "tables"), ("docx", "comments"), ("docx", "trackChanges"), ("docx", "styles"), ("markdown", "comments"), ("markdown", "rawInsert"), ("markdown", "links"), ("html", "comments"), ("html", "links"), ("pdf", "convert")]),
    "tools": ("tool string, needs string, agent_ok boolean", [("doc_read", None, True), ("doc_search", None, True), ("table_insert", "tables", True), ("comment_add", "comments", True), ("review", "trackChanges", False), ("style_set", "styles", True), ("link_add", "links", True), ("pdf_convert", "convert", False), ("agent", None, False)]),
    "styles": ("style_id string, name string, type string, based_on string, outline_lvl int, is_default boolean", [("Normal", "Normal", "paragraph", None, None, True), ("H1", "heading 1", "paragraph", "Normal", 0, False), ("H2x", "H2_First", "paragraph", "H1", None, False), ("Own", "My own", "paragraph", "H2x", None, False), ("CN", "标题 3", "paragraph", "Normal", None, False), ("CyA", "Loop A", "paragraph", "CyB", None, False), ("CyB", "Loop B", "paragraph", "CyA", None, False), ("Body9", "Body", "paragraph", "Missing", 9, False), ("Em", "Emphasis", "character", None, None, False)]),
    "paras": ("doc_id long, ordinal int, style string, part string, text string, run_style string", [(1, 1, "H1", "body", "Intro", None), (1, 2, None, "body", "text one", "Em"), (1, 3, None, "body", "", None), (1, 4, "H2x", "body", "Sub", None), (1, 5, "CN", "body", "x", None), (1, 6, None, "header", "head", None), (2, 1, "Own", "body", "own", "Em"), (2, 2, "CyA", "body", "loop", None), (2, 3, "H1", "body", "more", None)]),
    "comments": ("doc_id long, comment_id int, author string, text string", [(1, 1, "ann", "why?"), (1, 2, "bob", "ok"), (2, 1, "ann", "lost")]),
    "anchors": ("doc_id long, comment_id int, ordinal int, ref string", [(1, 1, 4, "P4@v0"), (1, 1, 2, "P2@v0"), (1, 2, 5, "P5@v0")]),
    "parts": ("doc_id long, version int, part string, body string", [(1, 0, "document.xml", "a"), (1, 0, "styles.xml", "s"), (1, 0, "media/image2.png", "i2"), (1, 0, "media/image10.png", "i10"), (1, 1, "document.xml", "b"), (1, 1, "styles.xml", "s"), (1, 1, "comments.xml", "c"), (1, 1, "media/image10.png", "i10"), (2, 0, "document.xml", "z"), (2, 1, "document.xml", "z")]),
    "files": ("file_id int, name string", [(1, "A.DOCX"), (2, "b.dotx"), (3, "c.pdf"), (4, "d.HTM"), (5, "e.xhtml"), (6, "f.md"), (7, "g.txt"), (8, "h.doc"), (9, "noext"), (10, "we?ird:na*me.docm"), (11, "f.md")]),
    "page_specs": ("doc_id long, spec string, total int", [(1, "1-20", 12), (2, "1-5,8", 30), (3, "30-", 33), (4, "-3", 10), (5, "7", 10), (6, "5-2", 10), (7, "2,2,1", 5), (8, "", 4), (9, "９-１１", 20), (10, "99", 10), (11, "3-99999999999", 10), (12, "99999999999999999999-8", 10), (13, "0-2", 5), (14, "4000000000", 9), (15, "-5000000000,0007", 3)]),
    "spans": ("doc_id long, page int, elem int, text string, x0 double, x1 double, top double, bottom double, size double, font string, bold boolean", [(1, p, 10 * p + i, t, x, x + w, y, y + s, s, f, b) for p in (1, 2, 3) for i, (t, x, w, y, s, f, b) in enumerate([("Title %d" % p, 72.0, 300.0, 60.0, 18.0, "Sans", True), ("left a", 72.1, 190.0, 100.0, 10.0, "Serif", False), ("right a", 320.0, 200.0, 100.0, 10.0, "Serif", False), ("left b", 72.4, 185.0, 112.0, 10.0, "Serif", False), ("right b", 320.2, 190.0, 112.0, 10.0, "Serif", False), ("left c", 72.0, 192.0, 124.0, 10.0, "Serif", False), ("right c", 320.0, 201.0, 124.0, 10.0, "Serif", False), ("Page %d of 9" % (p + 4), 280.0, 50.0, 760.0, 8.0, "Sans", False)])]),
    "cells": ("doc_id long, page int, cell int, x0 double, x1 double, y0 double, y1 double", [(1, 1, 1, 70.0, 300.0, 95.0, 111.0), (1, 1, 2, 300.0, 560.0, 95.0, 111.0), (1, 1, 3, 70.0, 300.0, 111.0, 140.0), (1, 2, 4, 0.0, 600.0, 50.0, 90.0)]),
    "segments": ("doc_id long, page int, seg int, x0 double, y0 double, x1 double, y1 double, horizontal boolean", [(1, 1, 1, 70.0, 95.0, 560.0, 95.0, True), (1, 1, 2, 70.0, 140.0, 560.0, 140.0, True), (1, 1, 3, 70.0, 95.0, 70.0, 140.0, False), (1, 1, 4, 560.0, 95.0, 560.0, 140.0, False), (1, 1, 5, 100.0, 300.0, 200.0, 300.0, True), (1, 1, 6, 400.0, 500.0, 460.0, 500.0, True), (1, 1, 7, 430.0, 499.0, 430.0, 560.0, False)]),
    "fills": ("doc_id long, page int, fill int, x0 double, x1 double, top double, bottom double, color string, width double, height double", [(1, 1, 1, 0.0, 600.0, 0.0, 790.0, "eeeeee", 612.0, 792.0), (1, 1, 2, 70.0, 270.0, 99.0, 111.0, "ffff00", 612.0, 792.0), (1, 2, 3, 0.0, 300.0, 0.0, 790.0, "dddddd", 612.0, 792.0)]),
    "edges": ("graph int, pos int, src string, dst string", [(1, 1, "a", "b"), (1, 2, "b", "c"), (1, 3, "a", "c"), (1, 4, "c", "d"), (2, 1, "x", "y"), (2, 2, "x", "z"), (2, 3, "z", "y")]),
    "intervals": ("line int, x0 double, x1 double", [(1, 0.0, 10.0), (1, 10.5, 20.0), (1, 25.0, 30.0), (1, 26.0, 28.0), (2, 5.0, 6.0), (2, 1.0, 2.0), (2, 2.5, 5.2)]),
    "positions": ("axis string, v double", [("x", 10.0), ("x", 11.0), ("x", 30.0), ("x", 31.5), ("x", 33.0), ("y", 5.0)]),
    "todos": ("session long, pos int, status string", [(1, 1, "done"), (1, 2, "done"), (1, 3, "open"), (2, 1, "open")]),
    "names": ("source string, prio int, pos int, name string", [("builtin", 0, 1, "help"), ("builtin", 0, 2, "cost"), ("skill", 1, 1, "cost"), ("skill", 1, 2, "layout"), ("plugin", 2, 1, "layout"), ("plugin", 2, 2, "zeta")]),
    "batch_calls": ("turn int, pos int, safe boolean", [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, False), (1, 5, True), (2, 1, False), (2, 2, True), (2, 3, True)]),
    "captions": ("id int, text string", [(1, "Fig. 3. A plot"), (2, "Figure 12: flow"), (3, "TABLE IV RESULTS"), (4, "图 2 流程"), (5, "表3 数据"), (6, "figured out"), (7, "Table of contents")]),
    "odd_texts": ("id int, text string", [(1, "ﬁne ﬂow ﬀ ﬃ"), (2, "so­ft"), (3, "S P A C E D"), (4, "not spaced"), (5, "a <system-reminder>x\ny</system-reminder> b"), (6, "中文 and latin"), (7, "“q” ‘s’ — x y"), (8, "multi\r\n\nline  text")]),
    "hyphens": ("doc_id long, id int, a string, b string", [(1, 1, "the sharp-", "ness of"), (1, 2, "noise-", "dominated"), (1, 3, "image-to-", "image"), (1, 4, "Swin-", "Transformer"), (1, 5, "CT-", "mamba"), (1, 6, "atten-", "tion"), (1, 7, "1-", "two"), (1, 8, "x-", "y"), (1, 9, "red-", "green"), (2, 10, "sharp-", "ness")]),
    "hyphen_text": ("doc_id long, text string", [(1, "sharpness matters; attention too. red green red green well-known"), (2, "sharp ness sharp ness")]),
    "inserts": ("doc_id long, after int, pos int, text string", [(1, 2, 1, "new one"), (1, 2, 2, "new two"), (1, 0, 1, "first"), (2, 1, 1, "end")]),
    "deletes": ("doc_id long, ordinal int", [(1, 4), (2, 1)]),
    "blocks": ("doc_id long, ordinal int, kind string, text string", [(1, 1, "heading", "# A"), (1, 2, "paragraph", "p"), (1, 3, "list", "- x"), (1, 4, "list", "- y"), (2, 1, "paragraph", "only")]),
    "fonts": ("id int, font string", [(1, "ABCDEF+TimesNewRomanPS-BoldMT"), (2, "Arial,Italic"), (3, "QWERTY+CMR10"), (4, "Helvetica-BoldOblique"), (5, "SimSun"), (6, "abcdef+Lower")]),
    "attempts": ("id int, status int, attempt int, aborted boolean", [(1, 429, 1, False), (2, 500, 3, False), (3, 401, 1, False), (4, 503, 5, False), (5, 200, 1, False), (6, 0, 2, True), (7, 402, 1, False), (8, 0, 1, False), (9, 502, 6, False)]),
    "hooks": ("id int, matcher string, tool string", [(1, "doc_.*", "doc_read"), (2, "doc", "doc_read"), (3, "*", "todo"), (4, None, "todo"), (5, "a|todo", "todo")]),
    "accents": ("id int, text string, x0 double, x1 double, accent string, cx double", [(1, "yz", 10.0, 20.0, "¯", 12.0), (2, "F", 5.0, 9.0, "ˆ", 7.0), (3, "ab", 0.0, 4.0, "~", 9.0), (4, "abc", 0.0, 30.0, "´", 29.9)]),
    "grid_paras": ("id int, before double, after double, content double, line_height double, pitch double", [(1, 3.0, 7.0, 24.0, 12.0, 12.0), (2, 6.0, 6.0, 36.0, 12.0, 12.0), (3, 4.0, 2.0, 29.0, 14.5, 12.0), (4, 0.0, 30.0, 40.0, 15.0, 12.0), (5, 0.0, 0.0, 5.0, 20.0, 12.0)]),
    "scripts": ("doc_id long, page int, elem int, text string, x0 double, x1 double, top double, bottom double, size double", [(1, 1, 1, "The energy E = mc", 72.0, 160.0, 100.0, 110.0, 10.0), (1, 1, 2, "2", 160.5, 164.0, 98.0, 105.0, 7.0), (1, 1, 3, "i", 120.0, 123.0, 106.0, 113.0, 7.0), (1, 1, 4, "far", 400.0, 410.0, 100.0, 107.0, 7.0), (1, 1, 5, "Next line of text", 72.0, 160.0, 112.0, 122.0, 10.0)]),
    "moves": ("doc_id long, ordinal int, text string, moved boolean, anchor boolean", [(1, 1, "a", False, False), (1, 2, "b", True, False), (1, 3, "c", False, False), (1, 4, "d", True, False), (1, 5, "e", False, True), (1, 6, "f", False, False)]),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    """An inline table as a DataFrame."""
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def values_sql(name: str) -> str:
    """The same table as SQL, to stand after FROM."""
    schema, rows = TABLES[name]
    cols = [c.strip().split(" ") for c in schema.split(",")]

    def lit(v: object, kind: str) -> str:
        if v is None:
            return f"CAST(NULL AS {_SQL_TYPES[kind]})"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS {_SQL_TYPES[kind]})"

    body = ", ".join("(" + ", ".join(lit(v, k) for v, (_, k) in zip(r, cols, strict=True)) + ")" for r in rows)
    return f"(VALUES {body}) AS {name}({', '.join(c for c, _ in cols)})"
