"""Page geometry and edits on small pages with known answers."""

import pytest
from pyspark.sql import functions as F

from quire.operators import compare, edits, layout, pages, search

SPAN = "doc_id long, page int, elem int, text string, x0 double, x1 double, top double, bottom double, size double"
SEG = "doc_id long, page int, seg int, x0 double, y0 double, x1 double, y1 double, horizontal boolean"


def spans(spark, rows):
    """Rows (elem, text, x0, x1, bottom) of page 1 of document 1, size 10, or with (page, size)."""
    return spark.createDataFrame([(1, r[5] if len(r) > 5 else 1, r[0], r[1], float(r[2]), float(r[3]), r[4] - (r[6] if len(r) > 6 else 10.0), float(r[4]), r[6] if len(r) > 6 else 10.0) for r in rows], SPAN)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_lines_join_what_shares_a_baseline(spark):
    s = spans(spark, [(1, "one", 72, 100, 110), (2, "two", 104, 130, 110.5), (3, "below", 72, 120, 122), (4, "over", 75, 99, 112), (5, "2", 131, 134, 107, 1, 7.0)])
    lines = pages.assembled_lines(s)
    of = dict(got(lines, "elem", "line"))
    assert of[1] == of[2] == of[5] and of[3] != of[1] and of[4] not in (of[1], of[3])
    table = {r["text"]: (r["x0"], r["x1"], r["size"], r["spans"]) for r in pages.line_table(s, lines).collect()}
    assert table["one two 2"] == (72.0, 134.0, 10.0, 3) and table["below"] == (72.0, 120.0, 10.0, 1)


def two_columns(n, left=250.0, right=320.0):
    return [(i, f"line {i}", 72 + 248 * (i % 2) if right == 320.0 else (72 if i % 2 == 0 else right), left if i % 2 == 0 else 540.0, 100 + 12 * (i // 2)) for i in range(n)]


def test_gutters_need_columns_of_text(spark):
    s = spans(spark, two_columns(24))
    (g,) = pages.column_gutters(s, pages.assembled_lines(s)).collect()
    assert (g["g0"], g["g1"]) == (250.0, 320.0) and 250 < g["x"] < 320
    for rows in (two_columns(6), [(i, "all across", 72, 540, 100 + 12 * i) for i in range(12)], [(i, "label", 72 if i % 2 == 0 else 500, 90 if i % 2 == 0 else 540, 100 + 12 * (i // 2)) for i in range(24)]):
        s = spans(spark, rows)
        assert pages.column_gutters(s, pages.assembled_lines(s)).count() == 0


def test_gutter_consensus(spark):
    g = spark.createDataFrame([(1, 1, 300.0, 290.0, 310.0), (1, 2, 302.0, 291.0, 311.0), (1, 3, 400.0, 390.0, 410.0)], "doc_id long, page int, x double, g0 double, g1 double")
    p = spark.createDataFrame([(1, 1, 0, 40), (1, 2, 0, 40), (1, 3, 0, 40), (1, 4, 1, 10), (1, 5, 9, 10), (1, 6, 0, 3)], "doc_id long, page int, crossing int, lines int")
    assert got(pages.gutter_consensus(g, p), "page", "x", "g0", "g1") == [(1, 302.0, 291.0, 311.0), (2, 302.0, 291.0, 311.0), (3, 400.0, 390.0, 410.0), (4, 302.0, 291.0, 311.0)]


def test_paragraphs_shapes_and_merging(spark):
    rows = [(1, "    First line of a text", 84, 300, 112), (2, "goes on to the edge here", 72, 300, 124), (3, "and on to the edge again", 72, 300, 136), (4, "ends.", 72, 100, 148), (5, "New one", 72, 130, 160), (6, "• item", 72, 300, 172), (7, "far below", 72, 300, 230)]
    lines = spans(spark, rows).withColumn("side", F.lit(0))
    paras = pages.paragraphs(lines)
    assert got(paras, "elem", "para") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4)]
    shapes = {r["para"]: r for r in pages.paragraph_shapes(lines, paras, F.lit(72.0), F.lit(300.0)).collect()}
    assert (shapes[1]["lines"], shapes[1]["indent"], shapes[1]["align"], shapes[1]["last_full"]) == (4, 12.0, "both", False)
    assert shapes[2]["align"] == "left" and shapes[2]["indent"] is None
    text = [(1, "A sentence that the column", True, False), (2, "break cut.", True, False), (3, "Another one", True, False), (4, "Table 2: results", True, False), (5, "中文", True, False), (6, "继续", True, False), (7, "HEAD", True, True), (8, "after", False, False), (9, "last", True, False)]
    p = spark.createDataFrame([(1, o, t, 10.0, "left", 0.0, full, head) for o, t, full, head in text], "doc_id long, ordinal int, text string, size double, align string, first_line double, last_full boolean, heading boolean")
    assert got(pages.merged_paragraphs(p), "first", "last", "text") == [(1, 2, "A sentence that the column break cut."), (3, 3, "Another one"), (4, 6, "Table 2: results 中文继续"), (7, 7, "HEAD"), (8, 8, "after"), (9, 9, "last")]


def grid(rows, cols, missing=()):
    """Segments of a grid of 50 x 20 cells without the unit edges named (horizontal, line, cell)."""
    out = [(True, r, c) for r in range(rows + 1) for c in range(cols)] + [(False, c, r) for c in range(cols + 1) for r in range(rows)]
    return [(1, 1, i, 50.0 * k if h else 50.0 * at, 20.0 * at if h else 20.0 * k, 50.0 * (k + 1) if h else 50.0 * at, 20.0 * at if h else 20.0 * (k + 1), h) for i, (h, at, k) in enumerate(out) if (h, at, k) not in missing]


def test_tables_of_rules(spark):
    s = spark.createDataFrame([*grid(40, 20), (1, 1, 9000, 0.0, 900.0, 40.0, 900.0, True)], SEG)
    (t,) = pages.ruled_tables(layout.segment_components(spark, s), s).collect()
    assert (t["tab"], t["n_rows"], t["n_cols"], t["x1"], t["y1"]) == (0, 40, 20, 1000.0, 800.0)
    s = spark.createDataFrame(grid(3, 3, {(False, 1, 0), (True, 1, 2), (True, 2, 2)}), SEG)  # the first row's first two cells are one, so is the last column
    cells = spark.createDataFrame([(1, 1, 3 * r + c, r + 1, c + 1, 50.0 * c, 50.0 * c + 50, 20.0 * r, 20.0 * r + 20) for r in range(3) for c in range(3)], "doc_id long, page int, cell int, r int, c int, x0 double, x1 double, y0 double, y1 double")
    spansof = got(pages.cell_grid(cells, layout.edge_coverage(cells, s)), "r", "c", "row_span", "col_span")
    assert spansof == [(1, 1, 1, 2), (1, 3, 3, 1), (2, 1, 1, 1), (2, 2, 1, 1), (3, 1, 1, 1), (3, 2, 1, 1)]


def test_edge_coverage_counts_overlaps_once(spark):
    s = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 30.0, 0.0, True), (1, 1, 2, 10.0, 0.0, 30.0, 0.0, True), (1, 1, 3, 5.0, 0.2, 25.0, 0.2, True)], SEG)
    c = spark.createDataFrame([(1, 1, 1, 0.0, 60.0, 0.0, 20.0)], "doc_id long, page int, cell int, x0 double, x1 double, y0 double, y1 double")
    assert ("top", 0.5, False) in got(layout.edge_coverage(c, s), "edge", "share", "border")


def test_booktabs(spark):
    words = [("Name", 72, 100, 118), ("Score", 200, 230, 118), ("ann", 72, 95, 138), ("3", 205, 210, 138), ("bob", 72, 95, 158), ("4", 205, 210, 158), ("more", 200, 225, 170)]
    s = spans(spark, [(i, *w) for i, w in enumerate(words)])
    rules = spark.createDataFrame([(1, 1, i, 70.0, y, 300.0, y, True) for i, y in enumerate((100.0, 122.0, 180.0))], SEG)
    assert got(pages.booktabs(s, rules), "tab", "r", "c", "text") == [(1, 1, 1, "Name"), (1, 1, 2, "Score"), (1, 2, 1, "ann"), (1, 2, 2, "3"), (1, 3, 1, "bob"), (1, 3, 2, "4 more")]


def test_decorations(spark):
    s = spans(spark, [(1, "under", 72, 120, 110), (2, "struck", 72, 120, 140), (3, "form", 72, 100, 170)])
    r = spark.createDataFrame([(1, 1, 1, 72.0, 111.0, 120.0, 111.0, True), (1, 1, 2, 72.0, 137.0, 120.0, 137.0, True), (1, 1, 3, 72.0, 171.0, 300.0, 171.0, True)], SEG)
    assert got(pages.decorations(s, r), "elem", "kind") == [(1, "underline"), (2, "strike")]


def test_figures_and_equations(spark):
    box = lambda *v: (1, 1, *map(float, v[:4]), *v[4:], 484704.0)
    b = spark.createDataFrame([box(100, 100, 120, 120, 1, 0, 0), box(124, 100, 150, 120, 0, 0, 0), box(152, 100, 180, 125, 0, 0, 0), box(400, 400, 500, 420, 0, 0, 0), box(0, 0, 612, 780, 1, 1, 0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, curvy int, coloured int, image int, area double")
    assert pages.figures(b.limit(4)).count() in (0, 1)
    assert got(pages.figures(b.filter("x1 < 600")), "figure", "x0", "x1", "paths") == [(1, 100.0, 180.0, 3)]
    lines = spans(spark, [(1, "We define the loss as", 72, 300, 112), (2, "L = a + b", 120, 180, 126), (3, "n", 140, 145, 136), (4, "where nothing follows", 72, 300, 150), (5, "y = c (12)", 74, 298, 165), (6, "short", 120, 150, 190)]).withColumn("rx0", F.lit(72.0)).withColumn("rx1", F.lit(300.0))
    assert got(pages.equations(lines), "first", "last", "numbered") == [(2, 3, False), (5, 5, True)]


def test_running_lines_and_headers(spark):
    rows = [(1, f"Page {p} of 9", 280, 330, 768.0 + p % 2, p) for p in range(1, 7)] + [(2, "Journal", 72, 120, 50, p) for p in (1, 3, 5)] + [(3, f"Clause {p * p}.4 begins", 72, 300, 700, p) for p in (1, 2)] + [(4, "once", 72, 100, 40, 2)]
    s = spans(spark, rows)
    assert got(pages.running_lines(s), "page", "elem") == sorted([(p, 1) for p in range(1, 7)] + [(1, 2), (3, 2), (5, 2)])
    top = spans(spark, [(1, f"Title {p}", 72, 100, 60, p) for p in (1, 2, 3, 4)] + [(2, "Odd", 200, 240, 60, p) for p in (3,)])
    off = spark.createDataFrame([(1, 0)], "doc_id long, shift int")
    assert got(pages.header_set(top, off), "kind", "header", "pages") == [("even", "Title {PAGE}", 2), ("first", "Title {PAGE}", 1), ("odd", "Title {PAGE}\nOdd", 1)]


def test_page_texts(spark):
    items = [(1, 1, i, t, y, 10.0, e) for i, (t, y, e) in enumerate([("Two ", 700.0, False), ("words", 700.5, True), ("go on", 688.0, True), ("hy-", 676.0, True), ("phen", 664.0, True), ("New", 620.0, True), ("  ", 610.0, True)])]
    df = spark.createDataFrame(items, "doc_id long, page int, pos int, text string, y double, h double, eol boolean")
    assert got(pages.page_texts(df), "para", "text") == [(1, "Two words go on hy-phen"), (2, "New")]


def test_highlights(spark):
    s = spans(spark, [(1, "lit", 72, 100, 110), (2, "half", 100, 140, 110), (3, "not", 300, 340, 110)])
    f = spark.createDataFrame([(1, 1, 1, 70.0, 115.0, 99.0, 111.0, "ffff00", 612.0, 792.0), (1, 1, 2, 0.0, 612.0, 99.0, 111.0, "00ff00", 612.0, 792.0), (1, 1, 3, 115.0, 141.0, 99.0, 111.0, "ff0000", 612.0, 792.0)], "doc_id long, page int, fill int, x0 double, x1 double, top double, bottom double, color string, width double, height double")
    assert got(layout.highlights(s, f), "elem", "color") == [(1, "ffff00"), (2, "ff0000")]


def test_page_ranges_of_all_forms(spark):
    specs = ["1-3", "第3至5页", "前2，4", "9-", "-2", "5～3", "x", "1,x", "", "99"]
    df = spark.createDataFrame([(i, t, 10) for i, t in enumerate(specs)], "doc_id long, spec string, total int")
    out = {}
    for i, p in got(layout.parsed_ranges(df), "doc_id", "page"):
        out.setdefault(i, []).append(p)
    assert out == {0: [1, 2, 3], 1: [3, 4, 5], 2: [1, 2, 4], 3: [9, 10], 4: [1, 2], 5: [3, 4, 5]}


def test_levels_and_components_without_caps(spark):
    chain = [(1, i, f"n{i:03}", f"n{i + 1:03}") for i in range(100)]
    cycle = [(2, 0, "a", "b"), (2, 1, "b", "c"), (2, 2, "c", "a")]
    df = spark.createDataFrame(chain + cycle, "graph int, pos int, src string, dst string")
    assert got(layout.diagram_levels(spark, df), "graph", "node", "level") == sorted([(1, f"n{i:03}", i) for i in range(101)] + [(2, "a", 0), (2, "b", 1), (2, "c", 2)])


def test_gutter_counts_equal_brute_force(spark):
    rows = [(i, "w", 72 + (i * 37) % 200, 280 + (i * 53) % 260 if i % 3 == 0 else 80 + (i * 37) % 200, 100 + 12 * i) for i in range(40)]
    (g,) = layout.gutters(spans(spark, rows)).collect()
    lo, hi = min(r[2] for r in rows), max(r[3] for r in rows)
    xs = [x for x in range(1000) if lo + 0.3 * (hi - lo) <= x <= lo + 0.7 * (hi - lo)]
    score = lambda x: min(sum(r[3] <= x for r in rows), sum(r[2] >= x for r in rows)) - sum(r[2] < x < r[3] for r in rows)
    assert (g["score"], g["x"]) == max(((score(x), x) for x in xs), key=lambda t: (t[0], -t[1]))


def test_carry_over_rules():
    long = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest where nobody ever finds it again so that people still talk about it today with much awe"
    base = [long, "Figure 3. A plot of the values", "x", long.replace("fox", "cat"), "short text of few words here"]
    edited = [long.replace("lazy", "sleepy"), "Figure 3. A plot of all the values", "x", long.replace("fox", "cat"), "short text of few words now"]
    fresh = [long, "Figure 4. A plot of the values", long.replace("fox", "cat"), "short text of many words here"]
    got_ = compare.carry(base, edited, fresh)
    assert got_ == [(1, "apply", edited[0]), (2, "other_label", fresh[1]), (4, "weak", fresh[3])]
    assert compare.carry([long], [long.replace("far", "f2")], [long])[0][1] == "apply" and compare.carry([long + " i1"], [long + " i2"], [long + " i1"])[0][1] == "notation"
    assert compare.carry(None, [long + " more"], ["⟨图片⟩ " + long])[0][1] == "object" and compare.carry([long], [long + "!"], [long]) == [(1, "same", long)]
    assert [compare.label(t) for t in ("FIGURE 9. x", "Table  VII y", "D. z", "2) w", "plain")] == ["FIGURE 9", "TABLE VII", "D.", "2)", None]
    assert [compare.notation(t) for t in ("i", "x1", "nth", "words")] == [True, True, True, False]


def test_word_map_and_previews():
    doc = [f"w{i}" for i in range(200)]
    page = doc[:20] + ["extra"] + doc[20:50] + doc[80:]
    at = compare.matched_words(doc, page)
    assert at == [*range(20), -1, *range(20, 50), *range(80, 200)]
    assert compare.inline_diff("a b c", "a x c") == [("same", "a "), ("removed", "b"), ("added", "x"), ("same", " c")]
    assert compare.inline_diff("中文字", "中英字") == [("same", "中"), ("removed", "文"), ("added", "英"), ("same", "字")]
    long = compare.inline_diff("start " + "word " * 60 + "end", "start " + "word " * 60 + "fin")
    assert [k for k, _ in long] == ["skipped", "same", "removed", "added"] and "".join(t for k, t in long if k != "added") == "start " + "word " * 60 + "end"
    assert compare.source_offsets("a&b c", "a&amp;b c") == [0, 1, 6, 7, 8, 9] and compare.source_offsets("ab", "ax") is None
    assert compare.source_offsets("x\ny", "x\r\ny") == [0, 2, 3, 4]


def test_edit_statuses(spark):
    assert got(edits.atom_guard(spark.createDataFrame([(1, "a⟨x⟩b", 0, 1), (2, "a⟨x⟩b", 0, 2), (3, "a⟨x⟩b", 4, 5), (4, "a⟨x⟩b⟨y⟩", 6, 7), (5, "ab", 0, 2)], "id int, text string, start int, end int")), "id", "status") == [(1, "ok"), (2, "protected"), (3, "ok"), (4, "protected"), (5, "ok")]
    r = edits.guarded(spark.createDataFrame([(1, "a⟨x⟩⟨y⟩", "b⟨y⟩⟨x⟩"), (2, "a⟨x⟩", "a")], "doc_id long, old string, new string"))
    assert got(r, "doc_id", "status", "text") == [(1, "ok", "b⟨y⟩⟨x⟩"), (2, "reverted", "a⟨x⟩")]
    docs = spark.createDataFrame([(1, "say “q” twice “q”"), (2, "no"), (3, 'one "q"')], "doc_id long, text string")
    assert got(search.replaced_tolerant(docs, '"q"', "Z"), "doc_id", "status", "places", "text") == [(1, "ambiguous", 2, "say “q” twice “q”"), (2, "not_found", 0, "no"), (3, "ok", 1, "one Z")]
    assert got(search.replaced_tolerant(docs, '"q"', "Z", True).filter("doc_id = 1"), "text") == [("say Z twice Z",)]


@pytest.mark.parametrize("text, want", [("T I T L E  O F", "TITLE OF"), ("no change", "no change"), ("A B C D", "ABCD")])
def test_letters_joined(spark, text, want):
    from quire.functions.text import letters_joined

    assert spark.createDataFrame([(text,)], "t string").select(letters_joined(F.col("t"))).first()[0] == want
