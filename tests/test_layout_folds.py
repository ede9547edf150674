"""Blocks side by side, medians and page ranges against brute-force versions."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import beside, layout, pages


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 20)), max_size=8))
def test_what_spans_leave_free(cuts):
    free = [(0.0, 60.0)]
    for a, w in cuts:
        free = beside.without(free, a, a + w)
    open_ = {x for x in range(60) if not any(a <= x and x + 1 <= a + w for a, w in cuts)}
    assert {x for p, q in free for x in range(int(p), int(q))} == open_ and free == sorted(free)


def page(spark, lines, rules, doc=1, no=1):
    """Lines of (text, x0, x1) spans at a pitch of 12, and rules of (y, x0, x1)."""
    spans = [(doc, no, 100 * i + k, t, float(a), float(b), 100.0 + 12 * i, 110.0 + 12 * i, 10.0, 792.0) for i, line in enumerate(lines) for k, (t, a, b) in enumerate(line)]
    s = spark.createDataFrame(spans, "doc_id long, page int, elem int, text string, x0 double, x1 double, top double, bottom double, size double, height double")
    r = spark.createDataFrame([(doc, no, float(y), float(a), float(b)) for y, a, b in rules], "doc_id long, page int, y double, x0 double, x1 double")
    return beside.side_by_side(s, pages.assembled_lines(s), r).collect()


def test_blocks_beside_each_other(spark):
    key, text = ("keywords", 72, 150), ("words of the abstract", 200, 540)
    across = [("a line across the whole page", 72, 540)]
    block = [[key, text]] * 6
    heads = [(111, 72, 120), (111.5, 200, 260)]
    got = page(spark, [across, *block, across, across], [(123, 72, 120), (123.5, 200, 260)])
    assert [(r.block, r.lines, r.border, r.rule, r.y0, r.y1) for r in got] == [(1, 6, 175.0, 123.0, 111.0, 183.0)] and got[0].left == "\n".join(["keywords"] * 6)
    assert not page(spark, block, []) and not page(spark, block, heads[:1])  # no rules, six lines only
    assert len(page(spark, [[key, text]] * 8, [])) == 1 and not page(spark, [[key, text]] * 8, [], no=2)
    assert not page(spark, block[:5] + [across] + block[:5], heads)  # five lines each
    assert not page(spark, [[("k", 72, 150), text]] * 6, heads)  # few characters
    assert not page(spark, [[("left side of the text", 72, 300), ("right side of the text", 320, 540)]] * 9, heads)  # the corridor is in the middle
    gone = page(spark, [[key, text]] * 3 + [[("", 72, 80), text]] + [[text]] + [[key, text]] * 3, heads)
    assert [(r.lines, r.left.count("\n")) for r in gone] == [(8, 5)]


def test_upper_median_against_sorting(spark):
    r = random.Random(4)
    rows = [(k, v) for k, values in enumerate([[1.0], [1.0, 2.0], [5.0] * 50 + [9.0] * 50, [r.random() for _ in range(3001)], [r.choice([1e9, -1e9, 0.5]) for _ in range(500)], [r.gauss(0, 1) ** 9 for _ in range(5000)], [None, None]]) for v in values]
    got = {x.k: x.median for x in layout.upper_median(spark.createDataFrame(rows + [(None, 3.0)], "k int, v double"), "k", "v").collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in by.items()}


def test_page_ranges_of_any_length(spark):
    r = random.Random(6)
    numbers = ["0", "1", "3", "7", "12", "007", "99999999999", "2147483648", "9" * 50]
    specs = [",".join(r.choice([r.choice(numbers), r.choice(numbers) + "-" + r.choice(numbers), r.choice(numbers) + "-", "-" + r.choice(numbers), "x"] if r.random() < 0.1 else [r.choice(numbers), r.choice(numbers) + "-" + r.choice(numbers)]) for _ in range(r.randint(1, 3))) for _ in range(200)]
    want = set()
    for i, s in enumerate(specs):
        found = set()
        for part in s.split(","):
            m = re.fullmatch(r"(\d+)?(-)?(\d+)?", part)
            if not m or not (m[1] or m[3]):
                found = set()
                break
            a = int(m[1]) if m[1] else 1
            b = (int(m[3]) if m[3] else 10) if m[2] else a
            found |= set(range(max(1, min(a, b)), min(10, max(a, b)) + 1))
        want |= {(i, p) for p in found}
    got = layout.parsed_ranges(spark.createDataFrame([(i, s, 10) for i, s in enumerate(specs)], "doc_id long, spec string, total int"))
    assert {(x.doc_id, x.page) for x in got.collect()} == want


def test_letter_spaced_spans(spark):
    from quire.operators import spacing

    def letters(elem, text, x=72.0, step=8.0, bottom=110.0, font="Serif", page=1):
        return [(1, page, elem + k, c, x + step * k, x + step * k + 5, bottom - 10, bottom, 10.0, font, False) for k, c in enumerate(text) if c != " "]

    rows = letters(100, "ART ICLE") + letters(200, "abc", bottom=130.0) + letters(300, "ab", bottom=150.0) + letters(310, "cd", x=88.0, bottom=150.0, font="Sans")
    rows += letters(400, "wxyz", bottom=170.0) + [(1, 1, 450, "sub", 85.0, 88.0, 165.0, 172.0, 5.0, "Serif", False)]  # something between two letters
    rows += [(1, 1, 500 + k, c, float(x), x + 5.0, 180.0, 190.0, 10.0, "Serif", False) for k, (c, x) in enumerate(zip("uneven", (72, 78, 87, 94, 106, 115)))]
    rows += [(1, 1, 600, "whole word", 72.0, 150.0, 200.0, 210.0, 10.0, "Serif", False), (1, 1, 601, "", 160.0, 161.0, 200.0, 210.0, 10.0, "Serif", False), (1, 1, 602, None, 170.0, 171.0, 200.0, 210.0, 10.0, "Serif", False)]
    rows += letters(700, "PAGE", page=2)
    df = spark.createDataFrame(rows, "doc_id long, page int, elem int, text string, x0 double, x1 double, top double, bottom double, size double, font string, bold boolean")
    got = sorted(spacing.merged_letters(df).select("page", "elem", "text", "x0", "x1").collect())
    words = {(r.page, r.elem, r.text): (r.x0, r.x1) for r in got if r.text and len(r.text) > 1}
    assert words == {(1, 100, "ART"): (72.0, 93.0), (1, 104, "ICLE"): (104.0, 133.0), (1, 450, "sub"): (85.0, 88.0), (1, 600, "whole word"): (72.0, 150.0), (2, 700, "PAGE"): (72.0, 101.0)}
    assert len(got) == len(rows) - len("ARTICLE") - len("PAGE") + 3
    assert spacing.merged_letters(df.limit(0)).count() == 0


def test_grids_of_charts(spark):
    from quire.operators import charts

    tables = spark.createDataFrame([(1, 1, k, 0.0, 100.0, 200.0 * k, 200.0 * k + 100, 2, 2) for k in range(8)] + [(2, 1, 0, 0.0, 100.0, 0.0, 100.0, 2, 2)], "doc_id long, page int, tab int, x0 double, x1 double, y0 double, y1 double, n_rows int, n_cols int")
    path = lambda k, x0=10.0, x1=90.0, a=10.0, b=90.0, curved=True: (1, 1, x0, 200.0 * k + a, x1, 200.0 * k + b, curved, False)
    paths = [path(0), path(1, x1=110.0), path(2, x1=180.0), path(3, 10.0, 20.0, 10.0, 20.0), path(4, curved=False), path(5)]
    fills = [(1, 1, 10.0, 20.0, 1210.0, 1220.0, c) for c in ("ff0000", "00ff00", "0000ff")] + [(1, 1, 10.0, 20.0, 1410.0, 1420.0, c) for c in ("ff0000", "00ff00", "808080", "red", None)]
    spans = [(1, 1, "a b c d e f g h i", 10.0, 90.0, 1040.0, 1060.0), (1, 1, "few words", 10.0, 90.0, 40.0, 60.0), (1, 1, None, 10.0, 90.0, 40.0, 60.0), (1, 1, "a label outside of the grid", 0.0, 100.0, 110.0, 120.0)]
    made = [spark.createDataFrame(r, s) for r, s in ((paths, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, curved boolean, diagonal boolean"), (fills, "doc_id long, page int, x0 double, x1 double, top double, bottom double, color string"), (spans, "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double"))]
    got = {(r.doc_id, r.tab) for r in charts.without_chart_grids(tables, *made).collect()}
    # 0 a curve and eight letters; 1 mostly inside; 2 mostly outside; 3 small; 4 straight; 5 nine letters; 6 three colours; 7 two colours
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (1, 7), (2, 0)}
    assert charts.without_chart_grids(tables, *(m.limit(0) for m in made)).count() == 9 and charts.without_chart_grids(tables.limit(0), *made).count() == 0
