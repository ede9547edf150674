"""Tab stops, indents, equations with fractions and tables parted at captions, on small pages with known answers."""

import random

from quire.operators import fractions, pages, tabs

PARA = "doc_id long, page int, para int, line int, elem int, text string, x0 double, x1 double, size double, rx0 double, rx1 double"


def para(spark, lines, size=10.0):
    """Lines of (text, x0, x1), as paragraph 1 of a column from 72 to 540."""
    return spark.createDataFrame([(1, 1, 1, k, j, t, float(a), float(b), size, 72.0, 540.0) for k, line in enumerate(lines) for j, (t, a, b) in enumerate(line)], PARA)


def indents(spark, lines):
    return [(r.lines, r.left, r.first_line, r.hanging) for r in tabs.paragraph_indents(para(spark, lines)).collect()]


def stops(spark, lines):
    s = para(spark, lines)
    return [(r.pos, r.align, r.gaps) for r in sorted(tabs.tab_stops(s, tabs.paragraph_indents(s)).collect(), key=lambda r: r.stop)]


def test_indents(spark):
    text = ("text of the line", 90, 400)
    assert indents(spark, []) == [] and indents(spark, [[("one line", 72, 400)]]) == [(1, 0, 0, False)]
    assert indents(spark, [[("first", 92, 400)], [("second", 72, 400)]]) == [(2, 0, 20, False)]
    assert indents(spark, [[("(1)", 72, 84), text], [text]]) == [(2, 18, -18, True)] and indents(spark, [[("1.2", 72, 84), text], [text]]) == [(2, 18, -18, True)]
    assert indents(spark, [[("(1)", 72, 84), text]]) == [(1, 18, -18, True)] and indents(spark, [[("one", 72, 84), text]]) == [(1, 0, 0, False)]
    assert indents(spark, [[("(1)", 72, 87), text]]) == [(1, 0, 0, False)]  # too near to stand apart
    assert indents(spark, [[("(1)", 72, 95), ("behind", 110, 400)], [text]]) == [(2, 18, -18, True)]  # wider than the indent
    assert indents(spark, [[("(1)", 72, 80), ("behind", 110, 400)], [text]]) == [(2, 18, -18, False)]
    assert indents(spark, [[(None, 72, 84), text], [("", 90, 400)]]) == [(2, 18, -18, False)]


def test_tab_stops(spark):
    assert stops(spark, [[("a", 72, 100), ("b", 112, 200)]]) == [] and stops(spark, [[("a", 72, 100), ("b", 112.5, 200)]]) == [(40.5, "left", 1)]
    assert stops(spark, [[("a", 72, 100), ("b", 200, 220), ("9", 500, 539)]]) == [(128, "left", 1), (467, "right", 1)]
    assert stops(spark, [[("a", 72, 100), ("b", 200, 220)], [("a", 72, 90), ("b", 200.9, 220)], [("a", 72, 90), ("b", 201, 220)]]) == [(128, "left", 2), (129, "left", 2)]
    assert stops(spark, [[("(1)", 72, 95), ("behind", 110, 400)], [("text", 90, 400)]]) == [(38, "left", 1)]
    assert stops(spark, [[("(1)", 72, 76), ("behind", 90, 400)], [("text", 90, 400)]]) == []


def test_tab_stops_against_a_walk(spark):
    """Stops of random paragraphs against a walk over their lines in reading order."""
    r = random.Random(7)
    for _ in range(12):
        lines = []
        for _ in range(r.randint(1, 6)):
            x, line = 72.0 + r.choice([0, 20]), []
            for j in range(r.randint(1, 5)):
                w = r.randint(5, 60)
                line.append((f"t{j}", x, x + w))
                x += w + r.choice([3, 11, 12, 13, 30, 30.4, 31])
            lines.append([s for s in line if s[2] <= 540])
        want, ends = [], []
        for line in lines:
            for j in range(1, len(line)):
                if line[j][1] - line[j - 1][2] > 12:
                    last = all(line[k][1] - line[k - 1][2] <= 12 for k in range(j + 1, len(line))) and 540 - line[-1][2] <= 3
                    ends.append((round((line[-1][2] if last else line[j][1]) * 20 - 72 * 20) / 20, "right" if last else "left"))
        for pos, align in ends:
            if all(abs(pos - p) >= 1 for p, _ in want):
                want.append((pos, align))
        assert [(round(p, 6), a, n) for p, a, n in stops(spark, lines)] == [(round(p, 6), a, sum(abs(p - q) < 1 for q, _ in ends)) for p, a in sorted(want)]


EQ = "doc_id long, page int, line int, elem int, text string, x0 double, x1 double, top double, bottom double, baseline double, size double, math boolean, italic boolean, rx0 double, rx1 double"


def equations(spark, lines, bars=()):
    """Spans (line, text, x0, x1, baseline, font) and bars (x0, x1, y) of a column from 72 to 540."""
    s = spark.createDataFrame([(1, 1, n, k, t, float(a), float(b), y - 9.0, y + 2.0, float(y), 10.0, f == "m", f == "i", 72.0, 540.0) for k, (n, t, a, b, y, f) in enumerate(lines)], EQ)
    r = spark.createDataFrame([(1, 1, float(a), float(y), float(b), y + 0.5) for a, b, y in bars], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    return [(e.first, e["last"], e.numbered, e.fraction) for e in sorted(fractions.stacked_equations(s, r).collect(), key=lambda e: e.first)]


def test_equations_with_fractions(spark):
    y = [(2, "y", 72, 78, 207, "i"), (2, "=", 82, 90, 207, "")]
    over, under, bar = (1, "2a + b", 100, 150, 200, ""), (3, "c + 3d", 100, 150, 214, ""), (98, 152, 203)
    assert equations(spark, [over, *y, under], [bar]) == [(1, 3, False, True)]
    assert equations(spark, [over, *y, under]) == [] and equations(spark, [over, *y], [bar]) == [] and equations(spark, []) == []  # no bar, nothing under it
    assert equations(spark, [over, under], [bar]) == []  # nothing says that it is an equation
    assert equations(spark, [over, *y, under], [(98, 500, 203)]) == [] and equations(spark, [over, *y, (3, "c + 3d", 100, 150, 240, "")], [bar]) == []
    words = (0, "some words of the text", 72, 500, 180, "")
    assert equations(spark, [words, over, *y, under, (4, "and more words of it", 72, 500, 232, "")], [bar]) == [(1, 3, False, True)]
    main = (2, "loss = ln ( )", 72, 200, 207, "")
    assert equations(spark, [over, main, under, (2, "x", 205, 210, 207, "m")], [bar]) == [(1, 3, False, True)]  # the bar lies inside the line
    assert equations(spark, [(1, "f = g", 200, 260, 200, "m")]) == [(1, 1, False, False)] and equations(spark, [(1, "f = g", 80, 260, 200, "m")]) == []  # indented, or not
    assert equations(spark, [(1, "f = g", 80, 260, 200, "m"), (1, "(3)", 520, 539, 200, "")]) == [(1, 1, True, False)]
    assert equations(spark, [(1, "∑ f", 80, 260, 200, "m")]) == [(1, 1, False, False)]
    assert equations(spark, [(1, "this is = prose text", 200, 260, 200, "")]) == [] and equations(spark, [(1, None, 200, 260, 200, "")]) == []
    far = [(1, "f = g", 200, 260, 200, "m"), (2, "h = k", 200, 260, 230, "m"), (3, "l = m", 200, 260, 243, "m")]
    assert equations(spark, far) == [(1, 1, False, False), (2, 3, False, False)]


def booktabs(spark, texts, rules):
    s = spark.createDataFrame([(1, 1, k, t, float(a), float(b), float(y), y + 10.0, 10.0) for k, (t, a, b, y) in enumerate(texts)], "doc_id long, page int, elem int, text string, x0 double, x1 double, top double, bottom double, size double")
    r = spark.createDataFrame([(1, 1, k, 72.0, float(y), 540.0, float(y), True) for k, y in enumerate(rules)], "doc_id long, page int, seg int, x0 double, y0 double, x1 double, y1 double, horizontal boolean")
    return sorted((x.tab, x.r, x.c, x.text) for x in pages.booktabs(s, r).collect())


def test_tables_are_parted(spark):
    rows = lambda y, c: [(f"{c}{k}", 74 + 200 * (k % 2), 100 + 200 * (k % 2), y + 12 * (k // 2)) for k in range(4)]
    two, rules = rows(101, "a") + rows(201, "b"), [99, 126, 199, 226]
    tabs_of = lambda texts: sorted({(t[0], t[3][0]) for t in booktabs(spark, texts, rules) if t[3][0] in "ab"})
    one = [(1, "a"), (1, "b")]
    assert tabs_of(two) == one
    parted = [(1, "a"), (2, "b")]
    assert tabs_of([*two, ("Table 2. More", 74, 130, 180)]) == tabs_of([*two, ("表 2", 74, 90, 180)]) == tabs_of([*two, ("TAB. IV", 74, 110, 180)]) == parted
    assert tabs_of([*two, ("one line of prose that goes on", 74, 400, 160)]) == parted
    assert tabs_of([*two, ("one line of", 74, 200, 160), ("prose that goes on", 203, 400, 160)]) == parted
    assert tabs_of([*two, ("one line of", 74, 200, 160), ("cells that go on", 274, 400, 160)]) == one  # a gap as between columns
    assert tabs_of([*two, ("few words here", 74, 100, 160)]) == one and tabs_of([*two, ("Tables of it", 74, 100, 180)]) == one
