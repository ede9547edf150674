"""Figures with labels, pictures in rows and columns, and the store of versions, on small inputs with known answers."""

import datetime as dt

import pytest

from quire.operators import figures
from quire.streaming import sessions

BOX = "doc_id long, page int, {} int, x0 double, y0 double, x1 double, y1 double"
SPAN = "doc_id long, page int, elem int, text string, x0 double, x1 double, top double, bottom double, size double"


def boxes(spark, name, rows, more=""):
    return spark.createDataFrame([(1, 1, k, *map(float, r[:4]), *r[4:]) for k, r in enumerate(rows)], BOX.format(name) + more)


def spans(spark, rows):
    return spark.createDataFrame([(1, 1, k, t, *map(float, r)) for k, (t, *r) in enumerate(rows)], SPAN)


def page(spark):
    return spark.createDataFrame([(1, 1, 600.0, 800.0, 10.0), (2, 1, 600.0, 800.0, 10.0)], "doc_id long, page int, width double, height double, body double")


def grids(spark, images, texts):
    got = figures.image_grids(boxes(spark, "image", images), spans(spark, texts), page(spark)).collect()
    return [(r.x0, r.y0, r.x1, r.y1, r.images, r.marks, r.text) for r in sorted(got, key=lambda r: r.grid)]


def test_pictures_in_rows_and_columns(spark):
    two = [(100, 100, 180, 160), (200, 100, 280, 160)]
    assert grids(spark, two, []) == [(99, 99, 281, 161, 2, 0, "")]
    assert grids(spark, two, [("(a)", 130, 142, 162, 170, 8), ("(b)", 230, 242, 162, 170, 8)]) == [(99, 99, 281, 171, 2, 2, "(a) (b)")]
    # A caption whose line begins with a mark isn't a row of marks.
    assert grids(spark, two, [("(a)", 110, 122, 164, 172, 8), ("the left picture", 124, 200, 164, 172, 8)]) == [(99, 99, 281, 161, 2, 0, "")]
    assert grids(spark, two[:1] + [(400, 100, 480, 160)], []) == [] and grids(spark, two[:1] + [(200, 100, 219, 120)], []) == []  # far, small
    assert grids(spark, [(100, 100, 180, 160), (100, 185, 180, 245)], [("Figure 1", 100, 150, 165, 175, 8)]) == []
    assert len(grids(spark, [(100, 100, 180, 160), (100, 185, 180, 245)], [("word", 100, 150, 165, 175, 8)])) == 1
    assert grids(spark, two, [("w" * 81, 110, 270, 120, 130, 10)]) == [] and len(grids(spark, two, [("w" * 80, 110, 270, 120, 130, 10)])) == 1
    assert grids(spark, two, [("beside the photograph", 262, 400, 120, 130, 10)]) == [(99, 99, 281, 161, 2, 0, "")]
    assert grids(spark, two, [("beside the photograph", 250, 330, 120, 130, 10)]) == []
    assert grids(spark, [*two, (300, 50, 290, 60)], [(None, 100, 110, 120, 130, 10), ("", 100, 110, 120, 130, 10)]) == [(99, 99, 281, 161, 2, 0, "")]


def labelled(spark, paths, texts=(), images=(), tables=(), turned=()):
    got = figures.labelled_figures(
        boxes(spark, "path", [(*p, 1, 0) for p in paths], ", curvy int, coloured int"), boxes(spark, "image", images), spans(spark, texts), page(spark), boxes(spark, "tab", tables), boxes(spark, "elem", [(*t, 9.0) for t in turned], ", size double")
    ).collect()
    return [(r.x0, r.y0, r.x1, r.y1, r.labels, r.text) for r in sorted(got, key=lambda r: r.figure)]


def test_figures_with_their_labels(spark):
    fig = [(100, 100, 140, 140), (145, 100, 200, 140)]
    plain = (99, 99, 201, 141, 0, "")
    assert labelled(spark, fig) == [plain] and labelled(spark, fig[:1]) == [] and labelled(spark, []) == []
    assert labelled(spark, fig, [("axis", 120, 150, 143, 151, 8)]) == [(99, 99, 201, 152, 1, "axis")]
    assert labelled(spark, fig, [("body", 120, 150, 143, 153, 10)]) == labelled(spark, fig, [("Fig. 1: x", 120, 150, 143, 151, 8)]) == [plain]
    # Against the order of reading, one label after another is reached in the second round.
    assert labelled(spark, fig, [("far", 120, 150, 155, 163, 8), ("near", 120, 150, 144, 152, 8)]) == [(99, 99, 201, 164, 2, "far near")]
    chain = [(f"t{k}", 120, 150, 144 + 12 * k, 152 + 12 * k, 8) for k in range(6)]
    assert labelled(spark, fig, chain[::-1])[0][3] == 152 + 12 * 3 + 1  # the fourth label; four rounds, no more
    other = [(240, 100, 280, 140), (285, 100, 340, 140)]
    assert labelled(spark, fig + other) == [(99, 99, 341, 141, 0, "")]
    assert len(labelled(spark, fig + other, [("text in between", 205, 235, 115, 125, 10)])) == 2
    assert len(labelled(spark, fig + other, [("Table 1: a", 110, 190, 160, 170, 10), ("Table 2: b", 250, 330, 160, 170, 10)])) == 2
    assert len(labelled(spark, fig + [(240, 60, 280, 140), (285, 60, 340, 140)])) == 2  # not level
    assert labelled(spark, [*fig, (220, 110, 240, 130)]) == [(99, 99, 241, 141, 0, "")] and labelled(spark, fig, images=[(220, 110, 240, 130)]) == [(99, 99, 241, 141, 0, "")]
    assert labelled(spark, [*fig, (220, 110, 240, 130)], [("word", 208, 212, 115, 125, 10)]) == [plain] and labelled(spark, [*fig, (300, 110, 320, 130)]) == [plain]
    assert labelled(spark, fig, tables=[(90, 90, 210, 150)]) == [] and labelled(spark, fig, tables=[(90, 90, 150, 150)]) == [plain]
    assert labelled(spark, fig, turned=[(88, 100, 95, 140)]) == [(87, 99, 201, 141, 0, "")]
    assert labelled(spark, fig, [("z" * 161, 105, 195, 110, 120, 10)]) == [] and len(labelled(spark, fig, [("z" * 160, 105, 195, 110, 120, 10)])) == 1


EDIT = "session bigint, edit_id string, at timestamp, label string, format string, content binary"


def edits(spark, rows):
    return spark.createDataFrame([(s, e, dt.datetime(2024, 1, 1 + n // 24, n % 24), "edit", "md", c) for s, e, n, c in rows], EDIT)


def state(spark, store):
    return sorted((r.session, r.v, bytes(r.content)) for r in sessions.history(spark, store).collect())


def test_store_of_versions(spark, tmp_path):
    source, store, mark = (f"file://{tmp_path}/{n}" for n in ("in", "store", "mark"))
    assert not state(spark, store) and not sessions.current(spark, store).collect()
    edits(spark, [(1, "a", 3, b"one"), (1, "b", 1, b"\x00\xff"), (2, "c", 2, b"")]).write.parquet(source)
    sessions.ingest(spark, source, EDIT, store, mark)
    first = [(1, 0, b"\x00\xff"), (1, 1, b"one"), (2, 0, b"")]
    assert state(spark, store) == first
    sessions.ingest(spark, source, EDIT, store, mark)  # nothing new
    assert state(spark, store) == first
    # Repeated edits, edits repeated in one arrival, edits without a session, and what comes late is numbered behind.
    edits(spark, [(1, "a", 3, b"one"), (1, "d", 0, b"late"), (1, "d", 0, b"late"), (3, "e", 40, b"x"), (3, "f", 40, b"y"), (None, "g", 1, b"z"), (3, None, 1, b"z")]).write.mode("append").parquet(source)
    sessions.ingest(spark, source, EDIT, store, mark)
    second = sorted([*first, (1, 2, b"late"), (3, 0, b"x"), (3, 1, b"y")])
    assert state(spark, store) == second
    back = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (9, 0)], "session bigint, to int")
    for _ in range(2):
        sessions.roll_back(spark, store, back, "r1")
        assert state(spark, store) == sorted([*second, (1, 3, b"\x00\xff")])
    got = {r.session: (r.v, r.label, bytes(r.content)) for r in sessions.current(spark, store).collect()}
    assert got == {1: (3, "回滚到 v0", b"\x00\xff"), 2: (0, "edit", b""), 3: (1, "edit", b"y")}
    assert sorted((r.session, bytes(r.content)) for r in sessions.originals(spark, store).collect()) == [(1, b"\x00\xff"), (2, b""), (3, b"x")]
    assert sorted((r.name, bytes(r.content)) for r in sessions.exports(spark, store).collect()) == [("s1-v0003.md", b"\x00\xff"), ("s2-v0000.md", b""), ("s3-v0001.md", b"y")]


@pytest.mark.parametrize("lost", ["heads", "mark"])
def test_store_takes_up_a_batch_that_died(spark, tmp_path, lost):
    """A batch whose versions are written but whose heads are not is written again; one that is complete but that the stream has not noted is skipped, even after a return."""
    import os
    import shutil

    source, store, mark = (f"file://{tmp_path}/{n}" for n in ("in", "store", "mark"))
    edits(spark, [(1, "a", 1, b"one"), (1, "b", 2, b"two")]).write.parquet(source)
    sessions.ingest(spark, source, EDIT, store, mark)
    edits(spark, [(1, "c", 3, b"three")]).write.mode("append").parquet(source)
    sessions.ingest(spark, source, EDIT, store, mark)
    for f in ("1", ".1.crc"):
        os.remove(f"{tmp_path}/mark/commits/{f}")
    want = [(1, 0, b"one"), (1, 1, b"two"), (1, 2, b"three")]
    if lost == "heads":
        shutil.rmtree(f"{tmp_path}/store/heads/part=edits-00000001")
        assert state(spark, store) == want[:2] and sessions.current(spark, store).first().v == 1
    else:
        sessions.roll_back(spark, store, spark.createDataFrame([(1, 0)], "session bigint, to int"), "r")
        want = [*want, (1, 3, b"one")]
    sessions.ingest(spark, source, EDIT, store, mark)
    assert state(spark, store) == want
