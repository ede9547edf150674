"""What failed on larger tables: chains past the recursion's limits, pages met one by one, inputs whose numbers leave 32 bits."""

import re

from conftest import SF

from quire.operators import control, figures, pages
from quire.plans.catalog import QUERIES


def test_levels_up_long_chains(spark):
    """A chain of 300 styles, deeper than a recursive query goes, one that runs into a circle, and a name that an outline level further up overrules."""
    chain = [(f"S{i}", "Own", f"S{i - 1}" if i else None, 4 if i == 0 else None) for i in range(300)]
    circle = [("A", "Own", "B", None), ("B", "heading 2", "C", None), ("C", "H7", "B", None), ("D", "heading 3", "E", 9), ("E", "Own", "S7", None), ("X", "Own", "X", None), ("Y", None, "gone", None)]
    styles = spark.createDataFrame(chain + circle, "style_id string, name string, based_on string, outline_lvl int")
    got = {r.style_id: r.level for r in control.heading_levels(spark, styles).collect()}
    assert got == {**{f"S{i}": 5 for i in range(300)}, "A": 2, "B": 2, "C": 7, "D": 5, "E": 5, "X": None, "Y": None}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"\bExchange ", plan(df)))


def test_pages_go_to_python_in_batches(spark):
    """Pages of one to forty rows, with batches of seven, which cut most of them: each page is met whole and alone."""
    rows = [(d, p, i, None if i % 5 == 0 else f"t{i}", i / 2) for d in range(6) for p in range(4) for i in range((d * 4 + p) * 7 % 40 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, page int, elem int, text string, x double").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = pages._by_page(df, lambda page: [(len(page), "".join(sorted(r["text"] or "-" for r in page)), sum(r["x"] for r in page), len({(r["doc_id"], r["page"]) for r in page}) == 1)] * (len(page) > 2), "n int, texts string, x double, alone boolean")
        assert "FlatMapGroupsInArrow" not in plan(out) and shuffles(out) == 2  # one is the test's own
        got = {(r.doc_id, r.page): (r.n, r.texts, r.x, r.alone) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for d, p in {r[:2] for r in rows}:
        page = [r for r in rows if r[:2] == (d, p)]
        if len(page) > 2:
            want[d, p] = (len(page), "".join(sorted(r[3] or "-" for r in page)), sum(r[4] for r in page), True)
    assert got == want


def test_drawings_are_dealt_by_page_once(spark):
    """Pictures, texts and page sizes, drawings and tables meet by one shuffle."""
    kinds = {"images": "image int, x0 double, y0 double, x1 double, y1 double", "spans": "elem int, text string, x0 double, x1 double, top double, bottom double, size double", "pages": "width double, height double, body double", "paths": "path int, x0 double, y0 double, x1 double, y1 double, curvy int, coloured int", "tables": "tab int, x0 double, y0 double, x1 double, y1 double", "rotated": "elem int, x0 double, y0 double, x1 double, y1 double, size double"}
    t = {k: spark.range(9).selectExpr("id AS doc_id", "CAST(id % 3 AS INT) AS page", *(f"CAST(id AS {c.split()[1]}) AS {c.split()[0]}" for c in v.split(", "))) for k, v in kinds.items()}
    assert shuffles(figures.image_grids(t["images"], t["spans"], t["pages"])) == 1
    assert shuffles(figures.labelled_figures(**t)) == 1


def test_inputs_of_drawings_and_tables_are_read_once_a_use(spark):
    """Selections of one table are one pass over it: a scan for each input of the operator, none for each kind of row; tables under rules need no join."""
    scans = lambda name: plan(QUERIES[name](spark, SF)).count("FileScan parquet")
    assert scans("labelled_figures") <= 5 and scans("parted_booktabs") <= 2
    assert "Join" not in plan(QUERIES["parted_booktabs"](spark, SF))


def test_columns_and_blocks_meet_a_page_once(spark):
    """Lines and gutters come from one pass over each page and one reading of the documents; a document's consensus doesn't compute them again."""
    for name, scans in (("gutter_consensus", 1), ("side_by_side", 2)):
        p = plan(QUERIES[name](spark, SF))
        assert p.count("FileScan parquet") == scans and len(re.findall(r"(?:MapInArrow|InPandas|GroupsInArrow) ", p)) == 1


def test_ruled_tables_are_computed_once(spark):
    """Components run by page once and need no join; what lies in the tables is met by one join on the page."""
    ruled, charts = (plan(QUERIES[name](spark, SF)) for name in ("ruled_tables_corpus", "tables_without_charts"))
    assert "Join" not in ruled and len(re.findall("MapInArrow|GroupsInArrow", ruled)) == 1
    assert len(re.findall(r"\w+Join ", charts)) == 1 and len(re.findall("MapInArrow|GroupsInArrow", charts)) == 1


def test_hyphens_of_late_documents(spark, tmp_path):
    """The number of a line leaves 32 bits from document 2,147,483 on."""
    text = "a keyboard and\nthe key-\nboard lies there"
    spark.createDataFrame([(i, text) for i in (7, 3_000_000, 50_000_000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.soft for r in QUERIES["soft_hyphen_decisions_corpus"](spark, str(tmp_path)).collect()}
    assert set(got) == {i * 1000 + n for i in (7, 3_000_000, 50_000_000) for n in (1, 2, 3)} and all(got[7000 + n] == got[3_000_000_000 + n] == got[50_000_000_000 + n] for n in (1, 2, 3))


def test_letters_are_shuffled_once(spark):
    """Letters become words where their page lies."""
    p = plan(QUERIES["letter_spaced_spans"](spark, SF))
    assert len(re.findall(r"\bExchange ", p)) == 1 and "Join" not in p


def test_booktabs_of_the_orders_need_no_join(spark):
    p = plan(QUERIES["page_booktabs"](spark, SF))
    assert "Join" not in p and "FlatMapGroupsInArrow" not in p
