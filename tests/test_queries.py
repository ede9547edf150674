"""Every query with SQL gives the SQL's rows on the smallest tables; those without are checked against expected rows."""

import collections
import glob
import html
import math
import os
import re

import duckdb
import pytest

from conftest import SF
from quire.plans.catalog import ORACLE_SQL, QUERIES


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


def test_message_pairing(spark):
    got = sorted(rows(spark, "message_pairing"))
    assert [(s, p, r, i) for s, p, r, _, i in got] == [(1, 1, "user", None), (1, 2, "assistant", None), (1, 3, "tool", "b"), (1, 4, "tool", "a"), (1, 5, "user", None), (2, 1, "user", None), (2, 2, "assistant", None), (2, 3, "tool", "c"), (2, 4, "assistant", None), (3, 1, "assistant", None), (3, 2, "tool", "x")]
    assert got[3][3].startswith("（该工具调用被中断")


def test_permissions(spark):
    got = {(m, c): x for c, m, x in rows(spark, "permission_decisions")}
    assert [got["default", i] for i in range(1, 10)] == ["allow:readonly", "deny:rule", "ask:rule", "allow:rule", "ask:default", "allow:rule", "ask:tool", "allow:tool", "ask:default"]
    assert got["plan", 6] == "deny:plan" and got["acceptEdits", 5] == "allow:edits" and got["bypassPermissions", 9] == "allow:bypass" and got["acceptEdits", 9] == "ask:default"


def test_soft_hyphens(spark):
    got = dict(rows(spark, "soft_hyphen_decisions"))
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False, 8: False, 9: False, 10: False}


def test_queries_without_sql_give_rows(spark):
    """Every query runs whole; those over tables give a row at least for a document, page or conversation in ten."""
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        n = QUERIES[name](spark, SF).count()
        assert n >= {"search_fuzzy": 1}.get(name, 5), name


def test_changes_of_words_by_brute_force(spark):
    """Lines that hold the word change; the others stay, in the queries that compare two versions."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lines = {i: re.split("\r?\n", t) for i, t in docs.items()}
    want = {(i, "modified", k, k) for i, ls in lines.items() for k, x in enumerate(ls, 1) if "tion" in x}
    assert {tuple(r) for r in QUERIES["changed_blocks"](spark, SF).collect()} == want
    aligned = {(r.doc_id, r.old_ordinal): (r.new_ordinal, r.similarity) for r in QUERIES["carry_over_edits"](spark, SF).collect()}
    for i, ls in lines.items():
        same = [k for k, x in enumerate(ls, 1) if "tion" not in x and ls.count(x) == 1 and re.search(r"[^\W_]", x)]
        assert all(aligned[i, k] == (k, 1.0) for k in same if len(ls) <= 25)
    hunks = collections.defaultdict(list)
    for r in QUERIES["min_hunks"](spark, SF).collect():
        hunks[r.doc_id].append((r.start, r.end, r.text))
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        t = r.text
        for a, z, x in sorted(hunks[r.item_id], reverse=True):
            t = t[:a] + x + t[z:]
        assert t == r.text.replace("the", "a")
    parts = collections.defaultdict(list)
    for r in QUERIES["inline_diffs"](spark, SF).collect():
        parts[r.doc_id].append((r.part, r.kind, r.text))
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        p = sorted(parts[r.item_id])
        assert "".join(x for _, k, x in p if k != "added") == r.text and "".join(x for _, k, x in p if k != "removed") == r.text.replace("the", "a")
    found = {(r.doc_id, r.status, r.places) for r in QUERIES["replace_tolerant"](spark, SF).collect()}
    assert found == {(i, "ok" if "tion" in t else "not_found", t.count("tion")) for i, t in docs.items()}


def test_similarity_and_outline_by_brute_force(spark):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in QUERIES["word_similarity"](spark, SF).collect():
        before = max(t for c, t in turns if c == r.conv_id and t < r.turn)
        a, b = (re.findall(r"[^\W_]+", turns[r.conv_id, t].lower()) for t in (before, r.turn))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        assert r.similarity == round(2 * n[-1][-1] / (len(a) + len(b)), 6)
    blocks = {(r.page_id, r.ordinal): (r.kind, r.level, r.text) for r in QUERIES["html_blocks"](spark, SF).collect()}
    outline = {(r.page_id, r.ordinal): (r.level, r.text) for r in QUERIES["html_outline"](spark, SF).collect()}
    assert outline == {k: (lv, t) for k, (_, lv, t) in blocks.items() if lv is not None}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        heads = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.findall(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", r.html)]
        assert sorted(t for (p, _), (k, _, t) in blocks.items() if p == r.page_id and k == "heading") == sorted(h for h in heads if h)


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.streaming.costs import cost_totals

    src = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", F.lit("x-flash").alias("model"), F.lit(10).alias("prompt"), F.lit(2).alias("cached"), F.lit(5).alias("completion"))
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    q = cost_totals(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, cost_totals(src).collect()))
