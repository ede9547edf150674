"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct ``SHINGLE``-word shingles. Of every permutation (an affine map of mixed 64-bit shingle hashes) both the least and the
greatest value are kept, so a signature of 2 * PERMS values costs PERMS hash evaluations; four permutations' least values make one band and their greatest
another. Two documents of similarity 0.8 share none of the BANDS bands with probability (1 - 0.8**4)**BANDS, about 4e-7.

Documents with the same set are one node (pre-aggregated by a 128-bit sum over the set). Each band bucket proposes links from its members to one member, another
one in each band, never all pairs; links are confirmed on full sets, and connected components follow by alternating large-star and small-star rounds. A
proposed pair that neither is a link nor lies within one component leaves the node's pairs with the centre's component open: the nodes so left are compared with
all members of that component and with each other, block against block on full sets; only links leave a block, and a block
holds at most BLOCK_U + BLOCK_M documents. So every pair of bucket mates is in one component or has been compared, however large a bucket is.

Defined results: a null text counts as empty; texts without words have no shingles, are linked with nothing and stand alone; texts of fewer words than a
shingle are one shingle; repeated rows give repeated results; a null doc_id is linked with nothing and
kept, its component null; rows of one doc_id with different texts are sets of their own, and a component's id is the least doc_id of all its rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import B2, byte_words, gram_hashes, joined_texts, mix64, powers, release, slices, table, word_hashes, written

SHINGLE = 4
ROWS, BANDS = 4, 28
PERMS = ROWS * BANDS // 2
#: Linked if SIMILAR[1] * intersection >= SIMILAR[0] * union.
SIMILAR = (80, 100)
#: Members of the two sides of a block in which open groups are compared.
BLOCK_U, BLOCK_M = 1024, 2048
_BYTES = 1 << 19


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one set after another, and the sets' sizes."""
    start, stop, count = byte_words(data, ends)
    words = word_hashes(data, start, stop, fold=True)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(ends)), count)
    g = gram_hashes(words, k)
    ok = owner[: len(g)] == owner[k - 1 :] if len(g) else np.zeros(0, bool)
    h, o = g[ok], owner[: len(g)][ok]
    few = np.flatnonzero((count > 0) & (count < k))  # the whole sequence as one shingle
    if len(few):
        up, _ = powers(B2, k + 1)
        one = np.array([int((words[first[i] : first[i] + count[i]] * up[: count[i]]).sum(dtype=np.uint64)) for i in few], np.uint64)
        h, o = np.concatenate([h, mix64(one ^ count[few].astype(np.uint64))]), np.concatenate([o, few])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.bincount(o, minlength=len(ends))


def _maps(n: int = PERMS) -> tuple[np.ndarray, np.ndarray]:
    r = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return r[:n] | np.uint64(1), r[n:]


def signatures(h: np.ndarray, size: np.ndarray, perms: int = PERMS) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each set (of one shingle at least) under each permutation."""
    first = np.cumsum(size) - size
    low, high = np.empty((len(size), perms), np.uint64), np.empty((len(size), perms), np.uint64)
    a, b = _maps(perms)
    for i in range(perms):
        v = h * a[i] + b[i]
        low[:, i] = np.minimum.reduceat(v, first)
        high[:, i] = np.maximum.reduceat(v, first)
    return low, high


def bands(low: np.ndarray, high: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band: of ``rows`` permutations' least values, then of their greatest."""
    out = []
    for side in (low, high):
        for i in range(0, side.shape[1] - rows + 1, rows):
            v = np.full(len(side), len(out) + 1, np.uint64)
            for j in range(rows):
                v = mix64(v * np.uint64(0x9E3779B97F4A7C15) ^ side[:, i + j])
            out.append(v)
    return np.stack(out, axis=1)


def sketches(rows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Of each row (doc_id, tk, text): doc_id, tk, n (set size), k1 and k2 (128 bits that name the set), bands."""

    def run(batches):
        for b in batches:
            data, ends = joined_texts(b.column(2))
            for a, z in slices(ends, _BYTES):
                base = ends[a - 1] if a else 0
                h, size = shingle_sets(data[base : ends[z - 1]], ends[a:z] - base, k)
                some = np.flatnonzero(size)
                k1, k2, band = np.zeros(z - a, np.int64), np.zeros(z - a, np.int64), pa.nulls(z - a, pa.list_(pa.int64()))
                if len(some):
                    first = (np.cumsum(size) - size)[some]
                    k1[some] = np.add.reduceat(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first).view(np.int64)
                    k2[some] = np.add.reduceat(mix64(h * np.uint64(0xD6E8FEB86659FD93)), first).view(np.int64)
                    v = bands(*signatures(h, size[some])).view(np.int64)
                    counts = np.zeros(z - a, np.int64)
                    counts[some] = v.shape[1]
                    band = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(size.astype(np.int64)), pa.array(k1), pa.array(k2), band], names=["doc_id", "tk", "n", "k1", "k2", "bands"])

    return rows.select("doc_id", "tk", "text").mapInArrow(run, "doc_id long, tk long, n long, k1 long, k2 long, bands array<long>")


def _overlaps(pairs: DataFrame, k: int) -> DataFrame:
    """The intersection and union sizes of the two texts of each row (a, b, ta, tb)."""

    def run(batches):
        for b in batches:
            both = []
            for i in (2, 3):
                data, ends = joined_texts(b.column(i))
                sets = []
                for x, z in slices(ends, _BYTES):
                    base = ends[x - 1] if x else 0
                    h, size = shingle_sets(data[base : ends[z - 1]], ends[x:z] - base, k)
                    sets += np.split(h, np.cumsum(size)[:-1])
                both.append(sets)
            inter = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*both, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(*both, strict=True)], np.int64) - inter
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inter), pa.array(union)], names=["a", "b", "inter", "union"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, inter long, union long")


def components(spark: SparkSession, edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, root`` of every node of the edges (a, b): root is the least node reachable.

    Alternating rounds link each node's neighbours to the least of them (to the larger neighbours first, then to all smaller ones); every round is written to
    the shared folder, and the number of rounds is logarithmic in the longest path.
    """
    now = written(edges.select("a", "b").filter("a != b").distinct(), "edges")
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
        now = new
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty():
            break  # only stars are left
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _compare(t: pa.Table, k: int, similar: tuple[int, int]) -> pa.Table:
    """The links of one block, as pairs of components: rows of side 0 against rows of either side that belong to another component."""
    side, node, comp = (t.column(c).to_numpy() for c in ("side", "node", "comp"))
    order = np.lexsort((node, side))
    side, node, comp = side[order], node[order], comp[order]
    data, ends = joined_texts(t.column("text").combine_chunks().take(pa.array(order)))
    sets = []
    for x, z in slices(ends, _BYTES):
        base = ends[x - 1] if x else 0
        sets.append(shingle_sets(data[base : ends[z - 1]], ends[x:z] - base, k))
    h, size = (np.concatenate(s) for s in zip(*sets, strict=True))
    _, ids = np.unique(h, return_inverse=True)
    first = np.cumsum(size) - size
    flag = np.zeros(len(ids) + 1, np.int64)
    a, b = [], []
    for i in np.flatnonzero(side == 0):
        own = ids[first[i] : first[i] + size[i]]
        flag[own] = 1
        inter = np.add.reduceat(flag[ids], first)
        flag[own] = 0
        union = size + size[i] - inter
        hit = (similar[1] * inter >= similar[0] * union) & (comp != comp[i])
        other = np.unique(comp[hit])
        a += [comp[i]] * len(other)
        b += other.tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def link_documents(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    sk = written(sketches(rows, k), "sketches")
    some = sk.filter("n > 0 AND doc_id IS NOT NULL")
    sets = some.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "tk")).alias("one")).select("k1", "k2", "n", F.col("one.doc_id").alias("doc_id"), F.col("one.tk").alias("tk"))
    nodes = written(_numbered(written(sets, "sets")), "nodes")
    of_set = some.join(nodes.select("doc_id", "tk", "k1", "k2", "node"), ["doc_id", "tk", "k1", "k2"]).dropDuplicates(["node"])
    member = of_set.select("node", F.posexplode("bands").alias("band", "h"))
    order = F.struct(F.xxhash64("node", "band").alias("o"), "node")
    centre = member.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("m")).filter("c > 1").select("band", "h", F.col("m.node").alias("m"))
    pairs = member.join(centre, ["band", "h"]).filter("node != m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    release(spark)
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc_id", "tk"), "node")
    texts = rows.join(involved, ["doc_id", "tk"]).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")
    release(spark)
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    seen = written(_overlaps(pairs.join(left, "a").join(right, "b"), k), "overlaps")
    release(spark)
    good = F.lit(similar[1]) * F.col("inter") >= F.lit(similar[0]) * F.col("union")
    edges = seen.filter(good).select("a", "b")
    comps = components(spark, edges)
    more = _open_links(seen.filter(~good).select("a", "b"), comps, texts, k, similar)
    if not more.isEmpty():  # the links' components become one
        merged = components(spark, more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        comps = comps.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(merged.join(comps.select("node"), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root")))
    least = comps.join(nodes.select("node", F.col("doc_id").alias("d")), "node").groupBy("root").agg(F.min("d").alias("top"))
    comps = comps.join(least, "root").select("node", "top")
    named = sk.join(nodes.select("k1", "k2", "n", "node", F.col("doc_id").alias("own")), ["k1", "k2", "n"], "left").join(comps, "node", "left")
    return named.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "own"))).otherwise(F.col("doc_id")).alias("component_id"),
    ).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _numbered(sets: DataFrame) -> DataFrame:
    """``sets`` with a number for each, ``node``: the least doc_id that holds it, or, where that id holds another set too, a hash far below."""
    firsts = sets.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n")).alias("f"))
    far = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("doc_id", "k1", "k2", "n"), F.lit(1 << 61))
    node = F.when(F.col("f") == F.struct("k1", "k2", "n"), F.col("doc_id")).otherwise(far)
    return sets.join(firsts, "doc_id").select("k1", "k2", "n", "doc_id", "tk", node.alias("node"))


def _open_links(tried: DataFrame, comps: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """Links between roots (a, b) that tried pairs without one (a node, its bucket's centre) leave possible.

    A bucket's members are in its centre's component or appear here with the centre. So for each centre's component, the nodes tried in vain with one of its
    members are compared with all its members and with each other.
    """
    at = written(texts.select("node").join(comps, "node", "left").select("node", F.coalesce("root", "node").alias("comp")), "members")
    ends = tried.join(at.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("comp").alias("grp")), "b").filter("x != grp")
    outside = written(ends.select("grp", F.col("a").alias("node"), F.col("x").alias("comp")).distinct(), "outside")
    sizes = outside.groupBy("grp").agg(F.count(F.lit(1)).alias("u")).join(at.groupBy(F.col("comp").alias("grp")).agg(F.count(F.lit(1)).alias("m")), "grp")
    blocks = written(sizes.select("grp", (F.floor((F.col("u") - 1) / BLOCK_U) + 1).alias("nu"), (F.floor((F.col("u") + F.col("m") - 1) / BLOCK_M) + 1).alias("nm")), "groups")
    number = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (F.col(n) - 1).cast("long")))
    everyone = outside.unionByName(at.select(F.col("comp").alias("grp"), "node", "comp"))
    u = outside.join(blocks, "grp").select("grp", number("nu", 1).alias("bu"), upto("nm").alias("bm"), F.lit(0).alias("side"), "node", "comp")
    v = everyone.join(blocks, "grp").select("grp", number("nm", 2).alias("bm"), upto("nu").alias("bu"), F.lit(1).alias("side"), "node", "comp")
    met = u.unionByName(v).join(texts, "node")
    links = met.groupBy("grp", "bu", "bm").applyInArrow(lambda t: _compare(t, k, similar), "a long, b long")
    return written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies: doc_id, n_shingles, component_id, kept."""
    return link_documents(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
q AS (SELECT doc_id, n, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT DISTINCT doc_id, g FROM q WHERE p <= n - 3 UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM e JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT r.node, m.b FROM r JOIN m ON m.a = r.c),
c AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
