"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are dealt to shards of bounded size. A shard's index has, for every dimension, postings in LEVELS segments of quantised component value. A query turns
each segment into an impact, the most that a member can gain over the dimension's least; segments of all dimensions are processed from the greatest impact
down, adding impacts to accumulators. With R the sum of the dimensions' next impacts and E that of the segments' widths, a vector whose accumulator is below
the k-th greatest minus E minus R cannot be among the k best. Processing stops when that leaves few possible members, or at the end; all of them are then
rescored exactly, so the early stop never changes a result. Accumulators are doubles of vectors and queries scaled to 1, and the bound has room for their rounding, so that
one index serves components of every size; only the rescoring of a vector whose score may not fit 64 bits is done in integers of any length.

A shard's vectors lie before all queries in its task's rows: its index is built once, and the queries stream through it batch by batch. So every vector is shuffled
once and every query once a shard; a task holds SHARD vectors. Each shard returns k rows a query, which a window merges. Nothing is collected.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; missing components of a shorter vector are
0; rows that share a query's id are its own and no candidates; query rows of one id with different vectors are queries of their own, each with its ranks, equal ones are one;
other repeated rows are candidates each; ties go to the smaller id; other columns are ignored. Scores are ranked exactly whatever their size; one beyond 64 bits is shown as
the nearest 64-bit number. A component whose product with the scale is no double counts as the greatest double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import partitions, table

LEVELS = 64
#: Vectors of a shard.
SHARD = 1 << 15
#: Possible members at which processing may stop, as a multiple of k, and the segments between looks.
FEW, LOOK = 8, 256
_LONG = 2**63 - 1


def _scaled(x: np.ndarray) -> np.ndarray:
    """Values times a power of two, so that none exceeds 1."""
    most = np.abs(x).max(initial=0.0)
    return np.ldexp(x, -int(np.frexp(most)[1])) if most else x


class ShardIndex:
    """Impact-ordered postings of vectors of whole doubles (one row each)."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x, (n, d) = x, x.shape
        self.most = np.abs(x).max(1, initial=0.0)
        y = _scaled(x)
        self.low, self.high = y.min(0), y.max(0)
        width = np.where(self.high > self.low, (self.high - self.low) / levels, 1.0)
        level = np.clip(np.floor((y - self.low) / width), 0, levels - 1).astype(np.int64)
        key = (level + np.arange(d) * levels).T.ravel()  # dimension by dimension
        order = np.argsort(key, kind="stable")
        self.post = (order % n).astype(np.int32)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.start = np.append(first, len(order))
        self.size = np.diff(self.start)
        self.dim = key[order][first] // levels
        values = y.T.ravel()[order]
        self.bottom, self.top = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)

    def possible(self, q: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best for q; ``skip``: rows that take no part."""
        n = len(self.x)
        if n <= FEW * k:
            return np.flatnonzero(~skip)
        q = _scaled(q)
        weight = q[self.dim]
        least = np.minimum(q * self.low, q * self.high)
        impact = np.where(weight >= 0, weight * self.top, weight * self.bottom) - least[self.dim]
        spread = np.zeros(len(q))
        np.maximum.at(spread, self.dim, np.abs(weight) * (self.top - self.bottom))
        greatest = np.zeros(len(q))
        np.maximum.at(greatest, self.dim, impact)
        rounding = 8 * (len(q) + 8) * np.finfo(float).eps * (np.abs(least) + greatest).sum()
        error = spread.sum() + rounding
        by_dim = np.lexsort((-impact, self.dim))
        after = np.append(impact[by_dim][1:], 0.0)
        after[np.append(np.diff(self.dim[by_dim]) != 0, True)] = 0.0
        step = np.empty(len(impact))
        step[by_dim] = after - impact[by_dim]
        order = np.argsort(-impact, kind="stable")
        rest = np.maximum(greatest.sum() + np.cumsum(step[order]), 0.0)  # what the dimensions' next segments can add
        acc = np.zeros(n)
        acc[skip] = -np.inf
        for a in range(0, len(order), LOOK):
            part = order[a : a + LOOK]
            part = part[impact[part] > 0]
            if len(part):
                rows = np.concatenate([self.post[self.start[s] : self.start[s + 1]] for s in part.tolist()])
                acc += np.bincount(rows, np.repeat(impact[part], self.size[part]), minlength=n)
            done = min(a + LOOK, len(order)) - 1
            bound = np.partition(acc, n - k)[n - k] - error - rest[done]
            if bound > -np.inf and (done + 1 == len(order) or np.count_nonzero(acc >= bound) <= FEW * k):
                return np.flatnonzero(acc >= bound)
        return np.flatnonzero(~skip)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores; Python's integers where 64 bits may not hold one."""
        if not len(rows):
            return np.zeros(0, np.int64)
        most = np.abs(q).max(initial=0.0)
        wide = np.maximum(self.most[rows], 1.0) * max(most, 1.0) * len(q) >= 2.0**61
        if not wide.any():
            return self.x[rows].astype(np.int64) @ q.astype(np.int64)
        out = np.empty(len(rows), object)
        if not wide.all():
            out[~wide] = self.x[rows[~wide]].astype(np.int64) @ q.astype(np.int64)
        whole = [int(v) for v in q.tolist()]
        for i in np.flatnonzero(wide).tolist():
            out[i] = sum(int(a) * b for a, b in zip(self.x[rows[i]].tolist(), whole, strict=True))
        return out

    def best(self, q: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best."""
        p = self.possible(q, k, ids == own)
        score = self.scores(p, q)
        if score.dtype == object:
            order = sorted(range(len(p)), key=lambda r: (-int(score[r]), int(ids[p[r]])))[:k]
        else:
            order = np.lexsort((ids[p], -score))[:k]
        return ids[p][order], score[order]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _beyond(score: int) -> str | None:
    """A key that orders scores at and beyond the ends of 64 bits; none for others."""
    if -_LONG < score < _LONG:
        return None
    d = str(abs(score))
    return f"1{len(d):04d}{d}" if score > 0 else f"0{9999 - len(d):04d}{d.translate(_NINES)}"


_NINES = str.maketrans("0123456789", "9876543210")
_FOUND = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])


def _scan(k: int, width: int):
    """Streams rows (shard, side, q, vec_id, v), a shard's vectors (side 0) before its queries: the k best of the shard for each query."""

    def run(batches):
        shard, held, index, ids = None, [], None, None
        for b in batches:
            of, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(of) | np.diff(side)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if a == z:
                    continue
                if of[a] != shard:
                    shard, held, index, ids = of[a], [], None, None
                part = b.slice(a, z - a)
                if side[a] == 0:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    whole = pa.Table.from_batches(held).combine_chunks()
                    ids, held = whole.column("vec_id").to_numpy(), []
                    index = ShardIndex(_matrix(whole.column("v").chunk(0), width))
                out = ([], [], [], [], [])
                for q, key, i in zip(_matrix(part.column(4), width), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    v, score = index.best(q, k, ids, i)
                    score = score.tolist()
                    for c, x in zip(out, ([i] * len(v), [key] * len(v), v.tolist(), [max(min(x, _LONG), -_LONG - 1) for x in score], map(_beyond, score)), strict=True):
                        c.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, modulus: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: queries are the rows whose id is divisible by ``modulus``, candidates all others."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    )
    # Floors stay doubles, which hold them exactly: rint is not beyond the value or one above it; + 0.0 makes one zero of both.
    most = float(np.finfo(float).max)
    floor = lambda y: F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0) + F.lit(0.0)
    ints = whole.select("vec_id", F.transform("v", lambda x: floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(most)), F.lit(-most)))).alias("v"))
    n, width = ints.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(-(-n // (shard or SHARD)), min(partitions(spark), -(-n // 512)), 1)
    data = ints.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("q"), "vec_id", "v")
    queries = ints.filter(F.col("vec_id") % modulus == 0).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), F.xxhash64("v").alias("q"), "vec_id", "v")
    met = queries.unionByName(data).repartition("shard").sortWithinPartitions("shard", "side", "vec_id")
    found = met.mapInArrow(_scan(k, max(width, 1)), "query_id long, q long, vec_id long, score long, beyond string")
    w = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every hundredth: query_id, rank, vec_id, score."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
