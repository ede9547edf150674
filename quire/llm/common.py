"""Helpers shared by the corpus operators: table access, shared scratch space, row hashing, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return. Everything else is part of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs on this machine, as in tests, a new local one is set; on a
    cluster, executors would lose what they write to a local folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that owns it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser), so that sums and products of its values behave like random ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least (base is odd); kept for the life of a worker, by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            step = 1
            while step < size:
                p[step : 2 * step] = p[: min(step, size - step)] * np.uint64(pow(b, step, 1 << 64))
                step *= 2
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
B1, B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def byte_words(data: np.ndarray, doc_ends: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts that lie one after another in ``data`` (UTF-8 bytes, text i ending at doc_ends[i]).

    Returns start and end of each word in ``data``, and the number of words of each text. ``between``: which bytes are not of a word; none of them may occur
    inside a UTF-8 sequence.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(doc_ends), np.int64)
    inside = ~between[data]
    cut = np.zeros(n + 1, bool)
    cut[doc_ends] = True
    cut[0] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    upto = np.searchsorted(starts, doc_ends, side="left")
    return starts, ends, np.diff(upto, prepend=0)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = B1, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in ``base`` over mixed bytes from prefix sums, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(data) + 1)
    v = _BYTE[_FOLD[data] if fold else data] * up[: len(data)]
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v, out=c[1:])
    return mix64((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(B2))


def gram_hashes(words: np.ndarray, k: int, base: int = B2) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes (len - k + 1 of them), regardless of text borders."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=c[1:])
    return mix64((c[k:] - c[:-k]) * down[: n - k + 1])


def joined_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as one run of UTF-8 bytes and the end of each text in it; a null is the empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, body = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at[1:] - at[0]


def label_sample(labels: DataFrame, label: str, per_class: int, modulus: int = 5, id_col: str = "doc_id") -> DataFrame:
    """Training ids for a classifier: of the rows that may be learnt from (crc32(id) mod ``modulus`` is not 0), those of the ``per_class`` smallest id hashes
    of each class, as ``doc_id, y, share`` (share: the class's part of all such labels). At most 2 * per_class rows, whatever the input's size.

    An id's label is 1 if any of its rows says so; null ids and labels are ignored.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (crc_mod("doc_id", modulus) != 0))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    p1 = float(known.agg(F.avg("y")).first()[0] or 0.0)
    picked = [known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1]).select("doc_id", "y", F.when(F.col("y") == 1, F.lit(p1)).otherwise(F.lit(1 - p1)).alias("share"), (F.pmod(F.shiftright("h", 7), F.lit(4)) == 0).alias("check"))


def slices(ends: np.ndarray, size: int):
    """Row ranges (first, last + 1) of about ``size`` bytes each; a longer text is a range of its own."""
    first, n = 0, len(ends)
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, base + size, side="right")), first + 1)
        yield first, last
        first = last


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (intercept last) of a logistic regression by damped Newton steps."""
    if not len(x):
        return np.zeros(x.shape[1] + 1 if x.ndim == 2 else 1)
    a = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(a.shape[1])
    w = w / w.sum()
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (ridge * v * v).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        g = a.T @ (w * (p - y)) + ridge * b
        d = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge), g)
        t = 1.0
        while t > 1e-6 and loss(b - t * d) > loss(b):
            t /= 2
        b = b - t * d
        if np.abs(t * d).max() < 1e-9:
            break
    return b


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, whose plans nothing refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class HashTable:
    """uint64 keys to float32 values in open addressing, looked up as whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        self.bits = max(4, int(2 * max(len(keys), room) + 1).bit_length())
        self.keys, self.values, self.used = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32), np.zeros(1 << self.bits, bool)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """More keys, distinct ones that are not there yet; ``room`` keys at most in all."""
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[~self.used[at[left]]]
            slot, which = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot], self.used[slot] = keys[free[which]], values[free[which]], True
            done = np.zeros(len(keys), bool)
            done[free[which]] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing) and where they were found."""
        at = self._slot(keys)
        hit = self.used[at] & (self.keys[at] == keys)
        out = np.where(hit, self.values[at], np.float32(0))
        left = np.flatnonzero(~hit & self.used[at])
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            used = self.used[at]
            same = used & (self.keys[at] == keys[left])
            out[left[same]], hit[left[same]] = self.values[at[same]], True
            go = used & ~same
            left, at = left[go], at[go]
        return out, hit

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lies, -1 where missing."""
        at = self._slot(keys)
        hit = self.used[at] & (self.keys[at] == keys)
        out = np.where(hit, at, -1)
        left = np.flatnonzero(~hit & self.used[at])
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            used = self.used[at]
            same = used & (self.keys[at] == keys[left])
            out[left[same]] = at[same]
            go = used & ~same
            left, at = left[go], at[go]
        return out
