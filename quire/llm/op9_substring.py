"""Substring dedup with a log-structured fingerprint index.

Every window of ``WINDOW`` consecutive words has one fingerprint: of the hashes of its ``GRAM``-word runs the least (the leftmost of equal ones). Equal windows
have equal fingerprints at equal places, and a fingerprint serves a dozen neighbouring windows, so an index of fingerprints is a twelfth of one of windows and
loses nothing.

The index (FingerprintIndex) is log-structured: each batch of documents adds one immutable run, sorted and bucketed by fingerprint, of distinct fingerprints
and their counts. A batch is merge-joined with the runs before it: what occurs twice in it, or in it and in an earlier run, is repeated. When ``FAN_IN`` runs of a
level are there, they are compacted into one of the next level by a merge that adds up counts; a query deals its documents to ``BATCHES`` batches, so it
compacts. Runs live in the shared folder. An index that is to last (``session``) keeps the documents' texts and fingerprints beside its runs; a later session
opens it, and its documents are deduplicated against themselves and all earlier ones, of which only those that hold a repeated fingerprint are verified.

Repeated fingerprints only nominate windows. They are verified by the fingerprint together with a hash of all the window's words, which comes from word hashes of another base
(128 bits of two independent hashes): a window counts as repeated if its pair starts at two places at least. Counts are pre-aggregated before they are
shuffled; the occurrences are joined with the distinct repeated pairs, a join in which Spark splits hot keys. Exact copies of a document stand in for one another: one of
them carries the windows of all. Rows are told apart by their id and a 64-bit hash of id and text.

Defined results: a null or empty text has no words; repeated rows are documents of their own; documents shorter than a window lose nothing; a null doc_id stays
null; other columns are ignored. With an index, windows of earlier sessions' documents count as starts elsewhere, and only this session's documents are returned.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import byte_words, gram_hashes, joined_texts, partitions, release, remove, shared_dir, slices, table, word_hashes, written

WINDOW, GRAM = 35, 12
FAN_IN = 3
BATCHES = 4
_BYTES = 1 << 19
#: Base of the word hashes that verify; the fingerprints' is another.
_OTHER = 0xD6E8FEB86659FD93
_EMPTY = hashlib.sha256(b"").hexdigest()


def least(g: np.ndarray, width: int) -> np.ndarray:
    """Of each run of ``width`` values, the position of the least, the leftmost of equal ones."""
    n = len(g)
    at = np.arange(max(n, 0))
    span = 1
    while span * 2 <= width:
        other = at[span:]
        a = at[: len(other)]
        at = np.where(g[other] < g[a], other, a)
        span *= 2
    rest = width - span
    if rest:
        other = at[rest:]
        a = at[: len(other)]
        at = np.where(g[other] < g[a], other, a)
    return at


def windows_of(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of the texts in ``data``: the number of words; and of each window: its text, first word, the word its fingerprint's run begins with, and that hash."""
    start, stop, count = byte_words(data, ends)
    words = word_hashes(data, start, stop)
    owner = np.repeat(np.arange(len(ends)), count)
    first = np.cumsum(count) - count
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return {"count": count, "words": words, "text": none, "word": none, "run": none, "print": none.astype(np.uint64), "first": first}
    g = gram_hashes(words, gram)
    at = least(g, window - gram + 1)
    s = np.flatnonzero(owner[: len(words) - window + 1] == owner[window - 1 :])
    return {"count": count, "words": words, "text": owner[s], "word": s, "run": at[s], "print": g[at[s]], "first": first, "start": start, "stop": stop}


def row_key() -> Column:
    """A 64-bit key of a row's id and text; equal rows share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what tells rows apart: ``id`` and ``key``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("key", row_key())


#: What tells rows apart.
ROW = ["id", "key"]


class FingerprintIndex:
    """Sorted, immutable runs of distinct fingerprints with their counts, and the sessions' documents; a manifest lists the runs by level."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/prints-{uuid.uuid4().hex}"
        self.buckets, self.fan_in, self.runs, self.sessions = buckets or partitions(spark), fan_in, [], []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """An index that an earlier session left."""
        row = spark.read.text(f"{path}/manifest", wholetext=True).first()
        m = json.loads(row[0])
        out = cls(spark, path, m["buckets"], m["fan_in"])
        out.sessions = m["sessions"]
        for level, name in m["runs"]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {out.buckets} BUCKETS LOCATION '{path}/{name}'")
            out.runs.append((level, name))
        return out

    def save(self) -> None:
        text = json.dumps({"buckets": self.buckets, "fan_in": self.fan_in, "runs": self.runs, "sessions": self.sessions})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    def documents(self) -> DataFrame | None:
        """id, key, h and at (the fingerprints), text of all documents of earlier sessions."""
        return self.spark.read.schema(f"{_PRINTED}, text string").parquet(*[f"{self.path}/{name}" for name in self.sessions]) if self.sessions else None

    def session(self, prints: DataFrame, rows: DataFrame) -> None:
        """Keep a session's documents for later ones."""
        name = f"session-{uuid.uuid4().hex}"
        prints.join(rows.select(*ROW, "text").dropDuplicates(ROW), ROW).write.parquet(f"{self.path}/{name}")
        self.sessions.append(name)

    def _write(self, counted: DataFrame) -> str:
        name = f"prints_{uuid.uuid4().hex}"
        counted.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def history(self) -> DataFrame | None:
        """Distinct fingerprints and counts of all runs; the runs' buckets are merged without a shuffle."""
        out = None
        for _, name in self.runs:
            run = self.spark.table(name)
            out = run if out is None else out.alias("a").join(run.alias("b"), "h", "full").select("h", (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))
        return out

    def add(self, prints: DataFrame) -> DataFrame:
        """Append a batch's fingerprints (column h, one row an occurrence) as a run; returns the distinct ones that are repeated in it or already known."""
        before = self.history()
        name = self._write(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
        run = self.spark.table(name)
        if before is None:
            hits = run.filter("n > 1").select("h")
        else:
            hits = run.alias("r").join(before.alias("p"), "h", "left").filter("r.n > 1 OR p.n IS NOT NULL").select("h")
        hits = written(hits, "hits")
        self.runs.append((0, name))
        self.compact()
        return hits

    def compact(self) -> None:
        """Merge the runs of a level into one of the next when there are ``fan_in`` of them."""
        level = 0
        while len(same := [name for at, name in self.runs if at == level]) >= self.fan_in:
            part = FingerprintIndex(self.spark, self.path, self.buckets, self.fan_in)
            part.runs = [(level, name) for name in same]
            merged = self._write(part.history())
            self.runs = [r for r in self.runs if r[1] not in same] + [(level + 1, merged)]
            for name in same:
                self.spark.sql(f"DROP TABLE {name}")
                remove(self.spark, f"{self.path}/{name}")
            level += 1

    def drop(self) -> None:
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, self.path)
        self.runs = []


_PRINTED = "id long, key long, h array<long>, at array<int>"


def _prints(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The fingerprints of each document (columns id, key, text) that has a window: id, key, h, at (the words their runs begin with)."""

    def run(batches):
        for b in batches:
            data, ends = joined_texts(b.column(2))
            for a, z in slices(ends, _BYTES):
                base = ends[a - 1] if a else 0
                w = windows_of(data[base : ends[z - 1]], ends[a:z] - base, window, gram)
                if len(w["run"]):
                    keep = np.flatnonzero(np.diff(w["run"], prepend=-1) != 0)  # a run's windows follow one another; none is shared by texts
                    t = w["text"][keep]
                    n = np.bincount(t, minlength=z - a)
                    some = np.flatnonzero(n)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (w["print"][keep].view(np.int64), (w["run"][keep] - w["first"][t]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, z - a).take(pa.array(some)) for i in (0, 1)), *lists], names=[*ROW, "h", "at"])

    return rows.select(*ROW, "text").mapInArrow(run, _PRINTED)


def _pairs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """One row for each nominated window of each document (columns id, key, at, times, text): id, key, first word, the verifying pair and how many documents share it."""

    def run(batches):
        for b in batches:
            data, ends = joined_texts(b.column(4))
            name, key, times = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            at = b.column(2)
            for a, z in slices(ends, _BYTES):
                base = ends[a - 1] if a else 0
                part = data[base : ends[z - 1]]
                w = windows_of(part, ends[a:z] - base, window, gram)
                if not len(w["run"]):
                    continue
                places = at.slice(a, z - a)
                owner = np.repeat(np.arange(z - a), np.diff(places.offsets.to_numpy()))
                named = np.zeros(len(w["words"]), bool)
                where = w["first"][owner] + places.flatten().to_numpy()
                named[where[where < len(named)]] = True
                keep = named[w["run"]]
                s, t = w["word"][keep], w["text"][keep]
                if len(s):
                    full = gram_hashes(word_hashes(part, w["start"], w["stop"], base=_OTHER), window)[s]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[a:z][t]), pa.array(key[a:z][t]), pa.array((s - w["first"][t]).astype(np.int32)), pa.array(w["print"][keep].view(np.int64)), pa.array(full.view(np.int64)), pa.array(times[a:z][t].astype(np.int32))],
                        names=[*ROW, "s", "h", "w", "times"],
                    )

    return rows.select(*ROW, "at", "times", "text").mapInArrow(run, "id long, key long, s int, h long, w long, times int")


def _summary(rows: DataFrame) -> DataFrame:
    """Each row's number of words and the hash of all its words joined by one space."""

    def run(batches):
        for b in batches:
            n, sha = [], []
            for t in b.column(3).to_pylist():
                words = t.encode("utf-8").split()  # bytes split at exactly the six white-space bytes
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(sha)], names=["doc_id", *ROW, "n_words", "sha"])

    return rows.select("doc_id", *ROW, "text").mapInArrow(run, "doc_id long, id long, key long, n_words long, sha string")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words some window covers."""
    d = np.zeros(n + window + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + window, -1)
    return np.cumsum(d)[:n] > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What repeats: ``summary`` (doc_id, id, key, n_words, sha, copy: an exact copy of another row), ``found`` (id, key, starts: first words of repeated windows) and
    ``texts`` (id, key, text) of the documents in ``found``. Rows of ``docs``: doc_id, text. A given index gets the documents as a session of its own; what starts in
    a document of an earlier session is repeated too.
    """
    spark = docs.sparkSession
    rows = identified(docs)
    base = written(_summary(rows), "summary")
    same = written(base.groupBy("sha").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", *ROW)).alias("one")).filter("c > 1"), "same")
    stands = (F.col("one.id") == F.col("id")) & (F.col("one.key") == F.col("key"))
    summary = written(base.join(same, "sha", "left").select("doc_id", *ROW, "n_words", "sha", F.col("c").isNotNull().alias("copy"), stands.alias("stands")), "copies")
    prints = written(_prints(rows, window, gram), "prints")
    own = index is None
    index = index or FingerprintIndex(spark)
    before, hits = index.documents(), None
    for b in range(batches):
        h = index.add(prints.filter(F.pmod("key", F.lit(batches)) == b).select(F.explode("h").alias("h")))
        hits = h if hits is None else hits.unionByName(h)
        release(spark)
    if own:
        index.drop()
    else:
        index.session(prints, rows)
        index.save()
    known = written(hits.distinct(), "known")  # a table of its own, so that Spark can split hot keys of the join
    each = lambda df: df.select(*ROW, F.explode(F.arrays_zip("h", "at")).alias("p")).select(*ROW, F.col("p.h").alias("h"), F.col("p.at").alias("at"))
    nominate = lambda df: written(each(df).join(known, "h", "left_semi").groupBy(*ROW).agg(F.collect_set("at").alias("at")), "nominated")
    nominated = nominate(prints)
    release(spark)
    # Of exact copies one stands for all, with its windows counted twice.
    roles = summary.filter("copy").groupBy(*ROW).agg(F.max("stands").alias("stands"))
    chosen = nominated.join(roles, ROW, "left").filter("stands IS NULL OR stands").select(*ROW, "at", F.when(F.col("stands"), 2).otherwise(1).alias("times"))
    texts = written(rows.select(*ROW, "text").join(chosen, ROW), "texts")
    release(spark)
    pairs = _pairs(texts.filter("times = 1").unionByName(texts.filter("times = 2").dropDuplicates(ROW)), window, gram)
    counted = pairs.groupBy("h", "w").agg(F.sum("times").alias("n"))
    if before is not None:
        old = before.join(nominate(before).select(*ROW, F.col("at").alias("named")), ROW).select(*ROW, F.col("named").alias("at"), F.lit(1).alias("times"), "text")
        seen = _pairs(old, window, gram).groupBy("h", "w").agg(F.count(F.lit(1)).alias("m"))
        counted = counted.join(seen, ["h", "w"], "left").select("h", "w", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
    twice = written(counted.filter("n > 1").select("h", "w"), "twice")
    release(spark)
    alone = pairs.filter("times = 1").select(*ROW, "s", "h", "w")
    found = written(alone.join(twice, ["h", "w"], "left_semi").groupBy(*ROW).agg(F.collect_set("s").alias("starts")), "found")
    release(spark)
    return summary, found, texts.filter("times = 1").select(*ROW, "text")


def _cut(rows: DataFrame, window: int, texts: bool) -> DataFrame:
    """The kept words of documents (columns id, key, text, starts): id, key, n_removed and the hash of what is left, or the text itself."""

    def run(batches):
        for b in batches:
            n, kept = [], []
            for t, s in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                words = t.encode("utf-8").split()
                gone = covered(len(words), np.asarray(s.values.to_numpy(zero_copy_only=False)), window)
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                n.append(int(gone.sum()))
                kept.append(left.decode("utf-8") if texts else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=[*ROW, "n_removed", "kept"])

    return rows.select(*ROW, "text", "starts").mapInArrow(run, "id long, key long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    summary, found, texts = repeated_windows(docs, window, gram, batches, index)
    cut = _cut(texts.join(found, ROW), window, False)
    whole = F.col("copy") & (F.col("n_words") >= window)
    return summary.join(cut, ROW, "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """``docs``, all rows and columns, with the words of repeated windows cut from ``text`` (what is left joined by one space) and ``n_chars`` set anew where the
    table has it. A text that loses nothing stays as it is.
    """
    summary, found, texts = repeated_windows(docs, window, gram, batches, index)
    cut = _cut(texts.join(found, ROW), window, True)
    gone = summary.filter(F.col("copy") & (F.col("n_words") >= window)).select(*ROW).distinct().withColumn("kept", F.lit(""))
    both = cut.select(*ROW, "kept").unionByName(gone).select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("kept").alias("__kept"))
    doc_id = F.col("doc_id").cast("long")
    key = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.withColumn("__id", F.coalesce(doc_id, F.lit(0))).withColumn("__key", key).join(both, ["__id", "__key"], "left").withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows: doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
h AS (SELECT doc_id, p, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM k),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM h WHERE p <= n - 34) WHERE c > 1),
f AS (SELECT k.doc_id, k.p, k.word, max(g.p) OVER (PARTITION BY k.doc_id ORDER BY k.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
