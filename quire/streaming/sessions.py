"""The store of edited documents: an append-only log of versions, fed by a stream, and a pointer to each session's current one.

A store is a folder of two tables, each made of parts. ``versions`` holds session, v, edit_id, at, label, format, content; v counts from 0, the original. ``heads`` holds, for
every session that a part changed, the version that became its current one. A part's heads are written after its versions, so a head never names a version that isn't there,
and a part whose heads are complete is never written again: a batch that dies is repeated, one that has passed is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.control import versions as numbered

VERSIONS = "session bigint, v int, edit_id string, at timestamp, label string, format string, content binary"
HEADS = "session bigint, v int"
#: Fixed value: the label of a version that brings an earlier one back.
BACK = "回滚到 v"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _done(spark: SparkSession, store: str, part: str) -> bool:
    fs, p = _files(spark, f"{store}/heads/part={part}/_SUCCESS")
    return fs.exists(p)


def _read(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    fs, p = _files(spark, f"{store}/{name}")
    if not fs.exists(p):
        return spark.createDataFrame([], schema + ", part string")
    return spark.read.schema(schema + ", part string").parquet(f"{store}/{name}")


def _put(spark: SparkSession, store: str, part: str, new: DataFrame) -> None:
    """One part: its versions, then its heads. Both replace what a run that died has left."""
    names = [c.split()[0] for c in VERSIONS.split(", ")]
    new.select(*names).write.mode("overwrite").parquet(f"{store}/versions/part={part}")
    written = spark.read.schema(VERSIONS).parquet(f"{store}/versions/part={part}")
    written.groupBy("session").agg(F.max("v").alias("v")).write.mode("overwrite").parquet(f"{store}/heads/part={part}")


def heads(spark: SparkSession, store: str) -> DataFrame:
    """session, v: the pointer to each session's current version."""
    return _read(spark, store, "heads", HEADS).groupBy("session").agg(F.max("v").alias("v"))


def history(spark: SparkSession, store: str) -> DataFrame:
    """All versions that a head covers, whose parts are complete."""
    parts = _read(spark, store, "heads", HEADS).select("part").distinct()
    return _read(spark, store, "versions", VERSIONS).join(parts, "part", "left_semi").drop("part")


def append(spark: SparkSession, store: str, edits: DataFrame, part: str) -> None:
    """Number the edits (session, edit_id, at, label, format, content) of one part behind each session's current version, in order of time, then edit_id.

    An edit that the store has already, or that comes twice, counts once: the row of the least time, label, format and content stays. Edits without a session or an edit_id are no edits. Ids and
    heads are compared by shuffles; contents of the store are not read.
    """
    if _done(spark, store, part):
        return
    row = F.struct(F.col("at").cast("timestamp").alias("at"), "label", "format", F.col("content").cast("binary").alias("content"))
    once = edits.select(F.col("session").cast("long").alias("session"), F.col("edit_id").cast("string").alias("edit_id"), row.alias("row")).filter("session IS NOT NULL AND edit_id IS NOT NULL").groupBy("session", "edit_id").agg(F.min("row").alias("row")).select("session", "edit_id", "row.*")
    known = _read(spark, store, "versions", VERSIONS).filter(F.col("part") != part).select("session", "edit_id")
    n = numbered(once.join(known, ["session", "edit_id"], "left_anti"), "session", "at", "edit_id").withColumnRenamed("v", "n")
    last = _read(spark, store, "heads", HEADS).filter(F.col("part") != part).groupBy("session").agg(F.max("v").alias("last"))
    _put(spark, store, part, n.join(last, "session", "left").withColumn("v", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("int")))


def ingest(spark: SparkSession, source: str, schema, store: str, checkpoint: str, stream: str = "edits") -> None:
    """Take the files that have come to the folder ``source`` since the last call with this checkpoint into the store, and stop. ``stream`` names the source, so that several
    may feed one store, one after another."""
    edits = spark.readStream.schema(schema).parquet(source)
    put = lambda batch, i: append(batch.sparkSession, store, batch, f"{stream}-{i:08d}")
    query = edits.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def roll_back(spark: SparkSession, store: str, wanted: DataFrame, request: str) -> None:
    """One more version for each session that is to return to an earlier one (session, to): its bytes and format again. Nothing is lost. A request that has passed does nothing
    when it is repeated; versions that don't exist, or are current already, make none."""
    part = f"back-{request}"
    if _done(spark, store, part):
        return
    last = _read(spark, store, "heads", HEADS).filter(F.col("part") != part).groupBy("session").agg(F.max("v").alias("last"))
    to = wanted.groupBy("session").agg(F.max("to").alias("to")).join(last, "session").filter("to < last")
    old = history(spark, store).drop("edit_id", "label", "at").join(to.withColumn("v", F.col("to").cast("int")), ["session", "v"])
    _put(spark, store, part, old.select("session", (F.col("last") + 1).cast("int").alias("v"), F.lit(part).alias("edit_id"), F.lit(None).cast("timestamp").alias("at"), F.concat(F.lit(BACK), "to").alias("label"), "format", "content"))


def current(spark: SparkSession, store: str) -> DataFrame:
    """session, v, label, format, content of each session's current version."""
    return history(spark, store).join(heads(spark, store), ["session", "v"]).select("session", "v", "label", "format", "content")


def originals(spark: SparkSession, store: str) -> DataFrame:
    """session, format, content as they first came."""
    return history(spark, store).filter("v = 0").select("session", "format", "content")


def exports(spark: SparkSession, store: str) -> DataFrame:
    """Current versions as files to hand out: name, content. The name tells session and version; the format is the extension."""
    return current(spark, store).select("session", F.concat(F.lit("s"), "session", F.lit("-v"), F.lpad(F.col("v").cast("string"), 4, "0"), F.lit("."), "format").alias("name"), "content")
