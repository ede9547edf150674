"""Running usage costs of sessions from an event stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.control import usage_costs


def cost_totals(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Totals by user and day of a stream (or table) of requests: user_id, ts, model, prompt, cached, completion. Output mode update or append."""
    requests = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    priced = usage_costs(requests.withWatermark("ts", late) if requests.isStreaming else requests)
    return priced.groupBy(F.window("ts", "1 day").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("cost"), 9).alias("cost")).select("user_id", F.col("day.start").alias("day"), "requests", "cost")


_TOTALS = "requests long, prompt long, cached long, completion long, cost double"
_PENDING = "us long, event_id long, prompt long, cached long, completion long, cost double"


class RunningCost(StatefulProcessor):
    """A session's totals after each of its requests, in the order of event time.

    Requests may come out of order. They wait in a list state; a timer at the earliest one's time fires once the watermark has passed it, when none before it can come
    any more. Then all that the watermark has passed are added to the session's totals in order. What comes later than the watermark allows is dropped, and
    counted, by Spark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS)
        self.pending = handle.getListState("pending", _PENDING)

    def _due(self, at_us: int) -> int:
        return -(-at_us // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, r.event_id, r.prompt, r.cached, r.completion, r.cost) for r in rows]
        if new:
            self.pending.appendList(new)
            due = self._due(min(r[0] for r in new))
            known = list(self.handle.listTimers())
            if not known or due < min(known):
                for t in known:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()]
        ready = sorted(r for r in waiting if r[0] <= passed)
        rest = [r for r in waiting if r[0] > passed]
        n, prompt, cached, completion, cost = self.totals.get() or (0, 0, 0, 0, 0.0)
        for _, event_id, p, c, k, price in ready:
            n, prompt, cached, completion, cost = n + 1, prompt + p, cached + c, completion + k, cost + price
            yield Row(user_id=key[0], event_id=event_id, requests=n, prompt=prompt, cached=cached, completion=completion, total=cost)
        self.totals.update((n, prompt, cached, completion, cost))
        self.pending.clear()
        if rest:
            self.pending.appendList(rest)
            self.handle.registerTimer(self._due(min(r[0] for r in rest)))

    def close(self) -> None:
        pass


def running_costs(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of requests (event_id, user_id, ts, model, prompt, cached, completion) as the running totals of their sessions: user_id, event_id, requests, prompt,
    cached, completion, total. Output mode append. The state is one row of totals a session and what the watermark has not passed yet."""
    priced = usage_costs(requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
    rows = priced.select("user_id", "ts", F.unix_micros("ts").alias("us"), *(F.col(c).cast("long") for c in ("event_id", "prompt", "cached", "completion")), "cost")
    return rows.groupBy("user_id").transformWithState(RunningCost(), "user_id long, event_id long, requests long, prompt long, cached long, completion long, total double", "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """Keyed state needs the RocksDB state store; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def advance(spark: SparkSession, source: str, schema, out: str, checkpoint: str, late: str = "1 hour") -> None:
    """Take what has come to the folder ``source`` since the last call with this checkpoint into the table ``out``, and stop. A call that dies is repeated; its files and
    rows count once."""
    with keyed_state(spark):
        stream = spark.readStream.schema(schema).parquet(source)
        query = running_costs(stream, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
