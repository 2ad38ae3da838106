"""Streaming twins: the same expressions over a stream, state where a result needs it.

Sinks are ``foreachBatch`` upserts into versioned tables. A commit holds the number of its
micro-batch, so a repeated one changes nothing and results equal those of the batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from huntframe.operators import correlation, rules
from huntframe.operators.instants import unit_to_us
from huntframe.schema import EVENT
from huntframe.session import Stages, scratch
from huntframe.sources.versioned import VersionedTable
from huntframe.types import schema


def event_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Stored events as a stream of files, with event time in microseconds."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", unit_to_us(F.col("ts")))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, mode: str = "append") -> None:
    """Processes all there is, batch by batch, and ends."""
    spark = stream.sparkSession
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True)
    q = w.foreachBatch(each).start()
    q.awaitTermination()


class Upserts:
    """Additive counts per key, merged batch by batch; each batch number counts once.

    Keys are dealt by hash to a fixed number of parts. A batch reads and rewrites the parts that
    its keys fall into, all others stay as they are.
    """

    PARTS = 64

    def __init__(self, spark: SparkSession, path: str, ddl: str, keys: list[str]):
        self.table, self.keys = VersionedTable(spark, path, schema(ddl)), keys
        self.values = [f.name for f in self.table.schema if f.name not in keys]

    def add(self, delta: DataFrame, batch: int) -> None:
        if self.table.taken("stream") >= batch:
            return
        stages = Stages(self.table.spark, "upserts")
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.PARTS)).cast("int")
        delta = stages.cut(delta, "delta")
        hit = {str(r[0]) for r in delta.select(part.alias("p")).distinct().collect()}  # at most PARTS rows

        def change(base: int):
            held = {p["path"] for p in self.table.parts(base) if p["part"] in hit}
            merged = self.table.read(lambda p: p["path"] in held, base).unionByName(delta).groupBy(*self.keys).agg(*[F.sum(v).cast("bigint").alias(v) for v in self.values])
            return self.table.stage(merged.withColumn("part", part), by="part"), list(held)

        self.table.transact(change, ("stream", batch))
        self.table.vacuum()
        stages.drop("delta")

    def read(self) -> DataFrame:
        return self.table.read()


def histogram(stream: DataFrame, width_us: int, path: str) -> DataFrame:
    """Counts per time bucket of a stream."""
    counts = Upserts(stream.sparkSession, path, "bucket bigint, n bigint", ["bucket"])

    def each(batch: DataFrame, n: int) -> None:
        counts.add(batch.groupBy((F.call_function("div", F.col("ts"), F.lit(width_us)) * width_us).alias("bucket")).agg(F.count("*").alias("n")), n)

    run_available(stream, each)
    return counts.read()


def alerts(stream: DataFrame, rule_set: list[rules.Rule], path: str) -> DataFrame:
    """Alerts of a stream of events, appended once per micro-batch."""
    from huntframe.schema import ALERT

    out = VersionedTable(stream.sparkSession, path, ALERT)
    run_available(stream, lambda batch, n: out.append(rules.match(batch, rule_set), ("stream", n)) and None)
    return out.read()


def session_windows(stream: DataFrame, gap_us: int, path: str) -> DataFrame:
    """``(host, start_us, end_us, n)``: sessions per host of a stream of ``(host, ts)``, open ones included.

    Each micro-batch is merged into the stored sessions, in whatever order its events come, so
    nothing waits for a watermark and nothing is dropped behind one.
    """
    from huntframe.operators.sessions import SessionTable, local_sessions

    store = SessionTable(stream.sparkSession, path, gap_us)
    owned = stream.select("ts", F.lit("device").alias("owner_kind"), F.col("host").alias("owner_name"))
    run_available(owned, lambda batch, n: store.merge(local_sessions(batch, "ts", gap_us), n) and None)
    return store.read().select(F.col("owner_name").alias("host"), "start_us", "end_us", F.col("n_events").alias("n"))


_STATE = "entries array<struct<ts:bigint,rule_id:string,value:string,id:string>>"


def correlate(entries: DataFrame, rule: correlation.CorrelationRule, lateness: str = "1 hour") -> DataFrame:
    """``(key, ts, events)`` from a stream of keyed alerts ``(key, ts, id, rule_id, value)``.

    The window of each group is state. Rows of a micro-batch are sorted before they are folded;
    state of a group that is silent for longer than span and lateness is dropped.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = rule.window()
        for e in state.get[0] if state.exists else []:
            window.add(tuple(e), judged=True)
        rows = pd.concat(list(frames)).sort_values(["ts", "id", "rule_id"])
        out = [(key[0], t, ids) for t, ids in correlation.fold(rule, rows[["ts", "rule_id", "value", "id"]].itertuples(index=False, name=None), window)]
        state.update(([tuple(w) for w in window.held],))
        idle = rule.span_us // 1000 + 3_600_000
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows.ts.max() // 1000)) + idle)
        yield pd.DataFrame(out, columns=["key", "ts", "events"])

    timed = entries.withColumn("at", F.timestamp_micros("ts")).withWatermark("at", lateness)
    return timed.groupBy("key").applyInPandasWithState(update, "key string, ts bigint, events array<string>", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_windows(stream: DataFrame, path: str, redelivery_us: int | None = None):
    """Late-event aggregates of a stream of ``(id, tenant, ts_us, arrival)``; with ``redelivery_us`` a watermark bounds the ids kept."""
    from huntframe.operators.late import LateWindows

    windows = LateWindows(stream.sparkSession, path, redelivery_us=redelivery_us)
    run_available(stream, lambda batch, n: windows.ingest(batch, n) and None)
    return windows
