"""Sessions of each owner's activity, kept in a table that batches are merged into.

Within a batch, events of one owner that share a time bucket as wide as the gap are always in
one session, so they are first aggregated to ``(owner, bucket) -> start, end, count`` with
map-side combine: an owner with a third of all rows reaches a task as at most one row per gap.
Windows over these rows give the batch's local sessions.

A merge compares the local sessions with the stored ones that lie within the gap, joins the
components that the batch bridges, and commits a new version in which the touched days are
replaced and all others are kept as they are. Batches may come in any order of time.

Defined cases: rows without time or owner do not count; repeated keys count once (the earliest
time holds if copies differ); a null key is its own row; ties in time are one moment; an empty
batch changes nothing; other columns are ignored. Later redelivery of a key that an earlier
batch held is the caller's to drop (``SessionTable.merge`` takes each event once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.functions.text import stripped
from huntframe.session import Stages
from huntframe.sources.versioned import VersionedTable
from huntframe.types import schema

DAY = 86_400_000_000
SESSION = schema("owner_kind string, owner_name string, start_us bigint, end_us bigint, n_events bigint")
OWNER = ["owner_kind", "owner_name"]


def owners(events: DataFrame, user: Column, device: Column) -> DataFrame:
    """Adds the owner: the trimmed lower-case user, or the device where that says nothing."""
    name = F.lower(stripped(user))
    known = F.coalesce(~name.isin("", "-"), F.lit(False))
    other = F.when(stripped(device) != "", device)
    return events.withColumns({"owner_kind": F.when(known, "user").otherwise("device"), "owner_name": F.when(known, name).otherwise(other)})


def once(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Each key once, at its earliest time; rows without a key stay."""
    kept = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), F.col(ts)).alias("r"))
    return kept.select(key, "r.*").unionByName(events.where(F.col(key).isNull()))


def joined(spans: DataFrame, gap_us: int) -> DataFrame:
    """Merges spans ``(owner, start_us, end_us, n_events)`` that lie within the gap."""
    order = Window.partitionBy(*OWNER).orderBy("start_us", "end_us")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("start_us") - before > gap_us).cast("int"), F.lit(1)))
    numbered = marked.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*OWNER, "nth").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events")).drop("nth")


def local_sessions(events: DataFrame, ts: str, gap_us: int) -> DataFrame:
    """Sessions of one batch of events that carry an owner."""
    spans = (
        events.where(F.col(ts).isNotNull() & F.col("owner_name").isNotNull())
        .withColumn("bucket", F.call_function("div", F.col(ts), F.lit(gap_us)))
        .groupBy(*OWNER, "bucket")
        .agg(F.min(ts).alias("start_us"), F.max(ts).alias("end_us"), F.count("*").alias("n_events"))
        .drop("bucket")
    )
    return joined(spans, gap_us)


class SessionTable:
    """Stored sessions, one part per day on which they start; a part states the span of time that it covers."""

    def __init__(self, spark: SparkSession, path: str, gap_us: int):
        self.table, self.gap_us = VersionedTable(spark, path, SESSION), gap_us

    def read(self) -> DataFrame:
        return self.table.read()

    def merge(self, local: DataFrame, number: int | None = None) -> int:
        """Merges a batch's local sessions, a numbered batch once; returns the new version.

        A part is touched if its span lies within the gap of some day's span of the batch; within
        touched parts, sessions that no local session reaches are copied, the others join their
        component. The merged rows are written in one pass, a part per day.
        """
        stages = Stages(self.table.spark, "sessions")
        day = F.floor(F.col("start_us") / F.lit(DAY)).cast("bigint")
        local = stages.cut(local, "local")
        spans = local.groupBy(day.alias("d")).agg(F.min("start_us"), F.max("end_us")).collect()  # one row per day of the batch

        def near(part: dict) -> bool:
            return any(part["start"] <= hi + self.gap_us and part["end"] >= lo - self.gap_us for _, lo, hi in spans)

        def change(base: int):
            if not spans:
                return ([], []) if number is not None else None
            touched = {p["path"] for p in self.table.parts(base) if near(p)}
            merged = local if not touched else joined(self.table.read(lambda p: p["path"] in touched, base).unionByName(local), self.gap_us)
            parts = self.table.stage(merged.withColumn("day", day), by="day")
            written = self.table.spark.read.schema(SESSION).parquet(*[p["path"] for p in parts])
            stats = {str(d): (lo, hi) for d, lo, hi in written.groupBy(day.alias("d")).agg(F.min("start_us"), F.max("end_us")).collect()}
            return [{**p, "start": stats[p["part"]][0], "end": stats[p["part"]][1]} for p in parts], list(touched)

        version = self.table.transact(change, ("batch", number) if number is not None else None)
        self.table.vacuum()
        stages.drop("local")
        return version


def sessions(events: DataFrame, path: str, *, key: str, ts: str, user: Column, device: Column, gap_us: int, batches: int = 3) -> DataFrame:
    """Sessions of a whole table through the incremental one.

    The batches are spans of time, as they would be delivered: a merge bridges the sessions that
    cross the border to what is stored, and days that lie behind are left as they are.
    """
    spark = events.sparkSession
    store = SessionTable(spark, path, gap_us)
    rows = once(owners(events.select(F.col(key).alias("k"), F.col(ts).alias("t"), user.alias("u"), device.alias("d")), F.col("u"), F.col("d")).select("k", "t", *OWNER), "k", "t")
    rows = Stages(spark, "activity").cut(rows.where(F.col("t").isNotNull() & F.col("owner_name").isNotNull()), "rows")
    lo, hi = rows.agg(F.min("t"), F.max("t")).first()
    for n in range(batches if lo is not None else 0):
        step = (hi - lo) // batches + 1
        store.merge(local_sessions(rows.where((F.col("t") >= lo + n * step) & (F.col("t") < lo + (n + 1) * step)), "t", gap_us), n)
    return store.read().select(*OWNER, "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
