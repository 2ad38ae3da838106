"""Per-period aggregates by event time, corrected as late events arrive, up to a cut-off.

A period closes at its end; arrivals up to the allowed lateness after it correct the
aggregate, later ones are refused and kept aside. The state is one store of four tables that
change in one commit, which carries the batch's number: the arrivals of ids, the aggregates per
``(key, period)``, the refused rows, and rows that came behind the watermark. A batch yields a
delta: plus one at the arrivals it brings, minus one at arrivals that it proves not to be the
earliest. The aggregates of the days it touches are upserted, all others stay as they are; ids
and refused rows are only ever appended, with the sign of the correction, and summed when read.

The watermark is the greatest arrival taken in less ``redelivery_us``, within which an id may
be delivered again. Arrivals before it leave the state, a whole day of arrivals at a time. A
batch that brings rows from before the watermark (batches in the wrong order by more than that
span) cannot be checked against what is forgotten: these rows are set aside as ``overdue`` and
counted nowhere. With ``redelivery_us=None`` nothing is forgotten and nothing is overdue.

Defined cases: rows without id, event time or arrival do not count; an id counts once, at its
earliest arrival (ties: the smaller event time, then the smaller key); a null key is a key of
its own; an empty or repeated batch changes nothing; other columns are ignored; an id that is
delivered again after more than ``redelivery_us`` counts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.session import Stages
from huntframe.sources.versioned import VersionedStore
from huntframe.types import schema

HOUR = 3_600_000_000
DAY = 24 * HOUR
SEEN = schema("id string, tenant string, hour_us bigint, arrival bigint")
COUNTS = schema("tenant string, hour_us bigint, n_first bigint, n_final bigint, n_refused bigint, n_late bigint")
SIGNED = schema("id string, tenant string, hour_us bigint, arrival bigint, n bigint")
_ROW = ["tenant", "hour_us", "arrival"]


def _day(us: Column) -> Column:
    return F.floor(us / F.lit(DAY)).cast("bigint")


class LateWindows:
    def __init__(self, spark: SparkSession, path: str, period_us: int = HOUR, lateness_us: int = 6 * HOUR, redelivery_us: int | None = 7 * DAY):
        self.spark, self.period, self.lateness, self.redelivery = spark, period_us, lateness_us, redelivery_us
        self.store = VersionedStore(spark, path, {"seen": SEEN, "counts": COUNTS, "refused": SIGNED, "overdue": SEEN})

    def _delta(self, rows: DataFrame) -> DataFrame:
        """Counts of signed ``(tenant, hour_us, arrival, n)`` rows."""
        end = F.col("hour_us") + self.period
        n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("bigint")
        return rows.groupBy("tenant", "hour_us").agg(
            n(F.col("arrival") < end).alias("n_first"),
            n(F.col("arrival") < end + self.lateness).alias("n_final"),
            n(F.col("arrival") >= end + self.lateness).alias("n_refused"),
            n(F.col("arrival") >= end).alias("n_late"),
        )

    def watermark(self, version: int | None = None) -> int | None:
        """Arrivals before it are forgotten; none before the first batch."""
        newest = max((p["newest"] for p in self.store.parts(version, "seen")), default=None)
        return None if newest is None or self.redelivery is None else newest - self.redelivery

    def counts(self, version: int | None = None) -> DataFrame:
        return self.store.read("counts", version=version)

    def refused(self) -> DataFrame:
        """The ids that are refused now; corrections have cancelled those that arrived earlier after all."""
        rows = self.store.read("refused").groupBy("id", *_ROW).agg(F.sum("n").alias("n"))
        return rows.where("n > 0").select(*SEEN.fieldNames())

    def overdue(self) -> DataFrame:
        return self.store.read("overdue")

    def ingest(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Takes ``(id, tenant, ts_us, arrival)``; returns the aggregates that changed.

        A batch with a number is taken once, whatever fails and is repeated in between.
        """
        stages = Stages(self.spark, "late")
        hour = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(self.period))
        first = (
            batch.where(F.col("id").isNotNull() & F.col("ts_us").isNotNull() & F.col("arrival").isNotNull())
            .groupBy("id")
            .agg(F.min(F.struct("arrival", "ts_us", F.coalesce("tenant", F.lit("")).alias("t"), "tenant")).alias("e"))
            .select("id", F.col("e.tenant").alias("tenant"), F.col("e.ts_us").alias("ts_us"), F.col("e.arrival").alias("arrival"))
            .select("id", "tenant", hour.alias("hour_us"), "arrival")
        )
        changed: list[DataFrame] = []

        def change(base: int):
            mark = self.watermark(base)
            rows = first
            if base:
                # What is stored of an id is its earliest arrival; one that is not later makes the row a redelivery.
                old = self.store.read("seen", version=base).groupBy("id").agg(F.min(F.struct("arrival", "hour_us", "tenant")).alias("old"))
                rows = rows.join(old, "id", "left").where(F.col("old").isNull() | (F.struct("arrival", "hour_us", "tenant") < F.col("old")))
            else:
                rows = rows.withColumn("old", F.lit(None).cast("struct<arrival:bigint,hour_us:bigint,tenant:string>"))
            rows = stages.cut(rows, "rows")
            timely = F.lit(True) if mark is None else F.col("arrival") >= mark
            newest, oldest, moved, overdue = rows.agg(F.max("arrival"), F.min("arrival"), F.count("old"), F.sum(F.when(timely, 0).otherwise(1))).first()
            if newest is None:
                changed[:] = [self.counts(base).limit(0)]
                return ([], []) if number is not None else None
            add: list[dict] = []
            if overdue:
                add += self.store.stage("overdue", rows.where(~timely))
                rows = rows.where(timely)
            signed = rows.select("id", *_ROW, F.lit(1).cast("bigint").alias("n"))
            if moved:
                taken = rows.where("old is not null").select("id", "old.tenant", "old.hour_us", "old.arrival", F.lit(-1).cast("bigint").alias("n"))
                signed = signed.unionByName(taken)
            seen = self.store.stage("seen", rows.withColumn("day", _day(F.col("arrival"))), by="day")
            newest = max([newest, *(p["newest"] for p in self.store.parts(base, "seen"))])
            add += [{**p, "newest": newest} for p in seen]
            late = signed.where(F.col("arrival") >= F.col("hour_us") + self.period + self.lateness)
            add += self.store.stage("refused", late)
            # Only the days of event time that the batch touches are merged and written again.
            delta = stages.cut(self._delta(signed), "delta")
            days = {str(r[0]) for r in delta.select(_day(F.col("hour_us")).alias("d")).distinct().collect()}
            held = [p for p in self.store.parts(base, "counts") if p["part"] in days]
            names = {p["path"] for p in held}
            sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTS.fieldNames()[2:]]
            merged = self.store.read("counts", lambda p: p["path"] in names, base).unionByName(delta).groupBy("tenant", "hour_us").agg(*sums)
            add += self.store.stage("counts", merged.withColumn("day", _day(F.col("hour_us"))), by="day")
            drop = list(names)
            if self.redelivery is not None:
                cut = (newest - self.redelivery) // DAY
                drop += [p["path"] for p in self.store.parts(base, "seen") if int(p["part"]) < cut]
            changed[:] = [delta.select(F.col("tenant").alias("t"), F.col("hour_us").alias("h")), days]
            return add, drop

        version = self.store.transact(change, ("batch", number) if number is not None else None)
        self.store.vacuum()
        stages.drop("rows")
        if len(changed) < 2:
            return self.counts(version).limit(0)
        keys, days = changed
        now = self.store.read("counts", lambda p: p["part"] in days, version)
        return now.join(keys, F.col("tenant").eqNullSafe(F.col("t")) & (F.col("hour_us") == F.col("h")), "left_semi")


def late_counts(events: DataFrame, path: str, *, epochs: int = 4) -> DataFrame:
    """Aggregates of a whole table of ``(id, tenant, ts_us, arrival)``, taken in by epochs of arrival, the watermark behind them."""
    windows = LateWindows(events.sparkSession, path)
    lo, hi = events.agg(F.min("arrival"), F.max("arrival")).first()
    if lo is None:
        return events.sparkSession.createDataFrame([], COUNTS)
    step = (hi - lo) // epochs + 1
    for n in range(epochs):
        windows.ingest(events.where((F.col("arrival") >= lo + n * step) & (F.col("arrival") < lo + (n + 1) * step)), n)
    return windows.counts()
