"""Stored events as segments: appended, pruned by time, migrated between tiers, expired.

A segment is a Parquet folder of a versioned table with its time range and row count in the
log. Range reads open only segments that overlap; migration and retention rewrite the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.schema import EVENT
from huntframe.session import Stages, _fs, remove
from huntframe.sources.versioned import VersionedTable


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str, cold_path: str | None = None):
        self.spark, self.table = spark, VersionedTable(spark, path, EVENT)
        self.cold = (cold_path or f"{path}/cold").rstrip("/")

    def append(self, events: DataFrame, slices: int = 1, batch: tuple[str, int] | None = None) -> int:
        """Adds events as segments, by equal spans of their time range; a numbered batch once.

        The input is evaluated once: it is written as one folder, and the slices and their
        statistics are made from that.
        """
        if batch and self.table.taken(batch[0]) >= batch[1]:
            return self.table.version()
        stages = Stages(self.spark, "segments")
        rows = stages.cut(events.select(*EVENT.fieldNames()), "rows")
        lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
        if lo is None:
            return self.table.transact(lambda _: ([], []), batch) if batch else self.table.version()
        step = (hi - lo) // slices + 1
        slice_ = F.coalesce(F.call_function("div", F.col("ts") - F.lit(lo), F.lit(step)), F.lit(0)).cast("int")
        parts = self.table.stage(rows.withColumn("slice", slice_), by="slice")
        stats = {str(r[0]): r[1:] for r in rows.groupBy(slice_.alias("s")).agg(F.min("ts"), F.max("ts"), F.count("*")).collect()}  # one row per slice
        add = [{**p, "tier": "warm", **dict(zip(("min_ts", "max_ts", "rows"), stats[p["part"]]))} for p in parts]
        version = self.table.transact(lambda _: (add, []), batch)
        stages.drop("rows")
        return version

    def catalog(self) -> list[dict]:
        return self.table.parts()

    def total_rows(self) -> int:
        return sum(s["rows"] for s in self.catalog())

    def tier_counts(self) -> dict[str, int]:
        return {t: sum(s["tier"] == t for s in self.catalog()) for t in ("warm", "cold")}

    def read(self, tiers: tuple[str, ...] = ("warm", "cold")) -> DataFrame:
        """The view of all tiers, or of some."""
        return self.table.read(lambda s: s["tier"] in tiers)

    def read_range(self, start: int, end: int) -> DataFrame:
        """Rows with start <= ts <= end, from the segments that overlap."""
        return self.table.read(lambda s: s["min_ts"] <= end and s["max_ts"] >= start).where(F.col("ts").between(start, end))

    def migrate(self, now: int, age_us: int) -> int:
        """Moves warm segments older than the age to the cold folder; returns how many."""
        old: list[dict] = []

        def change(base: int):
            old[:] = [s for s in self.table.parts(base) if s["tier"] == "warm" and now - s["max_ts"] > age_us]
            moved = []
            for s in old:
                to = f"{self.cold}/{uuid.uuid4().hex}"
                src_fs, src = _fs(self.spark, s["path"])
                dst_fs, dst = _fs(self.spark, to)
                self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(src_fs, src, dst_fs, dst, False, True, self.spark._jsc.hadoopConfiguration())
                moved.append({**s, "path": to, "tier": "cold"})
            return (moved, [s["path"] for s in old]) if old else None

        self.table.transact(change)
        return self._forget(old)

    def expire(self, now: int, age_us: int) -> int:
        """Drops segments of any tier older than the age."""
        old: list[dict] = []

        def change(base: int):
            old[:] = [s for s in self.table.parts(base) if now - s["max_ts"] > age_us]
            return ([], [s["path"] for s in old]) if old else None

        self.table.transact(change)
        return self._forget(old)

    def _forget(self, segments: list[dict]) -> int:
        for s in segments:
            remove(self.spark, s["path"])
        return len(segments)


def read_drifted(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Segments written by other versions as one table: columns a segment lacks are null, columns it has beyond the model are left out.

    Each path is read under its own schema, so a column that changed its type is cast, and what
    cannot be cast is null.
    """
    out = None
    for path in paths:
        rows = spark.read.parquet(path)
        held = set(rows.columns)
        rows = rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENT])
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], EVENT) if out is None else out


def segment_stats(events: DataFrame, width_us: int) -> DataFrame:
    """``(segment, min_ts, max_ts, n)`` of events cut into spans of time."""
    return events.groupBy(F.call_function("div", F.col("ts"), F.lit(width_us)).alias("segment")).agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n"))
