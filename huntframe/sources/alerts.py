"""The alert store: idempotent upsert by fingerprint, triage that survives it, saved objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.sources.versioned import VersionedTable
from huntframe.types import schema

#: Alerts that the ring of recent ones holds.
RING = 10_000
STORED = schema("fingerprint string, rule_id string, title string, severity_id int, technique string, events array<string>, ts bigint, status string, assignee string, note string, updated_ts bigint")
SAVED = schema("kind string, id string, name string, owner string, updated_ts bigint, body string")


def fingerprint(rule_id: Column, ts: Column, events: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(rule_id, ts, events))), 16, "0")


class AlertStore:
    """One row per fingerprint in the newest version."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, STORED)

    def upsert(self, alerts: DataFrame, now: int = 0, batch: tuple[str, int] | None = None) -> int:
        """Adds alerts that are not stored yet; triage of stored ones is kept.

        The stored fingerprints are those of the version the commit builds on, so two writers
        with the same alert leave one row.
        """
        rows = alerts.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("ts"), F.col("events"))).dropDuplicates(["fingerprint"])
        rows = rows.withColumns({"status": F.lit("open"), "assignee": F.lit(None).cast("string"), "note": F.lit(None).cast("string"), "updated_ts": F.lit(now).cast("bigint")})
        return self.table.transact(lambda base: (self.table.stage(rows.join(self.table.read(version=base).select("fingerprint"), "fingerprint", "left_anti")), []), batch)

    def triage(self, changes: DataFrame) -> int:
        """``changes``: (fingerprint, status?, assignee?, note?, updated_ts); nulls leave a value as it is."""
        c = changes.select("fingerprint", *[F.col(n).alias(f"n_{n}") for n in ("status", "assignee", "note", "updated_ts")])
        values = {n: F.coalesce(f"n_{n}", n) for n in ("status", "assignee", "note", "updated_ts")}
        return self.table.replace(lambda stored: stored.join(c, "fingerprint", "left").withColumns(values).select(*STORED.fieldNames()))

    def keep_newest(self, cap: int = RING) -> int:
        """Drops all but the newest alerts, as a ring of this capacity would; returns the version."""
        return self.table.replace(lambda stored: stored.orderBy(F.desc("ts"), "fingerprint").limit(cap))

    def recent(self, limit: int = 100, technique: str | None = None, status: str | None = None) -> DataFrame:
        rows = self.table.read()
        if technique is not None:
            rows = rows.where(F.col("technique") == technique)
        if status is not None:
            rows = rows.where(F.col("status") == status)
        return rows.orderBy(F.desc("ts"), "fingerprint").limit(limit)


class SavedObjects:
    """Versions are appended; the latest of a kind and id holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, SAVED)

    def put(self, rows: DataFrame) -> int:
        return self.table.append(rows)

    def latest(self) -> DataFrame:
        order = Window.partitionBy("kind", "id").orderBy(F.desc("updated_ts"), F.desc("body"))
        rows = self.table.read().withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
        return rows.where(F.col("body").isNotNull())  # a null body is a deletion


def coverage(covered: DataFrame, observed: DataFrame) -> DataFrame:
    """``(technique, is_covered, is_observed)`` over the union of both."""
    a = covered.select("technique").where("technique is not null").distinct().withColumn("c", F.lit(True))
    b = observed.select("technique").where("technique is not null").distinct().withColumn("o", F.lit(True))
    return a.join(b, "technique", "full").select("technique", F.coalesce("c", F.lit(False)).alias("is_covered"), F.coalesce("o", F.lit(False)).alias("is_observed"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """``(change, key…)``: rows that appear and rows that vanish between two snapshots."""
    added = after.join(before, key, "left_anti").select(F.lit("added").alias("change"), *key)
    gone = before.join(after, key, "left_anti").select(F.lit("removed").alias("change"), *key)
    return added.unionByName(gone)
