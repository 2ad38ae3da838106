"""The event model: canonical columns, fixed class and severity tables, views over stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.operators.instants import unit_to_us
from huntframe.session import table
from huntframe.types import schema

# Class ids and names, severity ids, levels.
CLASSES = {
    1001: "file_system_activity", 1005: "module_activity", 1006: "scheduled_job_activity", 1007: "process_activity", 3002: "authentication",
    4001: "network_activity", 4002: "http_activity", 4003: "dns_activity", 6003: "api_activity", 201002: "registry_key_activity",
}
SEVERITIES = {0: "unknown", 1: "informational", 2: "low", 3: "medium", 4: "high", 5: "critical", 6: "fatal"}
SEVERITY_IDS = {v: k for k, v in SEVERITIES.items()}

#: The stored row; the first fifteen columns are the compatible view.
EVENT = schema(
    "id string, ts bigint, ingest_ts bigint, ocsf_class int, ocsf_class_name string, severity string, severity_id int, tenant string, host string, "
    "actor string, actor_kind string, target string, target_kind string, message string, fields_json string"
)
ALERT = schema("rule_id string, title string, severity_id int, technique string, events array<string>, ts bigint")


def lookup(values: dict, key: Column, otherwise: Column | None = None) -> Column:
    """A small fixed table as a map literal."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def class_name(uid: Column) -> Column:
    return lookup(CLASSES, uid.cast("int"), F.lit("other"))


def severity_name(level: Column) -> Column:
    """Ids above the known ones are fatal, missing ones informational."""
    return F.when(level > 5, "fatal").otherwise(lookup(SEVERITIES, level, F.lit("informational")))


def events(spark: SparkSession, d: str) -> DataFrame:
    """The stored events with event time in microseconds, as they are (redeliveries included)."""
    return table(spark, d, "segment_events").withColumn("ts", unit_to_us(F.col("ts")))


def unique_events(spark: SparkSession, d: str) -> DataFrame:
    """Each event id once, at its earliest arrival."""
    rows = events(spark, d)
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("ingest_ts", "ts")).alias("r")).select("id", "r.*")


def fields(json: Column) -> Column:
    """``fields_json`` as a map; JSON null is the text ``null``, nested values are compact JSON."""
    return F.transform_values(F.from_json(json, "map<string,string>"), lambda _, v: F.coalesce(v, F.lit("null")))


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT)


#: The same views for DuckDB.
SQL_EVENTS = """WITH ev AS (
  SELECT * REPLACE (CASE WHEN abs(ts) < 10000000000 THEN ts * 1000000 WHEN abs(ts) < 10000000000000 THEN ts * 1000 WHEN abs(ts) < 10000000000000000 THEN ts ELSE ts // 1000 END AS ts)
  FROM segment_events)"""
SQL_UNIQUE = (
    SQL_EVENTS
    + """, ue AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingest_ts, ts) AS rn FROM ev) WHERE rn = 1)"""
)
