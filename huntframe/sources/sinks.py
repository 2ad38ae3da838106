"""Alert sinks: JSON lines, and the payloads of chat, paging, ticket and intelligence services.

Payloads are built as columns, so any transport can send them from ``foreachBatch``; sending
itself is the caller's function, run per partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.schema import severity_name

PAGER_SEVERITY = {0: "info", 1: "info", 2: "info", 3: "warning", 4: "error", 5: "critical", 6: "critical"}


def write_json_lines(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def chat_payload() -> Column:
    text = F.concat(F.lit("["), F.upper(severity_name(F.col("severity_id"))), F.lit("] "), F.col("title"), F.coalesce(F.concat(F.lit(" ("), F.col("technique"), F.lit(")")), F.lit("")))
    return F.to_json(F.struct(text.alias("text")))


def pager_payload(routing_key: str) -> Column:
    severity = F.try_element_at(F.create_map(*[F.lit(x) for kv in PAGER_SEVERITY.items() for x in kv]), F.col("severity_id"))
    body = F.struct(F.col("title").alias("summary"), severity.alias("severity"), F.lit("huntframe").alias("source"), F.col("events").alias("custom_details"))
    return F.to_json(F.struct(F.lit(routing_key).alias("routing_key"), F.lit("trigger").alias("event_action"), F.col("rule_id").alias("dedup_key"), body.alias("payload")))


def ticket_payload(project: str) -> Column:
    fields = F.struct(F.struct(F.lit(project).alias("key")).alias("project"), F.col("title").alias("summary"), F.array_join("events", ", ").alias("description"), F.struct(F.lit("Task").alias("name")).alias("issuetype"))
    return F.to_json(F.struct(fields.alias("fields")))


def intelligence_payload() -> Column:
    attributes = F.transform("events", lambda e: F.struct(F.lit("text").alias("type"), F.lit("Internal reference").alias("category"), e.alias("value")))
    return F.to_json(F.struct(F.struct(F.col("title").alias("info"), F.lit("2").alias("threat_level_id"), attributes.alias("Attribute")).alias("Event")))


def first_per_rule(alerts: DataFrame) -> DataFrame:
    """A ticket is opened for a rule's first alert only."""
    return alerts.groupBy("rule_id").agg(F.min_by(F.struct(*[c for c in alerts.columns if c != "rule_id"]), F.struct("ts", "events")).alias("a")).select("rule_id", "a.*").select(*alerts.columns)


def deliver(alerts: DataFrame, payload: Column, send: Callable[[str], None]) -> None:
    """Sends each payload from the executors."""
    alerts.select(payload.alias("p")).foreachPartition(lambda rows: [send(r.p) for r in rows] and None)
