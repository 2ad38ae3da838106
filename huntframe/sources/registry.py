"""Enrolled agents: what is known of them durably, joined with what is live now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.sources.versioned import VersionedTable
from huntframe.types import schema

AGENT = schema("agent_id string, hostname string, enrolled_ts bigint, last_seen bigint")


class AgentRegistry:
    """One row per agent; enrolling again keeps the first enrolment and the latest sight."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, AGENT)

    def enrol(self, agents: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Takes ``(agent_id, hostname, enrolled_ts, last_seen)``; rows without an id are none."""
        new = agents.where(F.col("agent_id").isNotNull()).select(*AGENT.fieldNames())

        def merged(stored: DataFrame) -> DataFrame:
            both = stored.unionByName(new)
            latest = F.max_by("hostname", F.struct("last_seen", "hostname"))
            return both.groupBy("agent_id").agg(latest.alias("hostname"), F.min("enrolled_ts").alias("enrolled_ts"), F.max("last_seen").alias("last_seen"))

        return self.table.replace(merged, batch)

    def view(self, live: DataFrame) -> DataFrame:
        """Every enrolled agent with its live state ``(agent_id, last_seen, isolated)``, else with what is stored, newest enrolment first."""
        now = live.groupBy("agent_id").agg(F.max("last_seen").alias("seen"), F.bool_or("isolated").alias("isolated"))
        joined = self.table.read().join(now, "agent_id", "left")
        return joined.select(
            "agent_id", "hostname", "enrolled_ts", F.col("seen").isNotNull().alias("connected"), F.coalesce("seen", "last_seen").alias("last_seen"), F.coalesce("isolated", F.lit(False)).alias("isolated")
        ).orderBy(F.desc("enrolled_ts"), "agent_id")
