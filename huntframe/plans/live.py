"""The live path put together: frames to events to stores and alerts, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.normalize import to_events
from huntframe.operators import campaigns as cp
from huntframe.operators import correlation, rules
from huntframe.schema import ALERT
from huntframe.sources import codecs
from huntframe.sources.alerts import AlertStore
from huntframe.sources.segments import SegmentStore

#: The streaming trigger and the rows of a stored file.
ROLL_INTERVAL, ROLL_ROWS = "10 seconds", 2_000


def detect(events: DataFrame, base: list[rules.Rule], correlations: list[correlation.CorrelationRule], detectors: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Base rules, then correlations, then base alerts that they replace dropped, then detectors."""
    out = correlation.retro_hunt(events, base, correlations)
    for d in detectors or []:
        found = d(events)
        missing = {c.name: F.lit(None).cast(c.dataType) for c in ALERT if c.name not in found.columns and c.name not in ("events", "rule_id")}
        found = found.withColumns({**missing, "rule_id": F.lit(getattr(d, "__name__", "detector")), "events": F.array("id")})
        out = out.unionByName(found.select(*ALERT.fieldNames()))
    return out


def replay(spark: SparkSession, path: str, codec: str, base: list[rules.Rule], ts: int = 0) -> tuple[DataFrame, DataFrame]:
    """A text file decoded, normalized and matched: its events and their alerts."""
    lines = codecs.read_lines(spark, path, codec)
    key = F.concat(F.lit("line-"), F.lower(F.hex(F.xxhash64("raw", "item"))))
    events = to_events(lines, key, F.lit(ts).cast("bigint"), F.lit(ts).cast("bigint"), F.lit("default"))
    return events, rules.match(events, base)


def ingest_batch(
    frames: DataFrame, segments: SegmentStore, alerts: AlertStore, base: list[rules.Rule], process: Callable[[DataFrame], DataFrame] = lambda e: e, number: int | None = None
) -> None:
    """Frames ``(id, raw, codec, recv_us)`` of one micro-batch, stored and matched; a repeated number changes neither store."""
    records = codecs.decode(frames)
    events = process(to_events(records, F.concat_ws("-", "id", "item"), F.col("recv_us"), F.col("recv_us"), F.lit("default")))
    batch = None if number is None else ("ingest", number)
    segments.append(events, batch=batch)
    alerts.upsert(rules.match(events, base), batch=batch)


def ingest_stream(frames: DataFrame, segments: SegmentStore, alerts: AlertStore, base: list[rules.Rule], checkpoint: str, process: Callable[[DataFrame], DataFrame] = lambda e: e, available_now: bool = False):
    """Starts the stream; files roll by rows, batches by time."""
    frames.sparkSession.conf.set("spark.sql.files.maxRecordsPerFile", ROLL_ROWS)
    w = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: ingest_batch(b, segments, alerts, base, process, n))
    return w.trigger(availableNow=True).start() if available_now else w.trigger(processingTime=ROLL_INTERVAL).start()


def recent_incidents(events: DataFrame, techniques: DataFrame, now: int, limit: int = 5_000, span_us: int = 86_400_000_000) -> DataFrame:
    """Incidents among the newest events of the last day."""
    newest = events.where(F.col("ts").between(now - span_us, now)).orderBy(F.desc("ts"), "id").limit(limit)
    _, members = cp.campaigns(newest)
    edges = cp.causal_edges(members, newest)
    return cp.incidents(cp.chains(members, newest, edges), newest, edges, techniques)
