"""Queries p1 to p4 and p6: the data-quality operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.operators import bad_rows, drift, instants, late, sessions
from huntframe.session import Stages, scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.failures(table(spark, d, "codec_frames"))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    rows = bad_rows.loaded(table(spark, d, "codec_frames"))
    return rows.select("frame_id", "codec", F.to_json("fields").alias("fields_json"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    columns = Stages(spark, "drift").cut(drift.profiles(table(spark, d, "traffic_lines")), "columns")
    return drift.changes(table(spark, d, "traffic_files"), columns)


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.unified(table(spark, d, "traffic_files"), table(spark, d, "traffic_lines"))
    return rows.select("file_id", "line_no", F.to_json("fields").alias("fields_json"))


def p3_found(spark: SparkSession, d: str, batches: int = 2) -> DataFrame:
    """Codec texts and the segment times whose unit is wrong, all through one dictionary that batches of arrival extend."""
    sources = table(spark, d, "input_sources").select("input_name", "zone_name", "date_order").dropDuplicates(["input_name"])
    records = table(spark, d, "codec_records").select("record_id", "input_name", "ts_text", "recv_us").where("ts_text is not null").join(sources, "input_name", "left")
    codec = records.select(F.lit("codec").alias("origin"), F.col("record_id").cast("string").alias("rec_id"), "ts_text", "recv_us", "zone_name", "date_order")
    # An event's time is a text of its digits; what is in microseconds already is no question and stays out.
    wrong = table(spark, d, "segment_events").select("id", "ts", "ingest_ts").where(F.col("id").isNotNull() & (F.col("ts") != instants.unit_to_us(F.col("ts"))))
    none = F.lit(None).cast("string")
    segment = wrong.select(F.lit("segment").alias("origin"), F.col("id").alias("rec_id"), F.col("ts").cast("string").alias("ts_text"), F.col("ingest_ts").alias("recv_us"), none.alias("zone_name"), none.alias("date_order"))
    words = instants.InstantDictionary(spark, scratch(spark, "instants"))
    rows = Stages(spark, "times").cut(words.keyed(codec.unionByName(segment)), "rows")
    lo, hi = rows.agg(F.min("recv_us"), F.max("recv_us")).first()
    step = ((hi or 0) - (lo or 0)) // batches + 1
    which = F.coalesce(F.call_function("div", F.col("recv_us") - F.lit(lo or 0), F.lit(step)), F.lit(0))
    for n in range(batches):
        words.extend(rows.where(which == n))
    return words.lookup(rows).where("ts_us is not null").groupBy("origin", "rec_id").agg(F.min("ts_us").alias("ts_us"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "mixed_traffic")
    return sessions.sessions(
        events, scratch(spark, "sessions"), key="event_id", ts="ts", user=F.col("username"), device=F.col("host"), gap_us=30 * 60 * 1_000_000
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "segment_events").select("id", "tenant", instants.unit_to_us(F.col("ts")).alias("ts_us"), F.col("ingest_ts").alias("arrival"))
    counts = late.late_counts(events, scratch(spark, "late"))  # ids are forgotten a week behind the newest arrival
    return counts.where("n_late > 0").select("tenant", "hour_us", "n_first", "n_final", "n_refused")


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p2_found": p2_found, "p2_unified": p2_unified, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found}

_US = "CASE WHEN abs(ts) < 10000000000 THEN ts * 1000000 WHEN abs(ts) < 10000000000000 THEN ts * 1000 WHEN abs(ts) < 10000000000000000 THEN ts ELSE ts // 1000 END"
ORACLE = {
    "p2_found": """WITH l AS (SELECT DISTINCT file_id, payload FROM traffic_lines), k AS (SELECT file_id, payload, unnest(json_keys(payload)) AS name FROM l),
      v AS (SELECT file_id, name, json_extract(payload, '$."' || name || '"') AS j FROM k), t AS (SELECT file_id, name, CAST(j AS VARCHAR) AS val,
        CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind
        FROM v WHERE json_type(j) != 'NULL'),
      p AS (SELECT file_id, name, min(kind) AS kind, list_sort(list(DISTINCT val)) AS vals FROM t GROUP BY file_id, name),
      s AS (SELECT DISTINCT file_id, feed, file_no, lag(file_id) OVER (PARTITION BY feed ORDER BY file_no) AS before FROM traffic_files),
      n AS (SELECT s.file_id, p.name, p.kind, p.vals FROM s JOIN p ON p.file_id = s.file_id WHERE before IS NOT NULL), o AS (SELECT s.file_id, p.name, p.kind, p.vals FROM s JOIN p ON p.file_id = s.before),
      f AS (SELECT coalesce(n.file_id, o.file_id) AS file_id, o.name AS a, n.name AS b, o.kind AS ka, n.kind AS kb, o.vals AS va, n.vals AS vb FROM n FULL JOIN o ON n.file_id = o.file_id AND n.name = o.name),
      e AS (SELECT * FROM f WHERE b IS NULL), g AS (SELECT * FROM f WHERE a IS NULL), r AS (SELECT e.file_id, e.a, g.b, e.ka AS kind FROM e JOIN g ON e.file_id = g.file_id AND e.ka = g.kb AND e.va = g.vb)
      SELECT file_id, 'retyped' AS change_kind, a AS field_before, b AS field_after, ka AS type_before, kb AS type_after FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND ka != kb
      UNION ALL SELECT file_id, 'renamed', a, b, kind, kind FROM r
      UNION ALL SELECT file_id, 'removed', a, '', ka, '' FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file_id = e.file_id AND r.a = e.a)
      UNION ALL SELECT file_id, 'added', '', b, '', kb FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file_id = g.file_id AND r.b = g.b)""",
    "p4_found": """WITH e AS (SELECT DISTINCT event_id, ts, username, host FROM mixed_traffic),
      o AS (SELECT ts, CASE WHEN lower(trim(username)) NOT IN ('', '-') THEN 'user' ELSE 'device' END AS owner_kind, CASE WHEN lower(trim(username)) NOT IN ('', '-') THEN lower(trim(username)) WHEN trim(host) != '' THEN host END AS owner_name FROM e),
      g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM o WHERE ts IS NOT NULL AND owner_name IS NOT NULL WINDOW w AS (PARTITION BY owner_kind, owner_name ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY owner_kind, owner_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
      SELECT owner_kind, owner_name, min(ts) AS start_us, max(ts) AS end_us, max(ts) - min(ts) AS duration_us, count(*) AS n_events FROM s GROUP BY owner_kind, owner_name, nth""",
    "p6_found": f"""WITH e AS (SELECT id, arg_min(tenant, ingest_ts) AS tenant, arg_min({_US}, ingest_ts) AS t, min(ingest_ts) AS a FROM segment_events GROUP BY id), h AS (SELECT tenant, t // 3600000000 * 3600000000 AS hour_us, a FROM e)
      SELECT tenant, hour_us, count(*) FILTER (WHERE a < hour_us + 3600000000) AS n_first, count(*) FILTER (WHERE a < hour_us + 25200000000) AS n_final, count(*) FILTER (WHERE a >= hour_us + 25200000000) AS n_refused
      FROM h GROUP BY tenant, hour_us HAVING count(*) FILTER (WHERE a >= hour_us + 3600000000) > 0""",
}
