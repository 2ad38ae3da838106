"""Queries of the hunting surface: rankings, dashboards, recent lists, event scores, agents, drifted segments, live detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.functions import enrich, scores
from huntframe.functions.normalize import normalize
from huntframe.operators import evals, graph, rules, search
from huntframe.plans import live, plugins, sql
from huntframe.plans.detection import _ANOMALY, _ENTITIES, _J, _TRAFFIC, RULES, _rule_union
from huntframe.schema import CLASSES, SQL_EVENTS, SQL_UNIQUE, events, unique_events
from huntframe.session import Stages, scratch, table
from huntframe.sources import alerts as store
from huntframe.sources import sinks
from huntframe.sources.registry import AgentRegistry
from huntframe.sources.segments import read_drifted

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _panel(name: str, text: str) -> None:
    QUERIES[name] = lambda spark, d: sql.query(spark, text, {"events": events(spark, d)})
    ORACLE[name] = text.replace("FROM events", "FROM segment_events")


_panel("dashboard_classes", "SELECT ocsf_class_name, count(*) AS n FROM events GROUP BY ocsf_class_name")
_panel("dashboard_severities", "SELECT severity, count(*) AS n FROM events GROUP BY severity")
_panel("dashboard_total", "SELECT count(*) AS events FROM events")


@query(SQL_UNIQUE + " SELECT technique, count(*) AS n FROM (" + _rule_union("ue", "id") + ") WHERE technique IS NOT NULL GROUP BY technique ORDER BY n DESC, technique LIMIT 5")
def top_techniques(spark: SparkSession, d: str) -> DataFrame:
    found = rules.match(unique_events(spark, d), RULES).where("technique is not null")
    return found.groupBy("technique").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "technique").limit(5)


_PLACES = {r.rule_id: i for i, r in enumerate(RULES)}


@query(
    SQL_UNIQUE
    + ", m AS (SELECT id, technique, CASE rule_id "
    + " ".join(f"WHEN '{k}' THEN {i}" for k, i in _PLACES.items())
    + " END AS place FROM ("
    + _rule_union("ue", "id")
    + ") WHERE technique IS NOT NULL) SELECT id, arg_min(technique, place) AS technique FROM m GROUP BY id"
)
def first_techniques(spark: SparkSession, d: str) -> DataFrame:
    """The technique of each event: that of the first rule, in the order of the list, that matches and names one."""
    return rules.techniques(unique_events(spark, d), RULES).groupBy("id").agg(F.min_by("technique", "place").alias("technique"))


@query(
    SQL_UNIQUE
    + _ENTITIES
    + ", me AS (SELECT id, entity FROM en WHERE entity LIKE 'host:%-1_') SELECT me.entity, o.entity AS other, count(*) AS n FROM me JOIN en o ON o.id = me.id AND o.entity != me.entity GROUP BY me.entity, o.entity"
)
def entity_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Entities that occur in the same events as the chosen ones (hosts numbered 10 to 19), counted without a join."""
    keys = F.array_distinct(graph.entity_keys())
    rows = unique_events(spark, d).select(keys.alias("keys")).select(F.explode("keys").alias("entity"), "keys").where(F.col("entity").like("host:%-1_"))
    return rows.select("entity", F.explode("keys").alias("other")).where("entity != other").groupBy("entity", "other").agg(F.count("*").alias("n"))


@query(
    SQL_UNIQUE
    + _ENTITIES
    + """, c AS (SELECT DISTINCT id FROM ue WHERE severity_id >= 5), me AS (SELECT en.* FROM en JOIN c USING (id))
    SELECT DISTINCT me.id, o.id AS other FROM me JOIN en o ON o.entity = me.entity AND o.id != me.id AND abs(o.ts - me.ts) <= 1800000000"""
)
def co_entity_events(spark: SparkSession, d: str) -> DataFrame:
    """Events around each critical one that share an entity with it."""
    e = Stages(spark, "coentity").cut(unique_events(spark, d), "events")
    return graph.co_entity_events(e, e.where("severity_id >= 5"), 1_800_000_000)


@query(SQL_UNIQUE + " SELECT id, ts, message FROM ue WHERE ' ' || trim(lower(regexp_replace(message, '[^\\p{L}\\p{N}]+', ' ', 'g'))) || ' ' LIKE '% refused %' ORDER BY ts DESC, id LIMIT 25")
def newest_matches(spark: SparkSession, d: str) -> DataFrame:
    return search.search(unique_events(spark, d), "message:refused", limit=25).select("id", "ts", "message")


@query(SQL_UNIQUE + " SELECT rule_id, id, ts FROM (" + _rule_union("ue", "id, ts") + ") WHERE technique = 'T1110' ORDER BY ts DESC, id LIMIT 30")
def recent_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The newest alerts of one technique from the alert store."""
    kept = store.AlertStore(spark, scratch(spark, "recent"))
    kept.upsert(rules.match(unique_events(spark, d), RULES))
    newest = kept.table.read().where("technique = 'T1110'").withColumn("id", F.col("events")[0])
    return newest.orderBy(F.desc("ts"), "id").limit(30).select("rule_id", "id", "ts")


_SQL_TACTIC = (
    "CASE ocsf_class " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in scores.TACTIC_OF_CLASS.items()) + " ELSE 'unknown' END"
)


@query(
    SQL_UNIQUE
    + f""" SELECT id, concat_ws(' ', 'class=' || ocsf_class_name, 'actor=' || coalesce(actor_kind, '') || ':' || actor, 'target=' || coalesce(target_kind, '') || ':' || target, 'host=' || host, CASE WHEN message != '' THEN 'msg=' || message END) AS text,
      CAST(round({_ANOMALY}, 6) AS DOUBLE) AS anomaly, {_SQL_TACTIC} AS tactic, round(1 / (1 + (ingest_ts - ts) / 1e6 / 60), 6) AS closeness FROM ue WHERE ingest_ts >= ts"""
)
def event_scores(spark: SparkSession, d: str) -> DataFrame:
    """What the causal graph is weighted by: text, anomaly, tactic of the class, closeness of arrival."""
    e = unique_events(spark, d).where("ingest_ts >= ts")
    text = scores.event_text(*[F.col(c) for c in ("ocsf_class_name", "actor_kind", "actor", "target_kind", "target", "host", "message")])
    return e.select(
        "id", text.alias("text"), F.round(scores.anomaly(F.col("severity_id"), F.col("message")), 6).alias("anomaly"), scores.tactic(F.lit(None).cast("string"), F.col("ocsf_class")).alias("tactic"),
        F.round(scores.temporal(F.col("ingest_ts") - F.col("ts")), 6).alias("closeness"),
    )


@query(
    SQL_EVENTS
    + """, h AS (SELECT host, min(ts) AS lo, max(ts) AS hi FROM ev WHERE host IS NOT NULL GROUP BY host), x AS (SELECT CAST(min(ts) AS BIGINT) + (max(ts) - min(ts)) // 2 AS m FROM ev),
    o AS (SELECT host, min(ts) AS lo, max(ts) AS hi FROM ev, x WHERE host IS NOT NULL AND ts < m GROUP BY host), l AS (SELECT host, max(ts) AS seen, bool_or(severity_id >= 5) AS bad FROM ev, x WHERE host IS NOT NULL AND ts >= m GROUP BY host)
    SELECT o.host AS agent_id, o.lo AS enrolled_ts, l.seen IS NOT NULL AS connected, coalesce(l.seen, o.hi) AS last_seen, coalesce(l.bad, false) AS isolated FROM o LEFT JOIN l ON l.host = o.host"""
)
def agents_durable_and_live(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of the first half of the time as enrolled agents, those of the second half as live state."""
    e = events(spark, d).where("host is not null")
    lo, hi = events(spark, d).agg(F.min("ts"), F.max("ts")).first()
    half = (lo or 0) + ((hi or 0) - (lo or 0)) // 2
    agents = AgentRegistry(spark, scratch(spark, "agents"))
    agents.enrol(e.where(F.col("ts") < half).groupBy(F.col("host").alias("agent_id")).agg(F.min("ts").alias("enrolled_ts"), F.max("ts").alias("last_seen")).withColumn("hostname", F.col("agent_id")))
    live_now = e.where(F.col("ts") >= half).select(F.col("host").alias("agent_id"), F.col("ts").alias("last_seen"), (F.col("severity_id") >= 5).alias("isolated"))
    return agents.view(live_now).select("agent_id", "enrolled_ts", "connected", "last_seen", "isolated")


@query(
    SQL_EVENTS
    + """, p AS (SELECT CASE WHEN severity_id >= 3 THEN host END AS host, CASE WHEN severity_id >= 3 THEN severity END AS severity, ocsf_class, severity_id >= 3 AS late FROM ev)
    SELECT ocsf_class, coalesce(host, '') AS host, coalesce(severity, '') AS severity, count(*) AS n FROM p GROUP BY ALL"""
)
def segments_of_two_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Segments of an older writer, without host and severity and with text classes, read as one table with newer ones."""
    e = events(spark, d)
    root = scratch(spark, "drifted")
    e.where("severity_id < 3 or severity_id is null").drop("host", "severity").withColumn("ocsf_class", F.col("ocsf_class").cast("string")).write.parquet(f"{root}/old")
    e.where("severity_id >= 3").write.parquet(f"{root}/new")
    rows = read_drifted(spark, [f"{root}/old", f"{root}/new"])
    return rows.groupBy("ocsf_class", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("severity", F.lit("")).alias("severity")).agg(F.count("*").alias("n"))


@query(
    SQL_UNIQUE
    + f""", a AS (SELECT rule_id, technique FROM ({_rule_union("ue", "id")})), n AS (SELECT string_split(CASE WHEN target_kind IN ('domain', 'host') THEN target ELSE coalesce({_J("domain")}, {_J("dns_query")}, {_J("query")}, json_extract_string(fields_json, '$."dns.question.name"'), {_J("host")}) END, '.') AS parts FROM ue),
    l AS (SELECT CASE WHEN len(parts) >= 3 THEN parts[-3] ELSE parts[1] END AS label FROM n), d AS (SELECT label, count(*) AS n FROM l WHERE octet_length(encode(label)) >= 8 GROUP BY label),
    c AS (SELECT label, unnest(string_split(label, '')) AS ch FROM d), f AS (SELECT label, ch, count(*) AS k FROM c GROUP BY ALL), e AS (SELECT label, -sum((k / length(label)) * log2(k / length(label))) AS e FROM f GROUP BY label)
    SELECT rule_id, coalesce(technique, '') AS technique, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'generated-names', 'T1568.002', CAST(sum(n) AS BIGINT) FROM d JOIN e USING (label) WHERE round(e, 2) >= 2.75 HAVING count(*) > 0"""
)
def live_detection(spark: SparkSession, d: str) -> DataFrame:
    """Rules and a detector in the order of the live path, counted."""

    def generated(e: DataFrame) -> DataFrame:
        return enrich.dga_alerts(e, 2.75)

    generated.__name__ = "generated-names"
    found = live.detect(Stages(spark, "live").cut(unique_events(spark, d), "events"), RULES, [], [generated])
    return found.groupBy("rule_id", F.coalesce("technique", F.lit("")).alias("technique")).agg(F.count("*").alias("n"))


_AUTH = "username IS NOT NULL OR lower(message) LIKE '%authentication%' OR lower(message) LIKE '%failed password%' OR lower(message) LIKE '%login%' OR lower(message) LIKE '%logon%' OR lower(message) LIKE '%sshd%'"


@query(
    f"""SELECT event_id, coalesce(message, '') AS message, coalesce(nullif(username, ''), nullif(regexp_extract(message, '(?i:for) (?:invalid user )?(\\S+)', 1), ''), '') AS actor FROM (SELECT DISTINCT * FROM mixed_traffic) WHERE {_AUTH}"""
)
def normalize_users(spark: SparkSession, d: str) -> DataFrame:
    """The user of each authentication record, from its field or from its message."""
    t = table(spark, d, "mixed_traffic").distinct()
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in _TRAFFIC.items()])
    records = t.select("event_id", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("fields"))
    return normalize(records).where("ocsf_class = 3002").select("event_id", "message", F.coalesce("actor", F.lit("")).alias("actor"))


_TITLES = "CASE rule_id " + " ".join(f"WHEN '{r.rule_id}' THEN '{r.title}'" for r in RULES) + " END"
_LEVELS = "CASE severity_id WHEN 1 THEN 'INFORMATIONAL' WHEN 2 THEN 'LOW' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'HIGH' WHEN 5 THEN 'CRITICAL' END"


@query(
    SQL_UNIQUE
    + f""", a AS (SELECT *, {_TITLES} AS title, row_number() OVER (PARTITION BY rule_id ORDER BY ts, id) AS n FROM ({_rule_union("ue", "id, ts")}))
    SELECT rule_id, '{{"text":"[' || {_LEVELS} || '] ' || title || coalesce(' (' || technique || ')', '') || '"}}' AS chat, '{{"fields":{{"project":{{"key":"SEC"}},"summary":"' || title || '","description":"' || id || '","issuetype":{{"name":"Task"}}}}}}' AS ticket FROM a WHERE n = 1"""
)
def sink_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What is sent for the first alert of each rule; the alerts pass through a JSON lines sink on the way."""
    path = f"{scratch(spark, 'sink')}/alerts"
    found = rules.match(unique_events(spark, d), RULES)
    sinks.write_json_lines(found, path)
    stored = spark.read.schema(found.schema).json(path)
    return sinks.first_per_rule(stored).select("rule_id", sinks.chat_payload().alias("chat"), sinks.ticket_payload("SEC").alias("ticket"))


@query(SQL_UNIQUE + " SELECT id, ts FROM ue WHERE ' ' || trim(lower(regexp_replace(message, '[^\\p{L}\\p{N}]+', ' ', 'g'))) || ' ' LIKE '% flow %' ORDER BY ts DESC, id LIMIT 1000")
def search_clamped(spark: SparkSession, d: str) -> DataFrame:
    """A limit beyond the greatest one gives the newest thousand."""
    return search.search(unique_events(spark, d), "message:flow", limit=1_000_000).select("id", "ts")


@query("SELECT tenant, count(*) AS n FROM segment_events WHERE tenant IN ('juniper', 'marsh', 'quarry') GROUP BY tenant")
def routed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the inputs (tenants here) whose pipelines lead to the rules."""
    pipelines = [{"inputs": ["juniper", "marsh"], "route": ["rules", "index"]}, {"inputs": ["quarry"], "route": ["rules"]}, {"inputs": ["vesper"], "route": ["index"]}]
    return plugins.routed(events(spark, d).withColumn("input_id", F.col("tenant")), pipelines, "rules").groupBy("tenant").agg(F.count("*").alias("n"))


_T95 = "[" + ", ".join(map(str, evals.T95)) + "]"


@query(
    SQL_EVENTS
    + f""", d AS (SELECT tenant, ts // 86400000000 AS day, count(*) AS k FROM ev GROUP BY ALL), g AS (SELECT tenant, count(*) AS n, avg(k) AS mean, stddev_samp(k) AS sd FROM d GROUP BY tenant)
    SELECT tenant, n, round(mean, 6) AS mean, round(CASE WHEN n < 2 THEN 0.0 ELSE CAST(CASE WHEN n <= 31 THEN {_T95}[CAST(n - 1 AS INTEGER)] ELSE 1.96 END AS DOUBLE) * sd / sqrt(n) END, 6) AS half_width FROM g"""
)
def daily_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Mean events a day of each tenant with the half width of its 95 % interval."""
    days = events(spark, d).groupBy("tenant", F.call_function("div", F.col("ts"), F.lit(86_400_000_000)).alias("day")).agg(F.count("*").alias("k"))
    return evals.intervals(days, ["tenant"], "k").select("tenant", "n", F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


_ALPHABET = [*CLASSES, 1008]
_LETTERS = "CASE ocsf_class " + " ".join(f"WHEN {c} THEN '{chr(65 + i)}'" for i, c in enumerate(_ALPHABET)) + " ELSE '?' END"


@query(
    SQL_UNIQUE
    + f""", o AS (SELECT host, ocsf_class, row_number() OVER (PARTITION BY host ORDER BY ts, id) AS i, row_number() OVER (PARTITION BY host ORDER BY ts DESC, id DESC) AS j FROM ue WHERE host IS NOT NULL),
    c AS (SELECT *, {_LETTERS} AS ch FROM o), a AS (SELECT host, string_agg(ch, '' ORDER BY i) AS s FROM c WHERE i <= 12 GROUP BY host), b AS (SELECT host, string_agg(ch, '' ORDER BY i) AS s FROM c WHERE j <= 12 GROUP BY host)
    SELECT host, round(1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) AS similarity FROM a JOIN b USING (host)"""
)
def chain_similarities(spark: SparkSession, d: str) -> DataFrame:
    """How alike the first and the last twelve steps of each host are, by the classes of their events."""
    rows = unique_events(spark, d).where("host is not null").select("host", "ts", "id", "ocsf_class")
    ends = {}
    for name, order in (("a", ("ts", "id")), ("b", (F.desc("ts"), F.desc("id")))):  # a rank limit works before the shuffle, so a busy host sends twelve rows a task
        kept = rows.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where("r <= 12")
        ends[name] = kept.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "ocsf_class"))), lambda x: x["ocsf_class"]).alias(name))
    both = ends["a"].join(ends["b"], "host")
    return both.select("host", F.round(evals.sequence_similarity(F.col("a"), F.col("b"), _ALPHABET), 6).alias("similarity"))


@query(
    SQL_UNIQUE
    + f""", n AS (SELECT id, string_split(CASE WHEN target_kind IN ('domain', 'host') THEN target ELSE coalesce({_J("domain")}, {_J("dns_query")}, {_J("query")}, json_extract_string(fields_json, '$."dns.question.name"'), {_J("host")}) END, '.') AS parts FROM ue),
    l AS (SELECT id, CASE WHEN len(parts) >= 3 THEN parts[-3] ELSE parts[1] END AS label FROM n), d AS (SELECT DISTINCT label FROM l WHERE octet_length(encode(label)) >= 8),
    c AS (SELECT label, unnest(string_split(label, '')) AS ch FROM d), f AS (SELECT label, ch, count(*) AS k FROM c GROUP BY ALL), e AS (SELECT label, -sum((k / length(label)) * log2(k / length(label))) AS e FROM f GROUP BY label)
    SELECT id, label AS dns_label, round(e, 2) AS entropy, coalesce(e >= 3.5, false) AS suspect FROM l LEFT JOIN e USING (label) WHERE label IS NOT NULL"""
)
def entropy_fields(spark: SparkSession, d: str) -> DataFrame:
    return enrich.with_entropy(unique_events(spark, d)).where("dns_label is not null").select("id", "dns_label", "entropy", "suspect")
