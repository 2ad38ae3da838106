"""Queries of detection and correlation: codecs, rules, windows, enrichment, graphs, storage, streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.functions import enrich, scores
from huntframe.functions.normalize import normalize, to_events
from huntframe.operators import campaigns as cp
from huntframe.operators import correlation, evals, graph, rules, templates, vectors
from huntframe.schema import SQL_EVENTS, SQL_UNIQUE, events, unique_events
from huntframe.session import Stages, scratch, table
from huntframe.sources import alerts as store
from huntframe.sources import codecs
from huntframe.sources.segments import SegmentStore
from huntframe.streaming import pipeline

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


RULES = [
    rules.Rule("Login refused", {"sel": {"message|contains": "login refused"}, "condition": "sel"}, id="auth-refused", level="medium", tags=["attack.credential_access", "attack.t1110"]),
    rules.Rule("Second factor failed by operators", {"sel": {"user|startswith": "op.", "message|contains": ["second factor", "factor failed"]}, "ops": {"host|endswith": "-10"}, "condition": "sel and not ops"}, id="auth-factor", level="high", tags=["attack.t1110.003"]),
    rules.Rule("Key material touched", {"sel": {"target|contains|all": ["keys.d", "/etc/"]}, "verbs": ["removed", "changed"], "condition": "sel and verbs"}, id="file-keys", level="critical", tags=["attack.t1552"]),
    rules.Rule("Shell or copy tool started", {"proc_a": {"process": ["bash", "curl"]}, "proc_b": {"cmd|re": r"^(tar|rsync) --job \d+"}, "cls": {"message|contains": "started"}, "condition": "cls and 1 of proc_*"}, id="proc-tools", level="low", tags=["attack.t1059"]),
    rules.Rule("Odd web answers", {"a": {"status_code": [500, 503]}, "b": {"method": "DELETE"}, "c": {"url": "/admin*"}, "condition": "2 of them"}, id="web-odd", level="medium"),
    rules.Rule("Registry autostart", {"sel": [{"target": "HK*Run"}, {"target|endswith": "Startup"}], "none": {"actor": None}, "condition": "sel or (none and not sel and nothing)"}, id="reg-run", level="high", tags=["attack.t1547"]),
    rules.Rule("Name lookups outside", {"q": {"dns_query|endswith": ".example"}, "kind": {"message|contains": "type TXT"}, "condition": "all of them"}, id="dns-txt", level="low", tags=["attack.t1071.004"]),
    rules.Rule("Keyword drop", {"k": ["closed after", "queue depth 1"], "f": {"dst_port": 22}, "condition": ["k and f", "k and f and f"]}, id="net-ssh", level="informational"),
]

_J = lambda k: f"json_extract_string(fields_json, '$.{k}')"
#: The same rules as SQL predicates, with severity and technique.
RULE_SQL = {
    "auth-refused": ("lower(message) LIKE '%login refused%'", 3, "T1110"),
    "auth-factor": (f"lower(coalesce({_J('user')}, CASE WHEN actor_kind = 'user' THEN actor END)) LIKE 'op.%' AND (lower(message) LIKE '%second factor%' OR lower(message) LIKE '%factor failed%') AND NOT coalesce(lower(host) LIKE '%-10', false)", 4, "T1110.003"),
    "file-keys": ("lower(target) LIKE '%keys.d%' AND lower(target) LIKE '%/etc/%' AND (lower(message) LIKE '%removed%' OR lower(message) LIKE '%changed%')", 5, "T1552"),
    "proc-tools": (f"lower(message) LIKE '%started%' AND (lower(coalesce({_J('process')}, CASE WHEN actor_kind = 'process' THEN actor END)) IN ('bash', 'curl') OR coalesce(regexp_matches(coalesce({_J('cmd')}, message), '^(tar|rsync) --job [0-9]+'), false))", 2, "T1059"),
    "web-odd": (f"CAST(coalesce({_J('status_code')} IN ('500', '503'), false) AS INT) + CAST(coalesce(lower({_J('method')}) = 'delete', false) AS INT) + CAST(coalesce(regexp_matches(lower({_J('url')}), '^/admin.*$'), false) AS INT) >= 2", 3, None),
    "reg-run": ("(regexp_matches(target, '^(?i)hk.*run$') OR lower(target) LIKE '%startup')", 4, "T1547"),
    "dns-txt": (f"lower({_J('dns_query')}) LIKE '%.example' AND lower(message) LIKE '%type txt%'", 2, "T1071.004"),
    "net-ssh": (f"(lower(message) LIKE '%closed after%' OR lower(message) LIKE '%queue depth 1%') AND {_J('dst_port')} = '22'", 1, None),
}


def _rule_union(source: str, cols: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule_id, {sev} AS severity_id, {repr(t) if t else 'NULL'} AS technique, {cols} FROM {source} WHERE coalesce({p}, false)" for k, (p, sev, t) in RULE_SQL.items())


@query(SQL_EVENTS + " SELECT rule_id, severity_id, coalesce(technique, '') AS technique, id, ts FROM (" + _rule_union("ev", "id, ts") + ")")
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    return rules.match(events(spark, d), RULES).select("rule_id", "severity_id", F.coalesce("technique", F.lit("")).alias("technique"), F.col("events")[0].alias("id"), "ts")


BRUTE = correlation.CorrelationRule("corr-refused", "Many refused logins", "event_count", ["auth-refused", "auth-factor"], "2d", ["user"], {"gte": 3}, level="high", technique="T1110")
SPREAD = correlation.CorrelationRule("corr-hosts", "Refused on many hosts", "value_count", ["auth-refused"], "5d", ["user"], {"field": "host", "gte": 3})
BOTH = correlation.CorrelationRule("corr-both", "Refused and tools", "temporal", ["proc-tools", "file-keys"], "12h", ["host"])
ORDERED = correlation.CorrelationRule("corr-order", "Tools, then keys", "temporal_ordered", ["proc-tools", "file-keys"], "12h", ["host"])


def _fold_sql(rule: correlation.CorrelationRule, key: str, value: str, holds: str) -> str:
    """The fold as a recursive query that walks each group's alerts and carries the window as a list."""
    chosen = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, id, ts, {key} AS key, {value} AS value FROM ue WHERE coalesce({RULE_SQL[k][0]}, false)" for k in rule.rules)
    return (
        SQL_UNIQUE.replace("WITH ev", "WITH RECURSIVE ev", 1)
        + f""", a AS ({chosen}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id, rule_id) AS i FROM a),
    w AS (SELECT key, i, ts, [struct_pack(t := ts, r := rule_id, v := value)] AS win, false AS fired, 0 AS size FROM n WHERE i = 0
      UNION ALL SELECT key, 0, 0, CAST([] AS STRUCT(t BIGINT, r VARCHAR, v VARCHAR)[]), false, 0 FROM (SELECT DISTINCT key FROM n)
      UNION ALL SELECT key, i, ts, CASE WHEN {holds} THEN [] ELSE win END, {holds}, len(win) FROM (
        SELECT n.key, n.i, n.ts, list_append(list_filter(w.win, lambda x: x.t >= n.ts - {rule.span_us}), struct_pack(t := n.ts, r := n.rule_id, v := n.value)) AS win FROM w JOIN n ON n.key = w.key AND n.i = w.i + 1))
    SELECT key, ts, CAST(size AS INTEGER) AS n_alerts FROM w WHERE fired"""
    )


_USER = f"coalesce({_J('user')}, CASE WHEN actor_kind = 'user' THEN actor END, '')"
_HOST = "coalesce(json_extract_string(fields_json, '$.host'), host, '')"


def _fired(spark: SparkSession, d: str, rule: correlation.CorrelationRule) -> DataFrame:
    base = [r for r in RULES if r.rule_id in rule.rules]
    return correlation.correlate(correlation.entries(correlation.matched(unique_events(spark, d), base, [rule])), [rule]).drop("rule")


def _sized(fired: DataFrame) -> DataFrame:
    return fired.select("key", "ts", F.size("events").alias("n_alerts"))


@query(_fold_sql(BRUTE, _USER, "NULL", "len(win) >= 3"))
def corr_event_count(spark: SparkSession, d: str) -> DataFrame:
    return _sized(_fired(spark, d, BRUTE))


@query(_fold_sql(SPREAD, _USER, _HOST, "len(list_distinct(list_filter(list_transform(win, lambda x: x.v), lambda y: y IS NOT NULL AND y != ''))) >= 3"))
def corr_value_count(spark: SparkSession, d: str) -> DataFrame:
    return _sized(_fired(spark, d, SPREAD))


@query(_fold_sql(BOTH, _HOST, "NULL", "list_contains(list_transform(win, lambda x: x.r), 'proc-tools') AND list_contains(list_transform(win, lambda x: x.r), 'file-keys')"))
def corr_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _sized(_fired(spark, d, BOTH))


@query(_fold_sql(ORDERED, _HOST, "NULL", "coalesce(list_contains(list_transform(win, lambda x: x.r)[list_position(list_transform(win, lambda x: x.r), 'proc-tools'):], 'file-keys') AND list_contains(list_transform(win, lambda x: x.r), 'proc-tools'), false)"))
def corr_temporal_ordered(spark: SparkSession, d: str) -> DataFrame:
    return _sized(_fired(spark, d, ORDERED))


def _corr_counts(rule: correlation.CorrelationRule, key: str, holds: str) -> str:
    return f"SELECT '{rule.id}' AS rule_id, ts FROM ({_fold_sql(rule, key, 'NULL', holds)})"


_ORDERED_HOLDS = "coalesce(list_contains(list_transform(win, lambda x: x.r)[list_position(list_transform(win, lambda x: x.r), 'proc-tools'):], 'file-keys') AND list_contains(list_transform(win, lambda x: x.r), 'proc-tools'), false)"


@query(
    SQL_UNIQUE
    + ", b AS (SELECT rule_id, ts FROM ("
    + _rule_union("ue", "ts")
    + f") WHERE rule_id NOT IN ('auth-refused', 'auth-factor', 'proc-tools', 'file-keys')), c AS ({_corr_counts(BRUTE, _USER, 'len(win) >= 3')} UNION ALL {_corr_counts(ORDERED, _HOST, _ORDERED_HOLDS)})"
    + " SELECT rule_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY rule_id"
)
def retro_hunt(spark: SparkSession, d: str) -> DataFrame:
    out = correlation.retro_hunt(unique_events(spark, d), RULES, [BRUTE, ORDERED])
    return out.groupBy("rule_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query()
def decode_records(spark: SparkSession, d: str) -> DataFrame:
    r = codecs.decode(table(spark, d, "codec_frames").dropDuplicates(["frame_id"]).select("frame_id", "codec", "raw"))
    return r.select("frame_id", "codec", "item", F.size("fields").alias("n_fields"), F.try_element_at("fields", F.lit("message")).alias("message"), F.map_contains_key("fields", "decode_error").alias("dead"))


def _decoded(spark: SparkSession, d: str, codec: str) -> DataFrame:
    frames = table(spark, d, "codec_frames").where(F.col("codec") == codec).where(F.is_valid_utf8(F.col("raw").cast("string"))).dropDuplicates(["frame_id"])
    return codecs.decode(frames.select("frame_id", "codec", "raw"))


def _sql_texts(codec: str) -> str:
    return f"WITH t AS (SELECT DISTINCT frame_id, regexp_replace(trim(try(decode(raw))), '[\\r\\n]+$', '') AS s FROM codec_frames WHERE codec = '{codec}' AND try(decode(raw)) IS NOT NULL)"


@query(
    _sql_texts("json")
    + """, o AS (SELECT frame_id, s, CASE WHEN json_valid(s) THEN json_type(s) END AS k FROM t), a AS (SELECT frame_id, unnest(from_json(s, '["JSON"]')) AS e, unnest(range(CAST(json_array_length(s) AS BIGINT))) AS item FROM o WHERE k = 'ARRAY')
    SELECT frame_id, 0 AS item, 2 AS n_fields, true AS dead FROM o WHERE k IS NULL UNION ALL SELECT frame_id, 0, CAST(len(json_keys(s)) AS INTEGER), false FROM o WHERE k = 'OBJECT'
    UNION ALL SELECT frame_id, CAST(item AS INTEGER), CAST(CASE WHEN json_type(e) = 'OBJECT' THEN len(json_keys(e)) ELSE 1 END AS INTEGER), false FROM a UNION ALL SELECT frame_id, 0, 1, false FROM o WHERE k NOT IN ('OBJECT', 'ARRAY')"""
)
def decode_json(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d, "json").select("frame_id", "item", F.size("fields").alias("n_fields"), F.map_contains_key("fields", "decode_error").alias("dead"))


def _headers(fields: list[str]):
    at = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    return [at(k).alias(k) for k in fields]


_SHOW = "trim(replace(replace({}, chr(2), '|'), chr(1), chr(92)))"


@query(
    _sql_texts("cef")
    + r""", f AS (SELECT frame_id, s, string_split(replace(replace(regexp_extract(s, '(?s)CEF:(.*)$', 1), '\\', chr(1)), '\|', chr(2)), '|') AS f FROM t)
    SELECT frame_id, """
    + ", ".join(f"CASE WHEN contains(s, 'CEF:') AND len(f) >= 7 THEN {_SHOW.format(f'f[{i + 1}]')} ELSE '' END AS {k}" for i, k in enumerate(["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "cef_severity"]))
    + ", NOT (contains(s, 'CEF:') AND len(f) >= 7) AS dead FROM f"
)
def decode_cef(spark: SparkSession, d: str) -> DataFrame:
    names = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "cef_severity"]
    return _decoded(spark, d, "cef").select("frame_id", *_headers(names), F.map_contains_key("fields", "decode_error").alias("dead"))


@query(
    _sql_texts("leef")
    + r""", f AS (SELECT frame_id, s, string_split(replace(replace(regexp_extract(s, '(?s)LEEF:(.*)$', 1), '\\', chr(1)), '\|', chr(2)), '|') AS f FROM t), g AS (SELECT *, contains(s, 'LEEF:') AND len(f) >= CASE WHEN f[1] LIKE '2%' THEN 7 ELSE 6 END AS good FROM f)
    SELECT frame_id, """
    + ", ".join(f"CASE WHEN good THEN {_SHOW.format(f'f[{i + 1}]')} ELSE '' END AS {k}" for i, k in enumerate(["leef_version", "device_vendor", "device_product", "device_version", "event_id"]))
    + ", NOT good AS dead FROM g"
)
def decode_leef(spark: SparkSession, d: str) -> DataFrame:
    names = ["leef_version", "device_vendor", "device_product", "device_version", "event_id"]
    return _decoded(spark, d, "leef").select("frame_id", *[F.trim(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))).alias(k) for k in names], F.map_contains_key("fields", "decode_error").alias("dead"))


@query(
    r"""WITH t AS (SELECT DISTINCT frame_id, regexp_extract(try(decode(raw)), '^\s*<(\d{1,3})>', 1) AS pri FROM codec_frames WHERE codec = 'syslog' AND try(decode(raw)) IS NOT NULL)
    SELECT frame_id, CAST(pri AS INTEGER) // 8 AS facility, CAST(pri AS INTEGER) % 8 AS severity FROM t WHERE pri != ''"""
)
def decode_syslog_priority(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "codec_frames").where("codec = 'syslog'").where(F.is_valid_utf8(F.col("raw").cast("string"))).dropDuplicates(["frame_id"])
    f = codecs.decode(frames)
    at = lambda k: F.try_element_at("fields", F.lit(k)).cast("int")
    return f.where(at("syslog_facility").isNotNull()).select("frame_id", at("syslog_facility").alias("facility"), at("syslog_severity").alias("severity"))


_TRAFFIC = {"host": "host", "app": "app", "username": "username", "src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "dst_port", "process": "process", "cmd": "cmd", "method": "http_method", "url": "url", "status_code": "status_code", "eventName": "eventname", "message": "message"}


@query(
    """SELECT event_id, CASE WHEN username IS NOT NULL OR lower(message) LIKE '%authentication%' OR lower(message) LIKE '%failed password%' OR lower(message) LIKE '%login%' OR lower(message) LIKE '%logon%' OR lower(message) LIKE '%sshd%' THEN 3002
        WHEN http_method IS NOT NULL OR url IS NOT NULL OR status_code IS NOT NULL THEN 4002 WHEN src_ip IS NOT NULL OR dst_ip IS NOT NULL OR dst_port IS NOT NULL THEN 4001
        WHEN process IS NOT NULL OR cmd IS NOT NULL THEN 1007 WHEN eventname IS NOT NULL THEN 6003 WHEN app IS NOT NULL AND app != '' THEN 1007 ELSE 1008 END AS ocsf_class,
      coalesce(nullif(host, ''), '') AS host, CASE WHEN lower(message) LIKE '%failed%' OR lower(message) LIKE '%error%' OR lower(message) LIKE '%denied%' THEN 3 ELSE 1 END AS severity_id
    FROM (SELECT DISTINCT * FROM mixed_traffic)"""
)
def normalize_traffic(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mixed_traffic").distinct()
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in _TRAFFIC.items()])
    records = t.select("event_id", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("fields"))
    return normalize(records).select("event_id", "ocsf_class", F.coalesce("host", F.lit("")).alias("host"), "severity_id")


@query()
def ingest_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Frames decoded, normalized, redacted and stored; what the store then holds, by class."""
    records = codecs.decode(table(spark, d, "codec_frames").dropDuplicates(["frame_id"]).select("frame_id", "codec", "raw", "recv_us"))
    rows = to_events(records, F.concat_ws("-", F.lit("fr"), "frame_id", "item"), F.col("recv_us"), F.col("recv_us"), F.lit("default"))
    segments = SegmentStore(spark, scratch(spark, "ingest"))
    segments.append(enrich.redact_events(rows), slices=2)
    return segments.read().groupBy("ocsf_class_name", "actor_kind").agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})', '***@\1', 'g'), 'AKIA[0-9A-Z]{16}', 'AKIA****************', 'g'),
      '(password|passwd|secret|token|api[_-]?key)([\t\n\x0B\f\r ]*[:=][\t\n\x0B\f\r ]*)[^\t\n\x0B\f\r ]+', '\1\2***', 'gi'), 'https://', 'hxxps://'), 'http://', 'hxxp://') AS redacted FROM documents WHERE text IS NOT NULL"""
)
def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", enrich.redact(F.col("text")).alias("redacted"))


@query(
    SQL_EVENTS
    + """, l AS (SELECT DISTINCT target, string_split(target, '.') AS parts FROM ev WHERE target_kind = 'domain'), n AS (SELECT target, CASE WHEN len(parts) >= 3 THEN parts[-3] ELSE parts[1] END AS label FROM l),
    c AS (SELECT target, label, unnest(string_split(label, '')) AS ch FROM n), f AS (SELECT target, label, ch, count(*) AS k FROM c GROUP BY ALL)
    SELECT target, label, round(-sum((k / length(label)) * log2(k / length(label))), 4) AS entropy FROM f GROUP BY target, label"""
)
def entropy_labels(spark: SparkSession, d: str) -> DataFrame:
    names = events(spark, d).where("target_kind = 'domain'").select("target").distinct()
    label = scores.domain_label(F.col("target"))
    return names.select("target", label.alias("label"), F.round(scores.entropy(label), 4).alias("entropy"))


@query(
    SQL_EVENTS
    + f""", n AS (SELECT *, string_split(CASE WHEN target_kind IN ('domain', 'host') THEN target ELSE coalesce({_J('domain')}, {_J('dns_query')}, {_J('query')}, json_extract_string(fields_json, '$."dns.question.name"'), {_J('host')}) END, '.') AS parts FROM ev),
    l AS (SELECT id, ts, target, CASE WHEN len(parts) >= 3 THEN parts[-3] ELSE parts[1] END AS label FROM n), d AS (SELECT DISTINCT label FROM l WHERE octet_length(encode(label)) >= 8),
    c AS (SELECT label, unnest(string_split(label, '')) AS ch FROM d), f AS (SELECT label, ch, count(*) AS k FROM c GROUP BY ALL), e AS (SELECT label, -sum((k / length(label)) * log2(k / length(label))) AS e FROM f GROUP BY label)
    SELECT id, ts, 'possible generated name: ' || coalesce(target, 'domain') AS title, 'T1568.002' AS technique, round(e, 2) AS dga_score FROM l JOIN e USING (label) WHERE round(e, 2) >= 2.5"""
)
def dga_alerts(spark: SparkSession, d: str) -> DataFrame:
    return enrich.dga_alerts(events(spark, d), threshold=2.5).select("id", "ts", "title", "technique", "dga_score")


FEED = "198.51.100.9\n203.0.113.41 # scanner\n\n# names\ncdn.qixvault.example\nLogin.Lowtide.example\n/health\n10.6.24.34\n"


@query(
    SQL_EVENTS
    + f""", f AS (SELECT unnest(['198.51.100.9', '203.0.113.41', 'cdn.qixvault.example', 'login.lowtide.example', '/health', '10.6.24.34']) AS indicator),
    p AS (SELECT id, unnest([lower(host), lower(actor), lower(target), {", ".join(f"lower({_J(k)})" for k in enrich.INDICATOR_FIELDS)}]) AS indicator, generate_subscripts([{", ".join("1" * 14)}], 1) - 1 AS place FROM (SELECT DISTINCT id, host, actor, target, fields_json FROM ev))
    SELECT id, indicator, CAST(place AS INTEGER) AS place FROM (SELECT p.id, p.indicator, place, row_number() OVER (PARTITION BY p.id ORDER BY place, p.indicator) AS r FROM p JOIN f ON p.indicator = f.indicator) WHERE r = 1"""
)
def ioc_join(spark: SparkSession, d: str) -> DataFrame:
    return enrich.indicator_hits(events(spark, d), enrich.feed(spark, FEED))


@query(
    SQL_UNIQUE
    + """, c AS (SELECT id, ts, unnest([struct_pack(r := 1, p := 3, v := lower(json_extract_string(fields_json, '$."destination.ip"'))), struct_pack(r := 1, p := 4, v := lower(json_extract_string(fields_json, '$."source.ip"'))),
      struct_pack(r := 1, p := 5, v := lower(json_extract_string(fields_json, '$.dst_ip'))), struct_pack(r := 1, p := 6, v := lower(json_extract_string(fields_json, '$.src_ip'))), struct_pack(r := 2, p := 7, v := lower(json_extract_string(fields_json, '$."dns.question.name"'))),
      struct_pack(r := 2, p := 8, v := lower(json_extract_string(fields_json, '$.dns_query'))), struct_pack(r := 2, p := 9, v := CASE WHEN target_kind = 'domain' THEN lower(target) END)]) AS x FROM ue),
    h AS (SELECT id, ts, x.r AS r, x.p AS p, x.v AS indicator FROM c WHERE (x.r = 1 AND x.v IN ('203.0.113.41', '192.0.2.50')) OR (x.r = 2 AND x.v IN ('cdn.qixvault.example', 'login.lowtide.example')))
    SELECT id, ts, indicator, 'T1071' AS technique, 4 AS severity_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, p, indicator) AS n FROM h) WHERE n = 1"""
)
def ioc_alerts(spark: SparkSession, d: str) -> DataFrame:
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "indicator string")
    return enrich.ioc_alerts(unique_events(spark, d), make(["ab" * 32]), make(["203.0.113.41", "192.0.2.50"]), make(["cdn.qixvault.example", "login.lowtide.example"]))


@query(
    SQL_EVENTS
    + ", o AS (SELECT DISTINCT technique FROM ("
    + _rule_union("ev", "id")
    + ") WHERE technique IS NOT NULL), c AS (SELECT unnest(['T1110', 'T1110.003', 'T1552', 'T1059', 'T1547', 'T1071.004', 'T1041', 'T1021']) AS technique) SELECT coalesce(c.technique, o.technique) AS technique, c.technique IS NOT NULL AS is_covered, o.technique IS NOT NULL AS is_observed FROM c FULL JOIN o ON c.technique = o.technique"
)
def attack_coverage(spark: SparkSession, d: str) -> DataFrame:
    covered = spark.createDataFrame([(t,) for t in ["T1110", "T1110.003", "T1552", "T1059", "T1547", "T1071.004", "T1041", "T1021"]], "technique string")
    return store.coverage(covered, rules.match(events(spark, d), RULES))


_ENTITIES = """, en AS (SELECT id, ts, ocsf_class, entity FROM (
      SELECT id, ts, ocsf_class, 'host:' || host AS entity FROM ue UNION SELECT id, ts, ocsf_class, coalesce(actor_kind, 'user') || ':' || actor FROM ue UNION SELECT id, ts, ocsf_class, coalesce(target_kind, 'host') || ':' || target FROM ue) WHERE entity IS NOT NULL)"""


@query(SQL_UNIQUE + _ENTITIES + " SELECT entity, count(*) AS n, count(DISTINCT ocsf_class) AS classes, min(ts) AS first_ts, max(ts) AS last_ts FROM en GROUP BY entity")
def entity_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.entity_events(unique_events(spark, d))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("ocsf_class").alias("classes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    SQL_UNIQUE
    + _ENTITIES
    + " SELECT a, b, entity, gap_us FROM (SELECT lag(id) OVER w AS a, id AS b, entity, ts - lag(ts) OVER w AS gap_us FROM en WINDOW w AS (PARTITION BY entity ORDER BY ts, id)) WHERE gap_us <= 1800000000"
)
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_links(unique_events(spark, d), 30 * cp.MINUTE)


@query(
    SQL_UNIQUE
    + """, k AS (SELECT id, list_filter(['host:' || host, coalesce(actor_kind, 'user') || ':' || actor, coalesce(target_kind, 'host') || ':' || target], lambda x: x IS NOT NULL) AS e FROM ue)
    SELECT src, dst, count(*) AS n FROM (SELECT e[1] AS src, e[2] AS dst FROM k WHERE len(e) > 1 UNION ALL SELECT e[2], e[3] FROM k WHERE len(e) > 2) GROUP BY src, dst"""
)
def provenance_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.provenance_edges(unique_events(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    SQL_UNIQUE.replace("WITH ev", "WITH RECURSIVE ev", 1)
    + """, k AS (SELECT list_filter(['host:' || host, coalesce(actor_kind, 'user') || ':' || actor, coalesce(target_kind, 'host') || ':' || target], lambda x: x IS NOT NULL) AS e FROM ue),
    d AS (SELECT e[1] AS src, e[2] AS dst FROM k WHERE len(e) > 1 UNION SELECT e[2], e[3] FROM k WHERE len(e) > 2), u AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d),
    h(node, hop) AS (SELECT 'host:gw-core-01', 0 UNION SELECT dst, hop + 1 FROM h JOIN u ON node = src WHERE hop < 2)
    SELECT node, min(hop) AS hop FROM h WHERE node != 'host:gw-core-01' GROUP BY node"""
)
def k_hop(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("host:gw-core-01",)], "node string")
    return graph.k_hop(graph.provenance_edges(unique_events(spark, d)), start, 2)


def _sql_vectors(window_us: int) -> str:
    """Events' texts as sparse hashed vectors, and the cosine of every two events within the window that have a word's place in common."""
    return (
        SQL_UNIQUE.replace("WITH ev", "WITH RECURSIVE ev", 1)
        + f""", tx AS (SELECT id, concat_ws(' ', 'class=' || ocsf_class_name, 'actor=' || coalesce(actor_kind, '') || ':' || actor, 'target=' || coalesce(target_kind, '') || ':' || target, 'host=' || host, CASE WHEN message != '' THEN 'msg=' || message END) AS text FROM ue),
    tk AS (SELECT id, unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS t FROM tx), pl AS (SELECT id, ('0x' || substr(sha1(t), 39, 2))::INT % 128 AS p, CASE WHEN ('0x' || substr(sha1(t), 32, 1))::INT % 4 >= 2 THEN -1.0 ELSE 1.0 END AS s FROM tk WHERE t != ''),
    vd AS MATERIALIZED (SELECT id, list(x ORDER BY p) AS v FROM (SELECT id, p, CAST(sum(s) AS DOUBLE) AS x FROM (SELECT id, p, s FROM pl UNION ALL SELECT id, unnest(range(128)), 0.0 FROM ue) GROUP BY id, p) GROUP BY id),
    bk AS MATERIALIZED (SELECT id, ts, ts // {window_us} AS k, v, list_dot_product(v, v) AS n FROM ue JOIN vd USING (id)),
    cs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / sqrt(a.n * b.n) AS sim FROM (SELECT *, unnest([k, k + 1]) AS kk FROM bk) a JOIN bk b ON b.k = a.kk AND b.ts >= a.ts AND b.ts <= a.ts + {window_us} WHERE (a.ts < b.ts OR a.id < b.id) AND a.n > 0 AND b.n > 0)"""
    )


_HALF = 30 * cp.MINUTE
#: Campaigns: sharing pairs and the ten nearest, components by the smallest id that flows along the links, statistics of each.
SQL_CAMPAIGNS = (
    _sql_vectors(_HALF)
    + f""", ks AS (SELECT id, ts, ocsf_class, severity_id, message, list_filter(['host:' || host, coalesce(actor_kind, 'user') || ':' || actor, coalesce(target_kind, 'host') || ':' || target], lambda x: x IS NOT NULL) AS e FROM ue),
    en AS MATERIALIZED (SELECT DISTINCT id, ts, ts // {_HALF} AS bk, unnest(e) AS k FROM ks),
    sh AS (SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT *, unnest([bk, bk + 1]) AS kk FROM en) x JOIN en y ON x.k = y.k AND y.bk = x.kk AND y.ts >= x.ts AND y.ts <= x.ts + {_HALF} WHERE x.ts < y.ts OR x.id < y.id),
    dr AS (SELECT a AS id, b AS o, sim FROM cs WHERE sim >= 0.5 - 1e-9 UNION ALL SELECT b, a, sim FROM cs WHERE sim >= 0.5 - 1e-9), kn AS (SELECT id, o FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, o) AS r FROM dr) WHERE r <= 10),
    lk AS MATERIALIZED (SELECT least(a, b) AS a, greatest(a, b) AS b FROM sh UNION SELECT least(id, o), greatest(id, o) FROM kn), u AS MATERIALIZED (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
    cc(id, c) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, cc.c FROM cc JOIN u ON cc.id = u.a WHERE cc.c < u.b), mb AS (SELECT id, min(c) AS campaign FROM cc GROUP BY id),
    st AS (SELECT campaign, count(*) AS n_events, count(DISTINCT ocsf_class) AS n_classes FROM mb JOIN ks USING (id) GROUP BY campaign),
    li AS (SELECT campaign, count(*) AS n_links, avg(coalesce(sim, 0)) AS sim FROM lk JOIN mb ON mb.id = lk.a LEFT JOIN (SELECT least(a, b) AS a, greatest(a, b) AS b, sim FROM cs) s ON s.a = lk.a AND s.b = lk.b GROUP BY campaign),
    rt AS (SELECT campaign, n_events, CAST(n_classes AS INTEGER) AS n_classes, n_links, round(n_classes + (n_events - 1) * 0.5 + greatest(sim, 0), 6) AS score FROM st JOIN li USING (campaign) WHERE n_classes >= 2)"""
)


def _campaigns(spark: SparkSession, d: str):
    e = Stages(spark, "events").cut(unique_events(spark, d), "unique")
    similar = cp.nearest_links(cp.embedded(e), 30 * cp.MINUTE)
    return e, *cp.campaigns(e, 30 * cp.MINUTE, similar=similar)


@query(SQL_CAMPAIGNS + " SELECT * FROM rt")
def campaigns(spark: SparkSession, d: str) -> DataFrame:
    return cp.by_score(_campaigns(spark, d)[1])


@query(SQL_CAMPAIGNS + " SELECT campaign, score, CAST(row_number() OVER (ORDER BY score DESC, campaign) AS INTEGER) AS place FROM rt ORDER BY score DESC, campaign LIMIT 20")
def campaigns_by_score(spark: SparkSession, d: str) -> DataFrame:
    best = cp.by_score(_campaigns(spark, d)[1]).limit(20)
    return best.select("campaign", "score", F.row_number().over(Window.orderBy(F.desc("score"), "campaign")).alias("place"))  # of twenty rows


_ANOMALY = "least(1.0, CASE severity_id WHEN 6 THEN 0.9 WHEN 5 THEN 0.9 WHEN 4 THEN 0.75 WHEN 3 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END" + "".join(f" + CASE WHEN lower(message) LIKE '%{w}%' THEN 0.1 ELSE 0 END" for w in scores.ANOMALY_WORDS) + ")"


@query(
    SQL_CAMPAIGNS
    + f""", ce AS (SELECT mb.campaign, en.k, en.id, en.ts, ks.e, {_ANOMALY} AS an FROM en JOIN mb USING (id) JOIN rt ON rt.campaign = mb.campaign JOIN ks ON ks.id = en.id),
    sp2 AS (SELECT campaign, id AS dst, an, e, lag(id) OVER w AS src, lag(e) OVER w AS pe, ts - lag(ts) OVER w AS delta_us FROM ce WINDOW w AS (PARTITION BY campaign, k ORDER BY ts, id)),
    sg AS (SELECT DISTINCT campaign, src, dst, delta_us, an, array_to_string(list_filter(pe, lambda x: list_contains(e, x)), ', ') AS shared FROM sp2 WHERE delta_us <= {_HALF})
    SELECT campaign, src, dst, delta_us, round(least(1.0, 0.45 + 0.25 * (1 / (1 + delta_us / 1e6 / 60)) + 0.30 * an), 6) AS score, shared,
      'shares ' || shared || '; Δt=' || CASE WHEN delta_us / 1e6 < 90 THEN CAST(CAST(round(delta_us / 1e6) AS BIGINT) AS VARCHAR) || 's' ELSE printf('%.1fmin', round(delta_us / 1e6 / 60, 1)) END AS reason FROM sg"""
)
def causal_edges(spark: SparkSession, d: str) -> DataFrame:
    e, _, members = _campaigns(spark, d)
    return cp.causal_edges(members, e)


def _incidents(spark: SparkSession, d: str, selector: str) -> DataFrame:
    e, _, members = _campaigns(spark, d)
    edges = Stages(spark, "causal").cut(cp.causal_edges(members, e), "edges")
    return cp.incidents(cp.chains(members, e, edges, selector), e, edges, rules.techniques(e, RULES))


@query()
def incidents(spark: SparkSession, d: str) -> DataFrame:
    return _incidents(spark, d, "beam")


@query()
def incidents_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _incidents(spark, d, "greedy")


@query(_sql_vectors(6 * 60 * cp.MINUTE) + " SELECT a, b, round(sim, 6) AS sim FROM cs WHERE sim >= 0.5 - 1e-9")
def semantic_links(spark: SparkSession, d: str) -> DataFrame:
    return cp.semantic_links(cp.embedded(unique_events(spark, d)), 6 * 60 * cp.MINUTE).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    SQL_UNIQUE
    + """ SELECT id, coalesce(actor, host, '') AS subject, CASE ocsf_class WHEN 3002 THEN 'authenticate' WHEN 1007 THEN 'execute' WHEN 1001 THEN 'access' WHEN 4001 THEN 'connect' WHEN 4002 THEN 'request' WHEN 6003 THEN 'invoke' WHEN 4003 THEN 'resolve'
      WHEN 1005 THEN 'load' WHEN 1006 THEN 'schedule' WHEN 201002 THEN 'registry' ELSE 'event' END AS action, coalesce(target, '') AS object FROM ue"""
)
def triplets(spark: SparkSession, d: str) -> DataFrame:
    return cp.triplets(unique_events(spark, d)).select("id", F.coalesce("subject", F.lit("")).alias("subject"), "action", F.coalesce("object", F.lit("")).alias("object"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
    s AS (SELECT q.vec_id AS id, v.vec_id AS other, round(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM q, v WHERE q.vec_id != v.vec_id)
    SELECT id, other, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other) AS rank FROM s) WHERE rank <= 10"""
)
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vectors.exact_topk(v.where("vec_id % 20 = 0"), v, 10)


@query(
    SQL_UNIQUE
    + """, w AS (SELECT id, string_split(lower(message), ' ') AS ts FROM ue), t AS (SELECT id, unnest(ts) AS t FROM w), p AS (SELECT id, ('0x' || substr(sha1(t), 39, 2))::INT % 128 AS p, CASE WHEN ('0x' || substr(sha1(t), 32, 1))::INT % 4 >= 2 THEN -1.0 ELSE 1.0 END AS s FROM t WHERE t != ''),
    v AS (SELECT id, p, sum(s) AS x FROM p GROUP BY id, p), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM v GROUP BY id)
    SELECT v.id, round(max(CASE WHEN p = 0 THEN x / n END), 6) AS first, round(sum(abs(x)) / max(n), 6) AS l1 FROM v JOIN n USING (id) WHERE n > 0 GROUP BY v.id HAVING max(CASE WHEN p = 0 THEN x / n END) IS NOT NULL AND max(CASE WHEN p = 0 THEN x / n END) != 0"""
)
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    v = unique_events(spark, d).select("id", scores.hash_embed(F.col("message")).alias("v"))
    l1 = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    return v.select("id", F.round(F.col("v")[0], 6).alias("first"), F.round(l1, 6).alias("l1")).where("first != 0")


@query()
def template_mining(spark: SparkSession, d: str) -> DataFrame:
    return templates.mine_table(events(spark, d))[1]


@query(
    """WITH c AS (SELECT ocsf_class_name AS a, severity AS b, count(*) AS n FROM segment_events GROUP BY ALL), r AS (SELECT sum(n) AS n FROM c GROUP BY a), k AS (SELECT sum(n) AS n FROM c GROUP BY b),
    t AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS i, (SELECT sum(n * (n - 1) / 2.0) FROM r) AS l, (SELECT sum(n * (n - 1) / 2.0) FROM k) AS m, (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS N,
      (SELECT sum(n * ln(n)) FROM c) AS hab, (SELECT sum(n * ln(n)) FROM r) AS ha, (SELECT sum(n * ln(n)) FROM k) AS hb)
    SELECT round((i - l * m / (N * (N - 1) / 2)) / ((l + m) / 2 - l * m / (N * (N - 1) / 2)), 6) AS ari, round((ln(N) + (hab - ha - hb) / N) / sqrt((ln(N) - ha / N) * (ln(N) - hb / N)), 6) AS nmi FROM t"""
)
def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evals.cluster_metrics(events(spark, d), "ocsf_class_name", "severity")


@query(
    """SELECT CAST(sum(CAST(p AND t AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(p AND NOT t AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(NOT p AND t AS INT)) AS BIGINT) AS fn,
    round(sum(CAST(p AND t AS INT)) / sum(CAST(p AS INT)), 6) AS precision, round(sum(CAST(p AND t AS INT)) / sum(CAST(t AS INT)), 6) AS recall,
    round(2.0 * sum(CAST(p AND t AS INT)) / (sum(CAST(p AS INT)) + sum(CAST(t AS INT))), 6) AS f1 FROM (SELECT lower(message) LIKE '%refused%' AS p, severity_id >= 3 AS t FROM segment_events)"""
)
def detection_scores(spark: SparkSession, d: str) -> DataFrame:
    flags = events(spark, d).select(F.lower("message").contains("refused").alias("p"), (F.col("severity_id") >= 3).alias("t"))
    return evals.precision_recall(flags, "p", "t")


@query(SQL_UNIQUE + " SELECT rule_id, id, ts, 'open' AS status FROM (" + _rule_union("ue", "id, ts") + ")")
def alert_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping batches of alerts; each alert is stored once."""
    found = rules.match(unique_events(spark, d), RULES)
    kept = store.AlertStore(spark, scratch(spark, "alerts"))
    kept.upsert(found.where("severity_id >= 3"))
    kept.upsert(found)
    return kept.table.read().select("rule_id", F.col("events")[0].alias("id"), "ts", "status")


@query(
    SQL_EVENTS
    + """, h AS (SELECT median(ts) AS m FROM ev), a AS (SELECT DISTINCT host, actor FROM ev, h WHERE ts < m AND actor_kind = 'process' AND host IS NOT NULL), b AS (SELECT DISTINCT host, actor FROM ev, h WHERE ts >= m AND actor_kind = 'process' AND host IS NOT NULL)
    SELECT 'added' AS change, * FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'removed', * FROM (FROM a EXCEPT FROM b)"""
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    m = e.agg(F.median("ts")).first()[0]
    seen = e.where("actor_kind = 'process' and host is not null")
    return store.snapshot_changes(seen.where(F.col("ts") < m).select("host", "actor").distinct(), seen.where(F.col("ts") >= m).select("host", "actor").distinct(), ["host", "actor"])


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/segment_events.parquet"
    return pipeline.event_stream(spark, path if os.path.isdir(path.removeprefix("file:")) or "://" in path else path.replace(".parquet", ".parque[t]"))


@query(SQL_EVENTS + " SELECT (ts // 21600000000) * 21600000000 AS bucket, count(*) AS n FROM ev GROUP BY 1")
def stream_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.histogram(_stream(spark, d), 21_600_000_000, scratch(spark, "hist"))


@query(SQL_EVENTS + " SELECT rule_id, id, ts FROM (" + _rule_union("ev", "id, ts") + ")")
def stream_rule_alerts(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.alerts(_stream(spark, d), RULES, scratch(spark, "found")).select("rule_id", F.col("events")[0].alias("id"), "ts")


@query(
    SQL_EVENTS
    + """, g AS (SELECT host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY host ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS new FROM ev WHERE host IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
    SELECT host, min(ts) AS start_us, max(ts) AS end_us, count(*) AS n FROM s GROUP BY host, nth"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.session_windows(_stream(spark, d).where("host is not null"), 30 * cp.MINUTE, scratch(spark, "windows"))


@query(
    SQL_UNIQUE
    + """, h AS (SELECT tenant, ts // 3600000000 * 3600000000 AS hour_us, ingest_ts AS a FROM ue)
    SELECT tenant, hour_us, count(*) FILTER (WHERE a < hour_us + 3600000000) AS n_first, count(*) FILTER (WHERE a < hour_us + 25200000000) AS n_final,
      count(*) FILTER (WHERE a >= hour_us + 25200000000) AS n_refused, count(*) FILTER (WHERE a >= hour_us + 3600000000) AS n_late FROM h GROUP BY tenant, hour_us"""
)
def stream_late_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).select("id", "tenant", F.col("ts").alias("ts_us"), F.col("ingest_ts").alias("arrival"))
    return pipeline.late_windows(s, scratch(spark, "latestream")).counts()
