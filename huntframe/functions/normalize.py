"""Records to events: message, host, severity, class, actor and target, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.schema import EVENT, class_name, severity_name

# The field names that stand for each part, in order of precedence.
MESSAGE = ["message", "msg", "event.original"]
HOST = ["host", "hostname", "host.name", "host_name"]
AUTH_KEYS, AUTH_WORDS = ["user", "username", "user.name", "auth", "logon_type"], ["authentication", "failed password", "login", "logon", "sshd"]
USER, AUTH_SOURCE = ["user", "username", "user.name", "user_name"], ["src_ip", "source.ip", "src", "client_ip"]
HTTP_KEYS, URL = ["http_method", "method", "url", "uri", "http.request.method", "status_code"], ["url", "uri", "url.full"]
NET_KEYS = ["src_ip", "dst_ip", "source.ip", "destination.ip", "dest_ip", "dst_port"]
NET_SOURCE, NET_TARGET = ["src_ip", "source.ip", "src"], ["dst_ip", "destination.ip", "dest_ip", "dst"]
PROCESS_KEYS, PROCESS = ["process", "process.name", "cmd", "command_line", "exe", "image"], ["process", "process.name", "exe", "image"]
API_KEYS, APP = ["eventName", "methodName", "protoPayload", "eventSource"], ["app", "appname", "tag"]


def first(fields: Column, names: list[str]) -> Column:
    """The first non-empty value of these fields."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names])


def has(fields: Column, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(fields), F.array(*[F.lit(n) for n in names])), F.lit(False))


def user_in(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"(?i:for) (?:invalid user )?(\S+)", 1), F.lit(""))


def normalize(records: DataFrame, fields: str = "fields") -> DataFrame:
    """Adds the event columns to records that carry a field map."""
    f = F.col(fields)
    message = F.coalesce(first(f, MESSAGE), F.lit(""))
    low = F.lower(message)
    syslog = F.try_element_at(f, F.lit("syslog_severity")).try_cast("int")
    severity = (
        F.when(syslog <= 2, 5).when(syslog == 3, 4).when(syslog == 4, 3).when(syslog == 5, 2).when(syslog.isNotNull(), 1).when(low.contains("failed") | low.contains("error") | low.contains("denied"), 3).otherwise(1)
    )
    auth = has(f, AUTH_KEYS)
    for w in AUTH_WORDS:
        auth = auth | low.contains(w)
    app = first(f, APP)
    kind = F.when(auth, 3002).when(has(f, HTTP_KEYS), 4002).when(has(f, NET_KEYS), 4001).when(has(f, PROCESS_KEYS), 1007).when(has(f, API_KEYS), 6003).when(app.isNotNull(), -1007).otherwise(1008)
    r = records.withColumns({"message": message, "host": first(f, HOST), "severity_id": severity, "_kind": kind})
    k = F.col("_kind")
    actor = F.when(k == 3002, F.coalesce(first(f, USER), user_in(F.col("message")))).when(k == 4001, first(f, NET_SOURCE)).when(k == 1007, first(f, PROCESS)).when(k == -1007, app)
    target = F.when(k == 3002, first(f, AUTH_SOURCE)).when(k == 4002, first(f, URL)).when(k == 4001, first(f, NET_TARGET))
    r = r.withColumns({"ocsf_class": F.abs(k).cast("int"), "actor": actor, "target": target, "severity": severity_name(F.col("severity_id"))})
    return r.withColumns(
        {
            "actor_kind": F.when(F.col("actor").isNotNull(), F.when(k == 3002, "user").when(k == 4001, "ip").otherwise("process")),
            "target_kind": F.when(F.col("target").isNotNull(), F.when(k == 4002, "url").otherwise("ip")),
            "ocsf_class_name": class_name(F.col("ocsf_class")),
            "fields_json": F.to_json(f),
        }
    ).drop("_kind")


def to_events(records: DataFrame, id_: Column, ts: Column, ingest_ts: Column, tenant: Column) -> DataFrame:
    """Records as rows of the stored event schema."""
    r = normalize(records).withColumns({"id": id_, "ts": ts, "ingest_ts": ingest_ts, "tenant": tenant})
    return r.select(*[F.col(c.name).cast(c.dataType) for c in EVENT])


# Endpoint telemetry: class by kind of event.
EDR_CLASSES = {
    "process_start": 1007, "process_stop": 1007, "file_create": 1001, "file_modify": 1001, "file_delete": 1001, "network_connect": 4001,
    "dns_query": 4003, "module_load": 1005, "registry_set": 201002, "persistence_add": 1006,
}


def from_telemetry(rows: DataFrame) -> DataFrame:
    """Structured endpoint telemetry as events: the process is the actor, the target goes by kind."""
    from huntframe.schema import lookup

    c = F.col
    flat = {f"{p}.{n}": c(f"{p}.{n}") for p, ns in (("process", ["pid", "ppid", "name", "path", "cmdline", "hash_sha256", "user"]), ("parent", ["pid", "name", "path", "cmdline"]), ("file", ["path", "hash_sha256", "size", "mode"]), ("network", ["proto", "local_addr", "local_port", "remote_addr", "remote_port", "direction"]), ("dns", ["query", "qtype"]), ("module", ["path", "hash_sha256"]), ("registry", ["key", "value_name", "value_data"]), ("persistence", ["kind", "name", "target"])) for n in ns}
    names = {"process.hash_sha256": "process.hash.sha256", "file.hash_sha256": "file.hash.sha256", "module.hash_sha256": "module.hash.sha256", "network.remote_addr": "destination.ip", "network.local_addr": "source.ip", "dns.query": "dns.question.name"}
    entries = F.array(*[F.struct(F.lit(names.get(k, k)).alias("key"), v.cast("string").alias("value")) for k, v in flat.items()])
    held = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].isin("", "0")))
    extra = F.coalesce(c("extra"), F.expr("cast(map() as map<string,string>)"))
    fields = F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(extra, k)), extra)
    kind = c("kind")
    target = F.when(kind.startswith("file"), c("file.path")).when(kind.startswith("network"), c("network.remote_addr")).when(kind.startswith("dns"), c("dns.query")).when(kind.startswith("module"), c("module.path")).when(kind.startswith("registry"), c("registry.key")).when(kind.startswith("persistence"), c("persistence.target"))
    target_kind = F.when(kind.startswith("file"), "file").when(kind.startswith("network"), "ip").when(kind.startswith("dns"), "domain").when(kind.startswith("module"), "module").when(kind.startswith("registry"), "registry").when(kind.startswith("persistence"), "job")
    uid = lookup(EDR_CLASSES, kind, F.lit(1008))
    return rows.select(
        "id", c("ts").cast("bigint").alias("ts"), c("ts").cast("bigint").alias("ingest_ts"), uid.alias("ocsf_class"), class_name(uid).alias("ocsf_class_name"), F.lit("informational").alias("severity"), F.lit(1).alias("severity_id"),
        F.lit("default").alias("tenant"), c("host"), F.coalesce(c("process.name"), c("user")).alias("actor"), F.when(c("process.name").isNotNull(), "process").when(c("user").isNotNull(), "user").alias("actor_kind"),
        target.alias("target"), F.when(target.isNotNull(), target_kind).alias("target_kind"), F.concat_ws(" ", kind, F.coalesce(c("process.cmdline"), c("process.name")), target).alias("message"), F.to_json(fields).alias("fields_json"),
    )
