"""Enrichment: redaction, entropy labels, threat intelligence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.scores import domain_label, entropy

# What is redacted and by what, in this order, and the fields that may hold indicators.
REDACTIONS = [
    (r"[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "***@$1"),
    (r"AKIA[0-9A-Z]{16}", "AKIA****************"),
    (r"(?i)(password|passwd|secret|token|api[_-]?key)(\s*[:=]\s*)\S+", "$1$2***"),
]
INDICATOR_FIELDS = ["src_ip", "dst_ip", "ip", "domain", "dns_query", "query", "url", "hash", "md5", "sha1", "sha256"]
ENTROPY_THRESHOLD, ENTROPY_LEAST_BYTES = 3.5, 8


def redact(text: Column) -> Column:
    out = reduce(lambda c, p: F.regexp_replace(c, *p), REDACTIONS, text)
    return F.replace(F.replace(out, F.lit("https://"), F.lit("hxxps://")), F.lit("http://"), F.lit("hxxp://"))


def redact_events(events: DataFrame) -> DataFrame:
    """Message and every string field redacted."""
    fields = F.transform_values(F.from_json("fields_json", "map<string,string>"), lambda _, v: redact(v))
    return events.withColumns({"message": redact(F.col("message")), "fields_json": F.to_json(fields)})


def with_entropy(events: DataFrame) -> DataFrame:
    """Adds ``entropy`` and ``dga_score`` (two decimals) of the name an event points at, and ``suspect``."""
    f = F.from_json("fields_json", "map<string,string>")
    name = F.when(F.col("target_kind").isin("domain", "host"), F.col("target")).otherwise(F.coalesce(*[F.try_element_at(f, F.lit(k)) for k in ("domain", "dns_query", "query", "dns.question.name", "host")]))
    e = events.withColumn("_label", domain_label(name)).withColumn("_e", F.when(F.octet_length("_label") >= ENTROPY_LEAST_BYTES, entropy(F.col("_label"))))
    return e.withColumns({"dns_label": F.col("_label"), "entropy": F.round("_e", 2), "dga_score": F.round("_e", 2), "suspect": F.coalesce(F.col("_e") >= ENTROPY_THRESHOLD, F.lit(False))}).drop("_label", "_e")


def feed(spark: SparkSession, text: str) -> DataFrame:
    """An indicator feed: one per line, ``#`` comments, any case."""
    rows = sorted({line.split("#")[0].strip().lower() for line in text.splitlines()} - {""})
    return spark.createDataFrame([(r,) for r in rows], "indicator string")


def indicator_hits(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """``(id, indicator, place)``: the first indicator of each event in the order host, actor, target, fields.

    The feed is joined as a table; Spark broadcasts it only if its size is below the session's
    threshold, so a feed of any length works.
    """
    f = F.from_json("fields_json", "map<string,string>")
    places = [F.col("host"), F.col("actor"), F.col("target"), *[F.try_element_at(f, F.lit(k)) for k in INDICATOR_FIELDS]]
    values = F.array(*[F.lower(p) for p in places])
    cand = events.select("id", F.posexplode(values).alias("place", "indicator")).where(F.col("indicator").isNotNull())
    return cand.join(indicators.select("indicator"), "indicator").groupBy("id").agg(F.min(F.struct("place", "indicator")).alias("m")).select("id", "m.indicator", "m.place")


HASH_FIELDS, IP_FIELDS, DOMAIN_FIELDS = ["process.hash.sha256", "file.hash.sha256", "module.hash.sha256"], ["destination.ip", "source.ip", "dst_ip", "src_ip"], ["dns.question.name", "dns_query"]


def ioc_alerts(events: DataFrame, hashes: DataFrame, ips: DataFrame, domains: DataFrame) -> DataFrame:
    """One alert per event: a known hash before an address before a domain. Both sides are lower case."""
    f = F.from_json("fields_json", "map<string,string>")
    get = lambda names: [F.lower(F.try_element_at(f, F.lit(n))) for n in names]
    ranked = [*[(0, c) for c in get(HASH_FIELDS)], *[(1, c) for c in get(IP_FIELDS)], *[(2, c) for c in get(DOMAIN_FIELDS)], (2, F.when(F.col("target_kind") == "domain", F.lower("target")))]
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r).alias("rank"), c.alias("indicator")) for i, (r, c) in enumerate(ranked)])
    known = reduce(DataFrame.unionByName, [d.select(F.lower("indicator").alias("indicator"), F.lit(i).alias("rank")).distinct() for i, d in enumerate((hashes, ips, domains))])
    hits = events.select("id", "ts", F.explode(cells).alias("c")).select("id", "ts", "c.*").where(F.col("indicator").isNotNull()).join(known, ["indicator", "rank"])
    best = hits.groupBy("id", "ts").agg(F.min(F.struct("rank", "place", "indicator")).alias("m"))
    return best.select("id", "ts", "m.indicator", F.when(F.col("m.rank") == 0, "T1204").otherwise("T1071").alias("technique"), F.lit(4).alias("severity_id"))


def dga_alerts(events: DataFrame, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """Alerts for names whose rounded score reaches the threshold."""
    hit = with_entropy(events).where(F.col("dga_score") >= threshold)
    return hit.select("id", "ts", F.concat(F.lit("possible generated name: "), F.coalesce("target", F.lit("domain"))).alias("title"), F.lit("T1568.002").alias("technique"), F.lit(3).alias("severity_id"), "dga_score")
