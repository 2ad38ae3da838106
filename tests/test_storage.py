"""Versioned tables, segments, alerts, sinks, plugins, streams."""

import json

import pytest
from pyspark.sql import functions as F

from huntframe.operators import correlation, rules
from huntframe.plans import plugins
from huntframe.schema import EVENT
from huntframe.session import scratch
from huntframe.sources import alerts as al
from huntframe.sources import sinks, tail
from huntframe.sources.segments import SegmentStore
from huntframe.sources.versioned import Conflict, VersionedTable
from huntframe.streaming import pipeline
from huntframe.types import schema


def events(spark, stamps, host="h", message="failed x"):
    rows = [(f"e{t}", t, t, 3002, "authentication", "high", 4, "t", host, "ann", "user", None, None, message, "{}") for t in stamps]
    return spark.createDataFrame(rows, EVENT)


def test_versions(spark):
    t = VersionedTable(spark, scratch(spark, "v"), schema("a bigint"))
    assert t.version() == 0 and t.read().count() == 0
    one = spark.range(3).withColumnRenamed("id", "a")
    t.append(one)
    t.append(one)
    assert t.read().count() == 6 and t.read(lambda p: p["path"] == t.parts()[0]["path"]).count() == 3 and t.read(version=1).count() == 3
    t.replace(lambda rows: rows.limit(1))
    assert t.read().count() == 1 and t.read(version=2).count() == 6
    with pytest.raises(Conflict):
        t.commit([], [], base=1)  # version 2 exists already: nobody overwrites it
    assert t.version() == 3


def test_two_writers_lose_nothing(spark):
    path = scratch(spark, "w")
    ours, theirs = (VersionedTable(spark, path, schema("a bigint, n bigint")) for _ in range(2))
    ours.append(spark.createDataFrame([(1, 0)], "a bigint, n bigint"))
    raced = []

    def add_one(rows):
        if not raced:  # another writer rewrites the same row between our reading and our commit
            raced.append(theirs.replace(lambda r: r.withColumn("n", F.col("n") + 1)))
        return rows.withColumn("n", F.col("n") + 1)

    ours.replace(add_one)
    assert [tuple(r) for r in ours.read().collect()] == [(1, 2)] and ours.version() == 3


def test_numbered_batches_count_once(spark):
    t = VersionedTable(spark, scratch(spark, "n"), schema("a bigint"))
    one = spark.range(3).withColumnRenamed("id", "a")
    for n in (0, 0, 1, 0, 1):
        t.append(one, ("s", n))
    t.append(one, ("other", 0))
    assert t.read().count() == 9 and t.taken("s") == 1 and t.taken("none") == -1


def test_vacuum_keeps_what_versions_name(spark):
    t = VersionedTable(spark, scratch(spark, "vac"), schema("a bigint"))
    for n in range(6):
        t.replace(lambda rows: spark.range(n + 1).withColumnRenamed("id", "a"))
    staged = t.stage(spark.range(1).withColumnRenamed("id", "a"))  # another writer's, not committed yet
    assert t.vacuum(keep=2) == 4 and t.versions() == [5, 6] and t.read(version=5).count() == 5 and t.read().count() == 6
    t.transact(lambda _: (staged, []))
    assert t.read().count() == 7
    t.stage(spark.range(1).withColumnRenamed("id", "a"))
    assert t.vacuum(keep=3, orphan_s=-1) == 1 and t.read().count() == 7


def test_segments_and_alerts_of_a_repeated_batch(spark, monkeypatch):
    from huntframe.plans import live

    frames = spark.createDataFrame([(f"f{i}", "<34>Oct 11 22:14:15 h sshd[9]: Failed password for bob", "syslog", 10 + i) for i in range(3)], "id string, raw string, codec string, recv_us bigint")
    s, a = SegmentStore(spark, scratch(spark, "s")), al.AlertStore(spark, scratch(spark, "a"))
    rule = rules.Rule("Failed", {"s": ["failed"], "condition": "s"}, id="f")
    real, fail = VersionedTable.commit, [1, 0, 1]  # the segments' commit is lost, then that of the alerts after the segments were stored

    def commit(self, *args, **kw):
        if fail and fail.pop(0):
            raise OSError("lost before the commit")
        return real(self, *args, **kw)

    monkeypatch.setattr(VersionedTable, "commit", commit)
    for lost in (True, True, False, False):
        try:
            live.ingest_batch(frames, s, a, [rule], number=7)
            assert not lost
        except OSError:
            assert lost
    assert s.total_rows() == 3 and s.read().count() == 3 and a.table.read().count() == 3


def test_upserts_touch_only_their_parts(spark):
    u = pipeline.Upserts(spark, scratch(spark, "u"), "k bigint, n bigint", ["k"])
    make = lambda *k: spark.createDataFrame([(x, 1) for x in k], "k bigint, n bigint")
    u.add(make(*range(100)), 0)
    before = {p["path"] for p in u.table.parts()}
    u.add(make(5), 1)
    u.add(make(5), 1)
    assert len(before - {p["path"] for p in u.table.parts()}) == 1
    assert dict(map(tuple, u.read().where("n > 1").collect())) == {5: 2} and u.read().count() == 100


def test_ring_of_newest_alerts(spark):
    s = al.AlertStore(spark, scratch(spark, "ring"))
    s.upsert(spark.createDataFrame([("r", "t", 3, None, [f"e{i}"], i) for i in range(10)], "rule_id string, title string, severity_id int, technique string, events array<string>, ts bigint"))
    s.keep_newest(4)
    assert sorted(r.ts for r in s.table.read().collect()) == [6, 7, 8, 9]


def test_stages_and_cleanup(spark, monkeypatch):
    from huntframe import session

    monkeypatch.setattr(session, "_scratch", [])
    s = session.Stages(spark, "st")
    a = s.cut(spark.range(3), "a")
    first = s.paths["a"]
    b = s.cut(a.where("id > 0"), "a")
    fs, p = session._fs(spark, first)
    assert b.count() == 2 and not fs.exists(p)
    assert session.cleanup(spark) == 1 and session._scratch == []
    assert not fs.exists(session._fs(spark, s.root)[1])


def test_segments(spark):
    s = SegmentStore(spark, scratch(spark, "seg"))
    s.append(events(spark, [100, 200]))
    s.append(events(spark, [5000]))
    assert s.append(events(spark, [])) == 2 and s.total_rows() == 3
    assert [r.ts for r in s.read_range(150, 300).collect()] == [200] and s.read_range(200, 200).count() == 1
    assert s.migrate(5100, 4900) == 0 and s.migrate(5101, 4900) == 1 and s.tier_counts() == {"warm": 1, "cold": 1}
    assert s.read(("warm",)).count() == 1 and s.read().count() == 3
    assert s.expire(5101, 4901) == 0 and s.expire(5102, 4901) == 1 and s.read().count() == 1


def test_alert_store(spark):
    ddl = "rule_id string, title string, severity_id int, technique string, events array<string>, ts bigint"
    a = spark.createDataFrame([("r", "t", 3, "T1", ["e1"], 10), ("r", "t", 3, "T1", ["e1"], 10), ("q", "u", 4, None, ["e2"], 20)], ddl)
    s = al.AlertStore(spark, scratch(spark, "al"))
    s.upsert(a.limit(1))
    fp = s.table.read().first().fingerprint
    s.triage(spark.createDataFrame([(fp, "closed", None, "done", 5)], "fingerprint string, status string, assignee string, note string, updated_ts bigint"))
    s.upsert(a)
    assert {(r.rule_id, r.status, r.note) for r in s.table.read().collect()} == {("r", "closed", "done"), ("q", "open", None)}
    assert [r.rule_id for r in s.recent(1).collect()] == ["q"] and s.recent(technique="T1").count() == 1 and s.recent(status="closed").count() == 1
    o = al.SavedObjects(spark, scratch(spark, "so"))
    o.put(spark.createDataFrame([("search", "1", "n", "me", 1, "a"), ("search", "1", "n", "me", 2, "b"), ("search", "2", "n", "me", 1, "a"), ("search", "2", "n", "me", 3, None)], al.SAVED))
    assert [(r.id, r.body) for r in o.latest().collect()] == [("1", "b")]
    c = al.coverage(spark.createDataFrame([("T1",), ("T2",)], "technique string"), a)
    assert {tuple(r) for r in c.collect()} == {("T1", True, True), ("T2", True, False)}
    x, y = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in al.snapshot_changes(x, y, ["k"]).collect()} == {("added", 3), ("removed", 1)}


def test_sinks(spark, tmp_path):
    ddl = "rule_id string, title string, severity_id int, technique string, events array<string>, ts bigint"
    a = spark.createDataFrame([("r", "Title", 4, "T1", ["e1"], 10), ("r", "Later", 4, None, ["e2"], 20)], ddl)
    sinks.write_json_lines(a, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    first = sinks.first_per_rule(a)
    assert [r.title for r in first.collect()] == ["Title"]
    load = lambda c: json.loads(first.select(c).first()[0])
    assert load(sinks.chat_payload()) == {"text": "[HIGH] Title (T1)"} and load(sinks.ticket_payload("P"))["fields"]["project"] == {"key": "P"}
    pager = load(sinks.pager_payload("k"))
    assert pager["dedup_key"] == "r" and pager["payload"]["severity"] == "error" and load(sinks.intelligence_payload())["Event"]["Attribute"][0]["value"] == "e1"
    to = str(tmp_path / "sent")
    sinks.deliver(a, sinks.chat_payload(), lambda p: open(to, "a").write(p + "\n"))
    assert len(open(to).readlines()) == 2


def test_plugins(spark, caplog):
    r = plugins.builtin()
    df = spark.createDataFrame([("1", "password: x", '{"a": "1", "b": "2"}', None, None)], "id string, message string, fields_json string, target string, target_kind string")
    assert r.apply(["redact", "nothing"], df).first().message == "password: ***" and "nothing" in caplog.text
    with pytest.raises(plugins.CapabilityError):
        r.register(plugins.Manifest("net", "processor", ("net:egress",)), lambda d: d)
    with pytest.raises(plugins.CapabilityError):
        r.register(plugins.Manifest("d", "detector", ("read:field:a",)), lambda d: d)
    r.register(plugins.Manifest("one", "processor", ("read:field:a",)), lambda d: d)
    assert json.loads(r.apply(["one"], df).first().fields_json) == {"a": "1"}
    e = spark.createDataFrame([("a",), ("b",)], "input_id string")
    pipes = [{"inputs": ["a"], "route": ["rules"]}]
    assert plugins.routed(e, pipes, "rules").count() == 1 and plugins.routed(e, pipes, "index").count() == 2 and plugins.routed(e, pipes, "other").count() == 0


def test_plugins_of_every_kind_run(spark):
    from huntframe.functions import models
    from huntframe.operators import campaigns as cp

    r = plugins.Registry({"detector": ["read:field:*"], "storage": [], "correlator": []})
    kept = []
    r.register(plugins.Manifest("loud", "detector", ("read:field:a",)), lambda e: e.where(F.col("fields_json").contains("x")).select("id", "ts", F.lit("Loud").alias("title"), F.lit(4).alias("severity_id")))
    r.register(plugins.Manifest("twice", "correlator"), lambda alerts, e: alerts.withColumn("rule_id", F.concat("rule_id", F.lit("-again"))))
    r.register(plugins.Manifest("list", "storage"), lambda e: kept.extend(row.id for row in e.collect()))
    r.register(plugins.Manifest("last", "selector"), lambda anomaly, out: ([len(anomaly) - 1], 1.0))
    r.register(plugins.Manifest("ones", "embedder"), lambda texts: [[1.0, 0.0]] * len(texts))
    df = events(spark, [1, 2]).withColumn("fields_json", F.when(F.col("ts") == 1, '{"a": "x"}').otherwise('{"a": "y", "b": "x"}'))
    found = r.detect(["loud"], df)
    assert [(a.rule_id, a.events, a.title) for a in found.collect()] == [("loud", ["e1"], "Loud")]
    assert sorted(a.rule_id for a in r.correlate(["twice"], found, df).collect()) == ["loud", "loud-again"]
    r.keep(["list"], df)
    assert sorted(kept) == ["e1", "e2"]
    members = df.select(F.lit("c").alias("campaign"), "id")
    assert [c.id for c in cp.chains(members, df, cp.causal_edges(members, df), r.selector("last")).collect()] == ["e2"]
    with pytest.raises(ValueError):
        r.selector("loud")
    vec = df.select(models.embed(F.col("message"), r.model("ones", "embedder"), 2).alias("v"), models.embed(F.col("message"), lambda t: 1 / 0).alias("h"), models.score([F.col("ts")], lambda x: x[:, 0] / 2).alias("s"), models.score([F.col("ts")], "no.such:model", 0.5).alias("d")).collect()
    assert [v.v for v in vec] == [[1.0, 0.0]] * 2 and len(vec[0].h) == 128 and abs(sum(x * x for x in vec[0].h) - 1) < 1e-9
    assert sorted(v.s for v in vec) == [0.5, 1.0] and {v.d for v in vec} == {0.5}


def test_agents_durable_and_live(spark):
    from huntframe.sources.registry import AGENT, AgentRegistry

    r = AgentRegistry(spark, scratch(spark, "agents"))
    r.enrol(spark.createDataFrame([("a", "h1", 10, 10), ("b", "h2", 20, 20), (None, "x", 1, 1)], AGENT))
    r.enrol(spark.createDataFrame([("a", "h9", 30, 30)], AGENT))
    live = spark.createDataFrame([("a", 50, True), ("a", 40, False), ("z", 60, False)], "agent_id string, last_seen bigint, isolated boolean")
    assert [tuple(x) for x in r.view(live).collect()] == [("b", "h2", 20, False, 20, False), ("a", "h9", 10, True, 50, True)]


def test_segments_of_other_schemas(spark, tmp_path):
    from huntframe.sources.segments import read_drifted

    rows = events(spark, [1, 2])
    rows.drop("target", "fields_json").withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "old"))
    rows.withColumn("severity_id", F.when(F.col("ts") == 1, "4").otherwise("high")).write.parquet(str(tmp_path / "text"))
    got = read_drifted(spark, [str(tmp_path / "old"), str(tmp_path / "text")])
    assert got.schema == EVENT and sorted((r.id, r.fields_json, r.severity_id) for r in got.collect() if r.fields_json) == [("e1", "{}", 4), ("e2", "{}", None)]
    assert got.count() == 4 and read_drifted(spark, []).count() == 0


def test_tail_source(spark, tmp_path):
    log, check, out = tmp_path / "a.log", str(tmp_path / "ck"), str(tmp_path / "out")
    log.write_bytes(b"one\r\n\ntwo\npart")

    def run():
        q = tail.tail(spark, str(tmp_path / "*.log")).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.raw for r in spark.read.parquet(out).collect())

    assert run() == ["one", "two"]
    with open(log, "ab") as f:
        f.write(b"ial\nthree\n")
    assert run() == ["one", "partial", "three", "two"]
    log.write_bytes(b"new\n")
    assert run() == ["new", "one", "partial", "three", "two"]


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):
        events(spark, [1_700_000_000_000_000 + (i * 4 + j) * 60_000_000 for j in range(4)]).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.schema(EVENT).parquet(path)
    stream = lambda: pipeline.event_stream(spark, path, files=1)
    got = pipeline.histogram(stream(), 300_000_000, scratch(spark, "h"))
    want = batch.groupBy((F.call_function("div", "ts", F.lit(300_000_000)) * 300_000_000).alias("b")).count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    rule = rules.Rule("Failed", {"s": ["failed"], "condition": "s"}, id="f")
    assert pipeline.alerts(stream(), [rule], scratch(spark, "a")).count() == 12
    c = correlation.CorrelationRule("c", "c", "event_count", ["f"], "10m", ["user"], {"gte": 3})
    entries = lambda df: df.select(F.lit("ann").alias("key"), "ts", "id", F.lit("f").alias("rule_id"), F.lit(None).cast("string").alias("value"))
    out = VersionedTable(spark, scratch(spark, "c"), schema("key string, ts bigint, events array<string>"))
    pipeline.run_available(correlation_stream := pipeline.correlate(entries(stream()), c), lambda b, n: out.append(b) and None)
    assert correlation_stream.isStreaming
    want = correlation.correlate(entries(batch), c)
    assert {(r.ts, tuple(r.events)) for r in out.read().collect()} == {(r.ts, tuple(r.events)) for r in want.collect()} and want.count() == 4
    w = pipeline.session_windows(stream(), 60_000_000, scratch(spark, "w"))
    first = 1_700_000_000_000_000
    assert [tuple(r) for r in w.collect()] == [("h", first, first + 11 * 60_000_000, 12)]
