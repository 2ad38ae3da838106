"""The live path, configuration, datagrams, evaluation variants."""

import socket
import time

from pyspark.sql import functions as F

from huntframe.functions import enrich
from huntframe.operators import correlation, evals, rules
from huntframe.plans import config, live
from huntframe.schema import EVENT
from huntframe.session import scratch
from huntframe.sources import tail
from huntframe.sources.alerts import AlertStore
from huntframe.sources.segments import SegmentStore
from test_detection import DDL, M, event

RULE = rules.Rule("Failed", {"s": ["failed"], "condition": "s"}, id="f")
LINES = ["<34>Oct 11 22:14:15 web01 sshd[9]: Failed password for bob from 1.2.3.4", "<34>Oct 11 22:14:16 web01 sshd[9]: Accepted key for ann", "broken"]


def test_replay_and_detect(spark, tmp_path):
    (tmp_path / "auth.log").write_text("\n".join(LINES) + "\n")
    events, alerts = live.replay(spark, str(tmp_path / "auth.log"), "syslog", [RULE])
    assert events.count() == 3 and {r.actor for r in events.where("ocsf_class = 3002").collect()} == {"bob"} and alerts.count() == 1
    rows = [event(f"e{i}", "failed", ts=i * M, actor="m", target="q7f9x2k4j8.evil.example", target_kind="domain") for i in range(3)]
    corr = correlation.CorrelationRule("c", "C", "event_count", ["f"], "10m", ["user"], {"gte": 3})
    got = live.detect(spark.createDataFrame(rows, DDL), [RULE], [corr], [lambda e: enrich.dga_alerts(e, 3.0)])
    assert {(r.rule_id, len(r.events)) for r in got.collect()} == {("c", 3), ("<lambda>", 1)}


def test_ingest_twice_is_idempotent_for_alerts(spark, tmp_path):
    frames = spark.createDataFrame([(f"f{i}", t, "syslog", 10 + i) for i, t in enumerate(LINES)], "id string, raw string, codec string, recv_us bigint")
    s, a = SegmentStore(spark, scratch(spark, "s")), AlertStore(spark, scratch(spark, "a"))
    for _ in range(2):
        live.ingest_batch(frames, s, a, [RULE], enrich.redact_events)
    assert a.table.read().count() == 1 and s.total_rows() == 6
    path = str(tmp_path / "frames")
    frames.write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)
    s2, a2 = SegmentStore(spark, scratch(spark, "s")), AlertStore(spark, scratch(spark, "a"))
    live.ingest_stream(stream, s2, a2, [RULE], scratch(spark, "c"), available_now=True).awaitTermination()
    assert s2.total_rows() == 3 and a2.table.read().count() == 1


def test_recent_incidents(spark):
    rows = [event("e1", "failed password", 0, actor="m", host="h", severity=4), event("e2", "bash", 100, actor="m", host="h", cls=1007), event("old", "x", -(10**12), actor="m", host="h", cls=4001)]
    tech = spark.createDataFrame([("e1", "T1110")], "id string, technique string")
    got = live.recent_incidents(spark.createDataFrame(rows, DDL), tech, now=200).collect()
    assert [(r.chain, r.techniques) for r in got] == [("e1,e2", "T1110")]


def test_datagrams(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    q = tail.datagrams(spark, port).writeStream.format("memory").queryName("udp").start()
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for _ in range(100):
                s.sendto(b"<34>hello", ("127.0.0.1", port))
                time.sleep(0.2)
                if spark.table("udp").count():
                    break
        assert spark.table("udp").first().raw == "<34>hello"
    finally:
        q.stop()


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as probe:
        probe.bind(("127.0.0.1", 0))
        return probe.getsockname()[1]


def test_received_frames_survive_a_restart(tmp_path):
    port = free_port(socket.SOCK_DGRAM)
    options = {"port": str(port), "spool": str(tmp_path / "spool")}
    r = tail.FrameReader(options)
    assert list(r.read({"n": 0})[0]) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(3):
            s.sendto(f"<34>frame {i}".encode(), ("127.0.0.1", port))
    time.sleep(0.2)
    got, end = r.read({"n": 0})
    assert [t for _, t in got] == ["<34>frame 0", "<34>frame 1", "<34>frame 2"] and end == {"n": 3}
    r.commit({"n": 1})
    r.listener.socket.close()
    with open(tmp_path / "spool" / "frames.jsonl", "a") as f:
        f.write('[3, "cut sho')  # the driver was lost while it wrote
    again = tail.FrameReader(options)
    assert [t for _, t in again.readBetweenOffsets({"n": 1}, {"n": 3})] == ["<34>frame 1", "<34>frame 2"]
    again.commit({"n": 3})
    last = tail.FrameReader(options)
    assert list(last.readBetweenOffsets({"n": 0}, {"n": 9})) == [] and last._spool().next == 3
    again.listener and again.listener.socket.close()


def test_lines_of_tcp_peers():
    port = free_port(socket.SOCK_STREAM)
    listener = tail.Listener("tcp", "127.0.0.1", port)
    a, b = (socket.create_connection(("127.0.0.1", port)) for _ in range(2))
    a.sendall(b"one\r\n\ntw")
    b.sendall(b"other\n")
    time.sleep(0.2)
    assert sorted(listener.frames()) == ["one", "other"]
    a.sendall(b"o\nrest")
    a.close()
    time.sleep(0.2)
    assert listener.frames() == ["two", "rest"] and listener.frames() == []
    b.close()
    listener.socket.close()


def test_configuration():
    good = {"inputs": [{"id": "a", "type": "file", "codec": "json"}], "pipelines": [{"id": "p", "inputs": ["a"], "route": ["index", "rules"]}], "retention": {"warm": "30d"}}
    assert config.validate(good) == ([], [])
    bad = {"inputs": [{"id": "a", "type": "queue", "codec": "x"}, {"id": "a", "type": "file"}], "pipelines": [{"id": "p", "inputs": ["b"], "route": ["rules", "nowhere"]}], "retention": {"hot": "soon"}}
    errors, warnings = config.validate(bad)
    assert len(errors) == 4 and len(warnings) == 3
    assert config.redacted({"a": [{"api_key": "x", "name": "n"}]}) == {"a": [{"api_key": "***", "name": "n"}]}
    assert config.plan(good, {**good, "retention": {"warm": "31d", "cold": "1w"}}) == [("add", "retention.cold"), ("change", "retention.warm")] and config.plan(good, good) == []


def test_variants(spark):
    got = {v: evals.evaluate(evals.scenario(spark), variant=v) for v in evals.VARIANTS}
    assert got["combined"]["ari"] > 0.9 and got["provenance"]["ari"] > 0.9 and got["rules"]["chain_similarity"] == 0.0 and got["semantic"]["ari"] <= 1.0
    assert got["rules"]["technique_f1"] == 1.0 and got["combined"]["nmi"] >= got["rules"]["nmi"] > 0.5
    mean, half = evals.evaluate_seeds(spark, [1, 2], "provenance")["ari"]
    assert mean > 0.9 and half >= 0


def test_an_empty_day(spark):
    none = spark.createDataFrame([], EVENT)
    assert live.detect(none, [RULE], []).count() == 0 and live.recent_incidents(none, spark.createDataFrame([], "id string, technique string"), 0).agg(F.count("*")).first()[0] == 0
