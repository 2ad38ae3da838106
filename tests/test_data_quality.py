"""The data-quality operators against plain Python and on small defined cases."""

import datetime as dt

import brute
import pandas as pd
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from huntframe.operators import bad_rows, drift, instants, late, sessions
from huntframe.plans import data_quality
from huntframe.session import scratch

HOUR = 3_600_000_000


def rows(df):
    return set(map(tuple, df.collect()))


def small(name):
    return pd.read_parquet(f"{SMALL}/{name}.parquet")


def none(x):
    return None if x is None or x != x else x


# Rows that fail to parse


def test_reasons_equal_brute_force(spark):
    f = small("codec_frames").drop_duplicates("frame_id")
    want = {(i, r) for i, c, b in zip(f.frame_id, f.codec, f.raw) if (r := brute.frame_reason(c, b))}
    assert rows(data_quality.p1_found(spark, SMALL)) == want


FRAMES = [
    ("json", b'{"a": 1} x', "quoting"), ("json", b'{"a": 1},{"b": 2}', "quoting"), ("json", b'{"a": 1}]', "quoting"), ("json", b'{"a": 1}}', "quoting"), ("json", b"{'a': 1}", "quoting"), ("json", b"[1, 2", "quoting"),
    ("json", b'[{"dst_port": 1}, {"dst_port": 70000}]', "value"), ("json", b'{"status_code": "200"}', "value"), ("json", b'{"dst_port": 80.5}', "value"), ("json", b'{"src_ip": null}', None), ("json", b" 7 ", None),
    ("csv", b'10.0.0.1,1,10.0.0.2,2,tcp,a,5,r,"x ""y"" z"', None), ("csv", b'10.0.0.1,1,10.0.0.2,2,tcp,a,5,r,"x"y', "quoting"), ("csv", b'10.0.0.1,1,10.0.0.2,2,tcp,a,5,r,""', None), ("csv", b"1,2", "columns"),
    ("csv", b'10.0.0.1,1,10.0.0.2,2,tcp,a,-5,r,x', "value"), ("csv", b'10.0.0.256,1,10.0.0.2,2,tcp,a,5,r,x', "value"), ("csv", b'"open', "quoting"),
    ("cef", b"CEF:0|a|b|c|d|e|5|src=1.2.3.4 msg=a | b", None), ("cef", rb"CEF:0|a\|x|b|c|d|e|5|", None), ("cef", b"CEF:0|a|b|c|d|e|", "columns"), ("cef", b"CEF:0|a|b|c|d|e|11|", "value"), ("cef", b"Feb 30 10:00:00 h CEF:0|a|b|c|d|e|1|", "value"),
    ("leef", b"LEEF:1.0|a|b|c|d|src=1.2.3.4\tsev=10", None), ("leef", b"LEEF:2.0|a|b|c|d|^|src=1.2.3^sev=1", "value"), ("leef", b"LEEF:2.0|a|b|c|x09|src=1.2.3.4", "columns"), ("leef", b"LEEF:3.0|a|b|c|d|", "columns"),
    ("syslog", b"<34>Feb 29 10:00:00 h app: x", None), ("syslog", b"<34>Feb 30 10:00:00 h app: x", "value"), ("syslog", b"<192>Oct  1 10:00:00 h x", "value"), ("syslog", b"<x>Oct  1 10:00:00 h x", "value"), ("syslog", b"Oct  1 10:00:00 h x", "columns"),
    ("syslog", b'<1>1 2024-01-01T00:00:00Z h a - - [i k="a \\] b"][j] m', None), ("syslog", b'<1>1 2024-01-01T00:00:00Z h a - - [i k="v"junk] m', "quoting"), ("syslog", b"<1>1 2024-02-30T00:00:00Z h a - - -", "value"), ("syslog", b"<1>1 - h a - -", "columns"),
    ("raw", b"anything", None), (None, b"anything", None), ("json", b"\xff", "value"), ("csv", b" \t\r\n", "columns"), ("cef", None, "columns"), ("strange", b"", "columns"),
]


def test_reasons_of_single_frames(spark):
    df = spark.createDataFrame([(i, c, b, "x", "y") for i, (c, b, _) in enumerate(FRAMES)], "frame_id bigint, codec string, raw binary, key string, text string")
    got = dict(rows(bad_rows.failures(df)))
    assert {i: got.get(i) for i in range(len(FRAMES))} == {i: r for i, (_, _, r) in enumerate(FRAMES)}
    assert all(brute.frame_reason(c, b) == r for c, b, r in FRAMES)


def test_long_frames_and_loading(spark):
    long = [
        (1, "csv", ("10.0.0.1,1,10.0.0.2,2,tcp,a,5,r,\"" + '""' * 200_000 + '"').encode()),
        (2, "json", b'{"host": "h", "m": "' + b"\\n" * 500_000 + b'"}'),
        (3, "syslog", b'<1>1 2024-01-01T00:00:00Z h a - - [i k="' + b'\\"' * 100_000 + b'"] m'),
        (4, "cef", b"CEF:0|a|b|c|d|e|5|msg=" + b"x" * 1_000_000),
        (5, "csv", b'"' * 1_000_001),
        (5, "csv", b'"' * 1_000_001),
        (None, "json", b'[{"a": 1}, {"a": null, "b": "c"}]'),
        (None, "csv", None),
    ]
    df = spark.createDataFrame([(*x, "old") for x in long], "frame_id bigint, codec string, raw binary, fields string")
    assert rows(bad_rows.failures(df)) == {(5, "quoting"), (None, "columns")}
    good = {r.frame_id: r.fields for r in bad_rows.loaded(df).collect()}
    assert set(good) == {1, 2, 3, 4} and good[2]["host"] == "h" and len(good[1]["comment"]) == 200_000
    assert bad_rows.loaded(df.where("frame_id is null and raw is not null")).first().fields == {"a": "1", "1.b": "c"}


def test_loaded_fields_equal_plain_parsing(spark):
    import csv
    import json

    f = small("codec_frames").drop_duplicates("frame_id")
    good = {i: (c, b) for i, c, b in zip(f.frame_id, f.codec, f.raw) if brute.frame_reason(c, b) is None}
    got = {r.frame_id: json.loads(r.fields_json) for r in data_quality.p1_loaded(spark, SMALL).collect()}
    assert set(got) == set(good)
    for i, (c, b) in good.items():
        text = b.decode().strip()
        if c == "csv":
            assert got[i] == dict(zip(["src_ip", "src_port", "dst_ip", "dst_port", "proto", "action", "bytes", "rule", "comment"], next(csv.reader([text]))))
        elif c == "json":
            value = json.loads(text)
            objects = [o for o in (value if isinstance(value, list) else [value]) if isinstance(o, dict)]
            want = {(f"{n}." if n else "") + k for n, o in enumerate(objects) for k, v in o.items() if v is not None}
            assert set(got[i]) == want and all(got[i][k] == v for k, v in (objects[0] if objects else {}).items() if isinstance(v, str))
        else:
            assert got[i]


def test_repeated_names_in_a_frame(spark):
    df = spark.createDataFrame([(1, "cef", b"CEF:0|a|b|c|d|e|5|msg=one msg=two")], "frame_id bigint, codec string, raw binary")
    assert bad_rows.loaded(df).first().fields["msg"] == "two"


def test_no_frames(spark):
    df = spark.createDataFrame([], "frame_id bigint, codec string, raw binary")
    assert bad_rows.failures(df).count() == 0 and bad_rows.loaded(df).count() == 0


# Schema drift


def test_changes_equal_brute_force(spark):
    f, l = small("traffic_files"), small("traffic_lines")
    want = brute.drift([(a, b, c) for a, b, c in zip(f.feed, f.file_no, f.file_id)], zip(l.file_id, l.payload))
    assert rows(data_quality.p2_found(spark, SMALL)) == want


LINES = [
    (1, 1, '{"app": "a", "n": 1, "x": true, "host": "h"}'), (1, 2, '{"app": "b", "n": 2, "gone": null}'), (1, 2, '{"app": "b", "n": 2, "gone": null}'), (1, 3, None), (1, 4, "not json"), (1, 5, "[1]"),
    (2, 1, '{"App": "a", "n": "1", "y": true, "host": "h", "new": [1]}'), (2, 2, '{"App": "b"}'),
    (3, 1, '{"application": "b", "n": 1.5, "host": "h", "new": {"k": 1}}'), (3, 2, '{"application": "a"}'),
]


def drift_tables(spark, lines=LINES):
    files = spark.createDataFrame([(1, "f", 1, "z"), (2, "f", 2, "z"), (3, "f", 3, "z"), (3, "f", 3, "z"), (9, "g", 1, "z")], "file_id bigint, feed string, file_no int, name string")
    return files, spark.createDataFrame([(*x, "q") for x in lines], "file_id bigint, line_no int, payload string, kind string")


def test_changes_of_small_files(spark):
    files, lines = drift_tables(spark)
    got = rows(drift.changes(files, drift.profiles(lines)))
    assert got == {
        (2, "renamed", "app", "App", "string", "string"), (2, "renamed", "x", "y", "boolean", "boolean"), (2, "retyped", "n", "n", "integer", "string"), (2, "added", "", "new", "", "array"),
        (3, "renamed", "App", "application", "string", "string"), (3, "retyped", "n", "n", "string", "number"), (3, "retyped", "new", "new", "array", "object"), (3, "removed", "y", "", "boolean", ""),
    }
    one = {(r.file_id, r.line_no): r.fields for r in drift.unified(files, lines).collect()}
    assert one[3, 2] == {"app": "a"} and one[2, 1]["x"] == "true" and one[1, 3] == {}


def test_unified_lines_equal_brute_force(spark):
    import json

    f, l = small("traffic_files").drop_duplicates("file_id"), small("traffic_lines").drop_duplicates(["file_id", "line_no"])
    changed = brute.drift([(a, b, c) for a, b, c in zip(f.feed, f.file_no, f.file_id)], zip(l.file_id, l.payload))
    renamed = {(c[0], c[3]): c[2] for c in changed if c[1] == "renamed"}
    column, held = {}, {}
    for i, p in zip(l.file_id, l.payload):
        if p is not None and isinstance(o := json.loads(p), dict):
            held.setdefault(i, set()).update(k for k, v in o.items() if v is not None)
    for _, feed in f.sort_values(["feed", "file_no", "file_id"]).groupby("feed"):
        current: dict = {}
        for i in feed.file_id:
            now = {k: current.get(renamed.get((i, k), k), renamed.get((i, k), k)) for k in held.get(i, ())}
            current.update(now)
            column[i] = now
    got = {(r.file_id, r.line_no): json.loads(r.fields_json) for r in data_quality.p2_unified(spark, SMALL).collect()}
    assert set(got) == set(zip(l.file_id, l.line_no))
    for i, n, p in zip(l.file_id, l.line_no, l.payload):
        o = json.loads(p) if p is not None else {}
        want = {column[i][k]: v for k, v in (o.items() if isinstance(o, dict) else ()) if v is not None}
        assert set(got[i, n]) == set(want) and all(got[i, n][k] == v for k, v in want.items() if isinstance(v, str))


def test_equal_candidates_are_matched_by_name(spark):
    lines = [(1, 1, '{"user_name": 1, "dst_port": 1}'), (2, 1, '{"dstPort": 1, "userName": 1}')]
    files, lines = drift_tables(spark, lines)
    got = {(r.field_before, r.field_after) for r in drift.changes(files, drift.profiles(lines)).where("change_kind = 'renamed'").collect()}
    assert got == {("user_name", "userName"), ("dst_port", "dstPort")}


def test_no_lines(spark):
    files, lines = drift_tables(spark, [])
    assert drift.changes(files, drift.profiles(lines)).count() == 0 and drift.unified(files, lines).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(0, 1), min_size=3, max_size=3), min_size=1, max_size=4))
def test_assignment_is_the_best(weights):
    from itertools import permutations

    n, m = len(weights), 3
    best = max(sum(weights[i][j] for i, j in zip(r, c)) for k in [min(n, m)] for r in permutations(range(n), k) for c in permutations(range(m), k))
    got = drift.assign(weights)
    assert len(got) == min(n, m) and abs(sum(weights[i][j] for i, j in got) - best) < 1e-9


# Timestamps


def test_instants_equal_brute_force(spark):
    s = small("input_sources")
    r = small("codec_records").drop_duplicates("record_id").merge(s[["input_name", "zone_name", "date_order"]], on="input_name")
    want = {("codec", str(i), u) for i, t, z, o, a in zip(r.record_id, r.ts_text, r.zone_name, r.date_order, r.recv_us) if (u := brute.instant(t, z, o, a)) is not None}
    e = small("segment_events").drop_duplicates("id")
    want |= {("segment", i, brute.unit(t)) for i, t in zip(e.id, e.ts) if brute.unit(t) != t}
    assert rows(data_quality.p3_found(spark, SMALL)) == want


def us(*a):
    return (dt.datetime(*a) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


INSTANTS = [
    ("2024-03-10 02:30:00", "America/New_York", "mdy", us(2024, 3, 10, 8), None),
    ("2024-11-03 01:30:00", "America/New_York", "mdy", us(2024, 11, 3, 5, 31), us(2024, 11, 3, 5, 30)),
    ("2024-11-03 01:30:00", "America/New_York", "mdy", us(2024, 11, 3, 9), us(2024, 11, 3, 6, 30)),
    ("Dec 31 23:59:59", "UTC", "mdy", us(2025, 1, 1, 0, 1), us(2024, 12, 31, 23, 59, 59)), ("Jan  1 00:00:01", "UTC", "mdy", us(2024, 12, 31, 23), us(2025, 1, 1, 0, 0, 1)), ("Feb 29 12:00:00", "UTC", "mdy", us(2026, 1, 1), us(2024, 2, 29, 12)),
    ("03/04/2024 12:00:00 AM", "UTC", "mdy", 0, us(2024, 3, 4)), ("03/04/2024 12:00:00 PM", "UTC", "dmy", 0, us(2024, 4, 3, 12)), ("03/04/2024 13:00:00 PM", "UTC", "dmy", 0, None), ("31/31/2024 10:00:00", "UTC", "ymd", 0, None),
    ("2024-01-02T03:04:05.123456789+05:45", "UTC", "ymd", 0, us(2024, 1, 1, 21, 19, 5, 123456)), ("Jan 02 2024 03:04:05.7 EST", "UTC", "ymd", 0, us(2024, 1, 2, 8, 4, 5, 700000)), ("Jan 02 2024 03:04:05 XYZ", "UTC", "ymd", 0, None),
    ("19. Mär 2024 04:32:09", "Europe/Berlin", "dmy", 0, us(2024, 3, 19, 3, 32, 9)), ("06/Feb/2023:03:28:38 -0600", "UTC", "mdy", 0, us(2023, 2, 6, 9, 28, 38)), ("Wed Jan  4 17:23:58 2023", "UTC", "mdy", 0, us(2023, 1, 4, 17, 23, 58)), ("20230111111343", "UTC", "ymd", 0, us(2023, 1, 11, 11, 13, 43)),
    ("1676109592.688", "UTC", "ymd", 0, 1676109592688000), (" 1674818577259639073\t", "UTC", "ymd", 0, 1674818577259639), ("2024-05-24 06:33", None, "ymd", 0, None), ("2024-05-24 06:33Z", None, "ymd", 0, us(2024, 5, 24, 6, 33)),
    ("", "UTC", "ymd", 0, None), (None, "UTC", "ymd", 0, None), ("unknown", "UTC", "ymd", 0, None), ("2024-06-31 00:00:00", "UTC", "ymd", 0, None), ("2024-06-30 24:00:00", "UTC", "ymd", 0, None), ("x" * 1_000_000, "UTC", "ymd", 0, None), ("Jan 5 10:00:00", "UTC", "ymd", None, None),
]


def test_single_instants_and_an_incremental_dictionary(spark, monkeypatch):
    data = [(i, t, z, o, a, "x", "y") for i, (t, z, o, a, _) in enumerate(INSTANTS)]
    df = spark.createDataFrame(data, "record_id bigint, ts_text string, zone_name string, date_order string, recv_us bigint, candidates string, zone string")
    words = instants.InstantDictionary(spark, scratch(spark, "words"))
    first = words.keyed(df.where("record_id < 10"))
    words.extend(first)
    n = words.table.read().count()
    every = words.keyed(df)
    words.extend(every)
    parsed = []
    monkeypatch.setattr(instants, "parse", lambda new, real=instants.parse: parsed.append(new.count()) or real(new))
    words.extend(every)
    assert parsed == [0]  # a later batch parses no known text
    assert words.table.read().count() == df.where("ts_text is not null").select("ts_text", "zone_name", "date_order", F.when(F.col("ts_text").rlike(r"\d{4}"), 0).otherwise(F.year(F.timestamp_micros("recv_us")))).distinct().count() > n
    got = {r.record_id: r.ts_us for r in words.lookup(every).collect()}
    assert got == {i: w for i, (*_, w) in enumerate(INSTANTS)}


# Sessions


def test_sessions_equal_brute_force(spark):
    m = small("mixed_traffic")
    want = brute.sessions([(a, none(b) and int(b), none(c), none(h)) for a, b, c, h in zip(m.event_id, m.ts, m.username, m.host)], 30 * 60 * 10**6)
    assert rows(data_quality.p4_found(spark, SMALL)) == want


EVENTS = "event_id bigint, ts bigint, username string, host string, owner_name string"


def sessions_of(spark, data, batches):
    df = spark.createDataFrame([(*x, "clash") for x in data], EVENTS)
    return rows(sessions.sessions(df, scratch(spark, "s"), key="event_id", ts="ts", user=F.col("username"), device=F.col("host"), gap_us=100, batches=batches))


def test_sessions_of_small_tables(spark):
    data = [
        (1, 0, " Ann", "h"), (2, 100, "ann ", "h"), (3, 201, "ANN", None), (3, 201, "ANN", None), (4, 50, "-", "h"), (5, None, "ann", "h"), (6, 10, None, None), (7, 10, "", " "), (8, 150, None, "h"), (9, 201, "ann", "x"), (None, 301, "ann", "h"),
    ]
    want = {("user", "ann", 0, 100, 100, 2), ("user", "ann", 201, 301, 100, 3), ("device", "h", 50, 150, 100, 2)}
    assert sessions_of(spark, data, 1) == want == sessions_of(spark, data, 4)
    assert sessions_of(spark, [], 2) == set()


def test_merging_touches_only_near_parts(spark):
    store = sessions.SessionTable(spark, scratch(spark, "s"), 100)
    make = lambda *x: spark.createDataFrame([("user", "a", s, e, n) for s, e, n in x], sessions.SESSION)
    day = sessions.DAY
    store.merge(make((0, 10, 1)))
    store.merge(make((40 * day, 40 * day + 5, 1)))
    far = {p["path"] for p in store.table.parts() if p["start"] == 0}
    store.merge(make((40 * day + 90, 40 * day + 95, 2), (40 * day + 300, 40 * day + 300, 1)))
    assert far <= {p["path"] for p in store.table.parts()}
    assert rows(store.read()) == {("user", "a", 0, 10, 1), ("user", "a", 40 * day, 40 * day + 95, 3), ("user", "a", 40 * day + 300, 40 * day + 300, 1)}
    version = store.table.version()
    assert store.merge(make()) == version
    store.merge(make((20, 30, 5)), 0)
    store.merge(make((20, 30, 5)), 0)
    assert rows(store.read().where("start_us = 0")) == {("user", "a", 0, 30, 6)}


# Late events


def test_late_counts_equal_brute_force(spark):
    e = small("segment_events")
    want = brute.late(zip(e.id, e.tenant, e.ts, e.ingest_ts), HOUR, 6 * HOUR)
    assert rows(data_quality.p6_found(spark, SMALL)) == want


def test_any_order_of_batches_gives_the_same(spark):
    data = [("a", "t", 10, HOUR - 1), ("b", "t", 20, HOUR), ("c", "t", 30, 7 * HOUR - 1), ("d", "t", 40, 7 * HOUR), ("a", "t", 10, 9 * HOUR), ("e", None, 10, 2 * HOUR), (None, "t", 1, 1), ("f", "t", None, 1), ("g", "t", 1, None), ("d", "t", 40, HOUR), ("d", "t", 40, HOUR)]
    ddl = "id string, tenant string, ts_us bigint, arrival bigint, old string"
    want = {("t", 0, 1, 4, 0, 3), (None, 0, 0, 1, 0, 1)}
    for order in (data, data[::-1], data[5:] + data[:5]):
        w = late.LateWindows(spark, scratch(spark, "late"), redelivery_us=None)
        changed = [rows(w.ingest(spark.createDataFrame([(*x, "z") for x in part], ddl))) for part in (order[:4], order[4:8], order[8:], [])]
        assert rows(w.counts()) == want and changed[-1] == set()
        assert rows(w.refused()) == set()  # d was refused until its earlier arrival came
    assert late.late_counts(spark.createDataFrame([], ddl), scratch(spark, "late")).count() == 0


LATE = "id string, tenant string, ts_us bigint, arrival bigint"


def test_refused_rows_are_taken_back(spark):
    w = late.LateWindows(spark, scratch(spark, "late"), redelivery_us=None)
    w.ingest(spark.createDataFrame([("d", "t", 40, 7 * HOUR), ("e", "t", 40, 8 * HOUR)], LATE), 0)
    assert rows(w.counts()) == {("t", 0, 0, 0, 2, 2)} and rows(w.refused()) == {("d", "t", 0, 7 * HOUR), ("e", "t", 0, 8 * HOUR)}
    changed = rows(w.ingest(spark.createDataFrame([("d", "t", 40, HOUR)], LATE), 1))
    assert changed == rows(w.counts()) == {("t", 0, 0, 1, 1, 2)} and rows(w.refused()) == {("e", "t", 0, 8 * HOUR)}


@pytest.mark.parametrize("lost_after", [False, True])
def test_a_batch_that_fails_at_its_commit_and_is_repeated(spark, monkeypatch, lost_after):
    w = late.LateWindows(spark, scratch(spark, "late"))
    batches = [[("a", "t", 10, HOUR - 1), ("b", "t", 20, 9 * HOUR)], [("b", "t", 20, HOUR), ("c", "u", 30, 2 * HOUR)]]
    real, failing = type(w.store).commit, []

    def commit(self, *args, **kw):
        done = real(self, *args, **kw) if lost_after or not failing else None
        if failing:
            failing.clear()
            raise OSError("the driver is lost")
        return done

    monkeypatch.setattr(type(w.store), "commit", commit)
    for n, data in enumerate(batches):
        df = spark.createDataFrame(data, LATE)
        failing.append(True)
        with pytest.raises(OSError):
            w.ingest(df, n)
        w.ingest(df, n)
        w.ingest(df, n)
    assert rows(w.counts()) == {("t", 0, 1, 2, 0, 1), ("u", 0, 0, 1, 0, 1)} and rows(w.refused()) == set()


def test_two_writers_of_late_windows(spark):
    path = scratch(spark, "late")
    ours, theirs = late.LateWindows(spark, path), late.LateWindows(spark, path)
    real, raced = ours.store.stage, []

    def stage(table, df, by=None):
        if not raced:
            raced.append(theirs.ingest(spark.createDataFrame([("a", "t", 10, HOUR), ("x", "t", 10, HOUR)], LATE)))
        return real(table, df, by)

    ours.store.stage = stage
    ours.ingest(spark.createDataFrame([("a", "t", 10, HOUR - 1), ("b", "t", 10, HOUR - 1)], LATE))
    assert rows(ours.counts()) == {("t", 0, 2, 3, 0, 1)}


def test_the_watermark_forgets_and_sets_aside(spark):
    day = 24 * HOUR
    w = late.LateWindows(spark, scratch(spark, "late"), redelivery_us=2 * day)
    w.ingest(spark.createDataFrame([("a", "t", 10, HOUR), ("a2", "t", 10, 2 * day)], LATE), 0)
    w.ingest(spark.createDataFrame([("b", "t", 5 * day, 5 * day), ("a2", "t", 10, 3 * day)], LATE), 1)
    assert w.watermark() == 3 * day and rows(w.store.read("seen").select("id")) == {("b",)}
    counts = rows(w.counts())
    w.ingest(spark.createDataFrame([("old", "t", 20, 2 * day), ("b", "t", 5 * day, 6 * day)], LATE), 2)
    assert rows(w.counts()) == counts and rows(w.overdue().select("id")) == {("old",)}


def test_far_days_of_counts_stay(spark):
    day = 24 * HOUR
    w = late.LateWindows(spark, scratch(spark, "late"))
    w.ingest(spark.createDataFrame([("a", "t", 10, HOUR), ("b", "t", 3 * day, 3 * day)], LATE), 0)
    far = {p["path"] for p in w.store.parts(table="counts") if p["part"] == "0"}
    w.ingest(spark.createDataFrame([("c", "t", 3 * day, 3 * day)], LATE), 1)
    assert far <= {p["path"] for p in w.store.parts(table="counts")} and rows(w.counts()) == {("t", 0, 0, 1, 0, 1), ("t", 3 * day, 2, 2, 0, 0)}


@pytest.mark.parametrize("n,want", [(1_700_000_000, 1_700_000_000_000_000), (1_700_000_000_123, 1_700_000_000_123_000), (1_700_000_000_123_456, 1_700_000_000_123_456), (1_700_000_000_123_456_789, 1_700_000_000_123_456)])
def test_units(spark, n, want):
    assert spark.range(1).select(instants.unit_to_us(F.lit(n))).first()[0] == want
