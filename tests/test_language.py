"""The pipe language, SQL and full-text search."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from huntframe.operators import search
from huntframe.plans import dsl, sql

ROWS = [("e1", 100, "web01", "Failed password for Mallory", "mallory", "user", None, 3, "a"), ("e2", 200, "web01", "accepted key, for alice", "alice", "user", "10.0.0.1", 1, "a"), ("e3", 300, "web02", "failed PASSWORD again", None, None, None, 4, None), ("e4", 5_000, None, "", None, None, None, 1, "b")]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "id string, ts bigint, host string, message string, actor string, actor_kind string, target string, severity_id int, tenant string")


def ids(df):
    return [r.id for r in df.collect()]


def test_stats_and_order(events):
    got = dsl.run("stats count() as n by host | sort n desc", events).collect()
    assert got[0].asDict() == {"host": "web01", "n": 2} and len(got) == 3
    assert dsl.run("stats count()", events).first()["count"] == 4
    assert ids(dsl.run("head 1 | where severity_id >= 3 | sort ts desc", events)) == ["e3"]
    assert dsl.run("fields id | stats count() as n | fields host", events).columns == ["n"]
    assert [r.tenant for r in dsl.run("sort tenant", events).collect()][-1] is None
    assert [r.tenant for r in dsl.run("sort tenant desc", events).collect()][0] is None


def test_filters_take_the_type_of_their_column(events):
    assert ids(dsl.run("where severity_id = 4", events)) == ["e3"]
    assert ids(dsl.run("where host = 5", events)) == []
    assert ids(dsl.run("search failed pass", events)) == ["e1", "e3"]
    assert ids(dsl.run("where message contains 'key, for' | fields id", events)) == ["e2"]
    assert ids(dsl.run("where message contains 'a | b'", events)) == []
    for bad in ("where severity_id = high", "where severity_id = nan", "where host", "head x", "fields a-b", "stats sum(x)", "drop x"):
        with pytest.raises(dsl.DslError):
            dsl.run(bad, events)
    assert dsl.is_dsl(" search x") and not dsl.is_dsl("select 1")


def test_durations_and_histogram(events):
    assert [dsl.duration_us(x) for x in ("90s", "2h", "1w", "5", "-1h", "1y")] == [90_000_000, 7_200_000_000, 604_800_000_000, None, None, None]
    assert {(r.bucket, r.n) for r in dsl.time_histogram(events, "1h").collect()} == {(0, 4)}
    assert dsl.time_histogram(events, like="PASSWORD").first().n == 1
    assert {r.value for r in dsl.facets(events, ["host"], top=1).collect()} == {"web01"}


def test_search(events):
    found = lambda q: set(ids(search.search(events, q)))
    assert ids(search.search(events, "password")) == ["e3", "e1"]
    assert found('"failed password"') == {"e1", "e3"} and found('"password failed"') == set()
    assert found("web01") == {"e1", "e2"} and found("host:web01 -failed") == {"e2"} and found("mallory OR alice") == {"e1", "e2"}
    assert found("(alice OR again) AND NOT host:web02") == {"e2"} and found("") == {"e1", "e2", "e3", "e4"} and found("ts:[150 TO 300]") == {"e2", "e3"}
    assert found("severity:4") == {"e3"} and len(ids(search.search(events, "", limit=0))) == 1
    for bad in ("(a", "a)", "AND", '"open'):
        with pytest.raises(search.SearchError):
            search.parse(bad)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet='ab"():-+ ANDORT', max_size=20))
def test_search_never_breaks_otherwise(spark, text):
    try:
        search.parse(text)
    except search.SearchError:
        pass


def test_sql_is_read_only_and_translated(spark, events):
    assert sql.query(spark, "SELECT host, count(*) AS n FROM events GROUP BY host", {"events": events}).count() == 3
    assert sql.query(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x", {"events": events}).first().a == 1
    assert sql.query(spark, "SELECT strpos(message, 'key') AS p, 'strpos(' AS s FROM events WHERE starts_with(id, 'e2')", {"events": events}).first() == (10, "strpos(")
    for bad in ("DROP TABLE events", "SELECT 1; SELECT 2", "INSERT INTO events VALUES (1)"):
        with pytest.raises(sql.SqlError):
            sql.query(spark, bad, {"events": events})
    assert sql.query(spark, "SELECT count(*) AS n FROM events", {"events": events.limit(0)}).first().n == 0
    assert ("ts", "bigint", True) in sql.describe(events)
