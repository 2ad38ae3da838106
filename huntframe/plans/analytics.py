"""Queries of the analytical surface: pipe language, SQL, search, histograms, relational breadth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.operators import search
from huntframe.plans import dsl, sql
from huntframe.schema import SQL_EVENTS, events
from huntframe.session import scratch, table
from huntframe.sources.segments import SegmentStore, segment_stats

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Relational queries as Spark plans their text.
WRITTEN: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def relational(name: str, spark_sql: str, duck_sql: str | None = None, split: Callable[[SparkSession, str], DataFrame] | None = None) -> None:
    """A query that both engines read from one text, or from two where the dialects differ. ``split`` makes the same rows where Spark's plan of the text doesn't scale."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]

    def run(spark: SparkSession, d: str) -> DataFrame:
        used = {n: table(spark, d, n) for n in names if n in spark_sql}
        return sql.query(spark, spark_sql, used)

    QUERIES[name], ORACLE[name], WRITTEN[name] = split or run, duck_sql or spark_sql, run


@query(SQL_EVENTS + " SELECT tenant, ocsf_class_name, count(*) AS n FROM ev WHERE message ILIKE '%op.%' AND severity_id >= 3 GROUP BY tenant, ocsf_class_name")
def dsl_stats_by(spark: SparkSession, d: str) -> DataFrame:
    return dsl.run("search op. | where severity_id >= 3 | stats count() as n by tenant, ocsf_class_name | sort n desc", events(spark, d))


@query(SQL_EVENTS + " SELECT id, ts, host FROM ev WHERE host ILIKE '%edge%' AND ocsf_class = 4001")
def dsl_fields_where(spark: SparkSession, d: str) -> DataFrame:
    return dsl.run("where host contains edge | where ocsf_class = 4001 | fields id, ts, host", events(spark, d))


@query(SQL_EVENTS + " SELECT ocsf_class, count(*) AS n FROM ev WHERE severity_id >= 3 GROUP BY ocsf_class ORDER BY ocsf_class LIMIT 5")
def dsl_clause_order(spark: SparkSession, d: str) -> DataFrame:
    return dsl.run("head 5 | sort ocsf_class | stats count() as n by ocsf_class | where severity_id >= 3", events(spark, d))


@query(SQL_EVENTS + " SELECT (ts // 21600000000) * 21600000000 AS bucket, count(*) AS n FROM ev GROUP BY 1")
def time_histogram(spark: SparkSession, d: str) -> DataFrame:
    return dsl.time_histogram(events(spark, d), "6h")


@query(SQL_EVENTS + " SELECT (ts // 3600000000) * 3600000000 AS bucket, count(*) AS n FROM ev WHERE message LIKE '%GET%' GROUP BY 1")
def time_histogram_like(spark: SparkSession, d: str) -> DataFrame:
    return dsl.time_histogram(events(spark, d), "bad", like="GET")


@query(
    """WITH p AS (
      SELECT 'ocsf_class_name' AS facet, ocsf_class_name AS value FROM segment_events UNION ALL SELECT 'severity', severity FROM segment_events UNION ALL SELECT 'host', host FROM segment_events),
    c AS (SELECT facet, value, count(*) AS n FROM p WHERE value IS NOT NULL AND value != '' GROUP BY facet, value)
    SELECT facet, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 6"""
)
def facets_topk(spark: SparkSession, d: str) -> DataFrame:
    return dsl.facets(events(spark, d), ["ocsf_class_name", "severity", "host"])


@query("SELECT host, count(*) AS n FROM segment_events WHERE host IS NOT NULL GROUP BY host ORDER BY n DESC, host LIMIT 10")
def dashboard_top_hosts(spark: SparkSession, d: str) -> DataFrame:
    return sql.query(spark, "SELECT host, count(*) AS n FROM events WHERE host IS NOT NULL GROUP BY host ORDER BY n DESC, host LIMIT 10", {"events": events(spark, d)})


@query(
    SQL_EVENTS
    + r""", t AS (SELECT id, ts, host, ' ' || trim(lower(regexp_replace(message, '[^\p{L}\p{N}]+', ' ', 'g'))) || ' ' AS m, ' ' || trim(lower(regexp_replace(coalesce(actor, ''), '[^\p{L}\p{N}]+', ' ', 'g'))) || ' ' AS a,
      ' ' || trim(lower(regexp_replace(coalesce(target, ''), '[^\p{L}\p{N}]+', ' ', 'g'))) || ' ' AS g FROM ev)
    SELECT id, ts FROM t WHERE (m LIKE '% login refused %' OR a LIKE '% login refused %' OR g LIKE '% login refused %') OR
      (coalesce(host = 'gw-core-01', false) AND (m LIKE '% flow %' OR a LIKE '% flow %' OR g LIKE '% flow %' OR coalesce(host = 'flow', false)) AND NOT (m LIKE '% 53 %'))"""
)
def fulltext_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(events(spark, d), '"login refused" OR (host:gw-core-01 AND flow -message:53)', limit=None).select("id", "ts")


@query(
    """SELECT ocsf_class_name, CASE WHEN json_extract_string(fields_json, '$.status_code') IS NULL THEN -1 ELSE CAST(json_extract_string(fields_json, '$.status_code') AS INTEGER) END AS status_code, count(*) AS n,
      CAST(sum(len(json_keys(fields_json))) AS BIGINT) AS n_fields FROM segment_events GROUP BY 1, 2"""
)
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    code = F.coalesce(F.get_json_object("fields_json", "$.status_code").try_cast("int"), F.lit(-1))
    return e.groupBy("ocsf_class_name", code.alias("status_code")).agg(F.count("*").alias("n"), F.sum(F.size(F.json_object_keys("fields_json"))).alias("n_fields"))


@query(
    SQL_EVENTS
    + """ SELECT id, ts, actor, CAST(r AS INTEGER) AS r, prev_gap, CAST(n_hour AS BIGINT) AS n_hour FROM (
      SELECT id, ts, actor, row_number() OVER w AS r, coalesce(ts - lag(ts) OVER w, -1) AS prev_gap,
        count(*) OVER (PARTITION BY actor ORDER BY ts RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_hour
      FROM (SELECT DISTINCT id, ts, actor FROM ev WHERE ocsf_class = 3002 AND actor IS NOT NULL) WINDOW w AS (PARTITION BY actor ORDER BY ts, id))"""
)
def window_per_actor(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("ocsf_class = 3002 AND actor IS NOT NULL").select("id", "ts", "actor").distinct()
    w = Window.partitionBy("actor").orderBy("ts", "id")
    hour = Window.partitionBy("actor").orderBy("ts").rangeBetween(-3_600_000_000, 0)
    return e.select("id", "ts", "actor", F.row_number().over(w).alias("r"), F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(-1)).alias("prev_gap"), F.count("*").over(hour).alias("n_hour"))


@query(SQL_EVENTS + " SELECT ts // 86400000000 AS segment, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n FROM ev GROUP BY 1")
def segment_statistics(spark: SparkSession, d: str) -> DataFrame:
    return segment_stats(events(spark, d), 86_400_000_000)


@query(
    SQL_EVENTS
    + """, b AS (SELECT min(ts) AS lo, (max(ts) - min(ts)) // 3 AS step FROM ev)
    SELECT tenant, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev, b WHERE ts BETWEEN lo + step AND lo + 2 * step GROUP BY tenant"""
)
def segment_range_read(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    store = SegmentStore(spark, scratch(spark, "segments"))
    store.append(e, slices=6)
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) // 3
    return store.read_range(lo + step, lo + 2 * step).groupBy("tenant").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    SQL_EVENTS
    + """, s AS (SELECT (ts - (SELECT min(ts) FROM ev)) // ((SELECT max(ts) - min(ts) FROM ev) // 6 + 1) AS seg, ts FROM ev), g AS (SELECT seg, max(ts) AS hi, count(*) AS n FROM s GROUP BY seg), m AS (SELECT max(ts) AS now FROM ev)
    SELECT CASE WHEN now - hi > 1000000000000 THEN 'cold' ELSE 'warm' END AS tier, CAST(sum(n) AS BIGINT) AS n FROM g, m WHERE NOT (now - hi > 1500000000000) GROUP BY 1"""
)
def tiers_and_retention(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    store = SegmentStore(spark, scratch(spark, "tiers"))
    store.append(e, slices=6)
    now = e.agg(F.max("ts")).first()[0]
    store.migrate(now, 1_000_000_000_000)
    store.expire(now, 1_500_000_000_000)
    tiers = [store.read((t,)).select(F.lit(t).alias("tier")) for t in ("warm", "cold")]
    return tiers[0].unionByName(tiers[1]).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS type, true AS nullable FROM (DESCRIBE segment_events)")
def schema_discovery(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(sql.describe(events(spark, d)), "name string, type string, nullable boolean")


relational("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
relational("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
relational("sql_rollup_having", "SELECT c_mktsegment, coalesce(c_nationkey, -1) AS nation, grouping(c_nationkey) AS g, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) HAVING count(*) > 1")
relational(
    "sql_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
relational(
    "sql_join_inner",
    """SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
relational("sql_join_left", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(max(o_totalprice), 0), 2) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
relational("sql_join_full", "SELECT s_nationkey, c_nationkey, s, c FROM (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY s_nationkey) a FULL OUTER JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) b ON s_nationkey = c_nationkey")
relational("sql_join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
relational("sql_join_cross", "SELECT r_name, v.kind, length(r_name) > v.least AS long_name FROM region CROSS JOIN (SELECT 'short' AS kind, 3 AS least UNION ALL SELECT 'long', 6) v")
relational("sql_intersect_all", "SELECT c_nationkey % 5 AS k FROM customer INTERSECT ALL SELECT s_nationkey % 5 FROM supplier")
relational("sql_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")


def approximate(spark: SparkSession, d: str) -> DataFrame:
    """``sql_approximate`` in two aggregations, joined. Beside a DISTINCT Spark groups by the distinct value first, with a sketch
    of quantities and a map of them for every flag and part; here only the flags have them."""
    lines = table(spark, d, "lineitem")
    keys = lines.select("l_returnflag", "l_partkey").distinct()
    parts = keys.groupBy("l_returnflag").agg(F.expr("count(l_partkey) AS parts"), F.expr("approx_count_distinct(l_partkey) AS parts_about"))
    medians = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.expr("abs(approx_percentile(l_quantity, 0.5) - median(l_quantity)) <= 2 AS median_near"))
    return parts.join(medians, F.col("l_returnflag").eqNullSafe(F.col("flag"))).selectExpr("l_returnflag", "parts", "abs(parts_about - parts) <= 0.15 * parts AS parts_near", "median_near")


relational(
    "sql_approximate",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS parts_near,
    abs(approx_percentile(l_quantity, 0.5) - median(l_quantity)) <= 2 AS median_near FROM lineitem GROUP BY l_returnflag""",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS parts_near,
    abs(approx_quantile(l_quantity, 0.5) - median(l_quantity)) <= 2 AS median_near FROM lineitem GROUP BY l_returnflag""",
    approximate,
)
relational("sql_join_semi", "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
relational("sql_join_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
relational(
    "sql_join_interval",
    """SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY a.user_id""",
)
relational("sql_set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
relational("sql_set_operations_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
relational("sql_distinct_aggregates", "SELECT l_shipmode_group, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_discount > 0.05) AS cut FROM (SELECT *, l_linenumber % 3 AS l_shipmode_group FROM lineitem) t GROUP BY l_shipmode_group")
relational("sql_statistics", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 3) AS v, round(corr(p_size, p_retailprice), 6) AS r, round(regr_slope(p_retailprice, p_size), 5) AS slope, round(median(p_retailprice), 4) AS med FROM part GROUP BY p_brand")
relational(
    "sql_window_functions",
    """SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w2 AS q, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run,
    coalesce(lead(o_orderkey) OVER w2, -1) AS nxt, first_value(o_orderkey) OVER w2 AS fst, round(percent_rank() OVER w, 6) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    """SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w2 AS INTEGER) AS q,
    round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run,
    coalesce(lead(o_orderkey) OVER w2, -1) AS nxt, first_value(o_orderkey) OVER w2 AS fst, round(percent_rank() OVER w, 6) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
relational("sql_topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
relational(
    "sql_correlated_subquery",
    "SELECT s_suppkey, s_acctbal FROM supplier o WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier i WHERE i.s_nationkey = o.s_nationkey) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)",
)
relational(
    "sql_recursive",
    "WITH RECURSIVE days(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM days WHERE n < 29) SELECT n, count(o_orderkey) AS c FROM days LEFT JOIN orders ON o_orderkey % 30 = n GROUP BY n",
)
relational(
    "sql_string_functions",
    """SELECT p_partkey, upper(p_brand) AS u, length(p_name) AS n, substr(p_type, 2, 5) AS s, replace(p_type, 'A', '_') AS r, lpad(CAST(p_size AS STRING), 4, '0') AS l, reverse(p_brand) AS v, split_part(p_type, ' ', 1) AS f,
    levenshtein(p_brand, 'Brand#11') AS d, initcap(lower(p_type)) AS i, concat_ws('-', p_brand, p_type) AS c, starts_with(p_type, 'S') AS w, strpos(p_type, 'L') AS at, md5(p_name) AS h FROM part""",
    """SELECT p_partkey, upper(p_brand) AS u, CAST(length(p_name) AS INTEGER) AS n, substr(p_type, 2, 5) AS s, replace(p_type, 'A', '_') AS r, lpad(CAST(p_size AS VARCHAR), 4, '0') AS l, reverse(p_brand) AS v, split_part(p_type, ' ', 1) AS f,
    CAST(levenshtein(p_brand, 'Brand#11') AS INTEGER) AS d, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS i, concat_ws('-', p_brand, p_type) AS c, starts_with(p_type, 'S') AS w,
    CAST(strpos(p_type, 'L') AS INTEGER) AS at, md5(p_name) AS h FROM part""",
)
relational(
    "sql_date_functions",
    """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate) AS m, datediff(CAST('1999-01-01' AS DATE), CAST(o_orderdate AS DATE)) AS back, date_format(o_orderdate, 'yyyyMMdd') AS f FROM orders""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS back,
    strftime(o_orderdate, '%Y%m%d') AS f FROM orders""",
)
relational(
    "sql_math_functions",
    "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 4) AS s, floor(l_quantity) AS f, ceil(l_discount * 10) AS c, round(ln(l_extendedprice), 5) AS g, abs(l_linenumber - 4) AS a, power(l_linenumber, 2) AS p, sign(l_discount - 0.05) AS w, greatest(l_linenumber, 3) AS gr FROM lineitem",
    """SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 4) AS s, CAST(floor(l_quantity) AS BIGINT) AS f, CAST(ceil(l_discount * 10) AS BIGINT) AS c, round(ln(l_extendedprice), 5) AS g, abs(l_linenumber - 4) AS a, power(l_linenumber, 2) AS p,
    CAST(sign(l_discount - 0.05) AS DOUBLE) AS w, greatest(l_linenumber, 3) AS gr FROM lineitem""",
)
relational(
    "sql_array_functions",
    "SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 6) AS hi, round(CAST(element_at(embedding, 3) AS DOUBLE), 6) AS third, size(array_distinct(transform(embedding, x -> CAST(sign(x) AS INT)))) AS signs, size(filter(embedding, x -> x > 0)) AS pos FROM embeddings",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(list_max(embedding) AS DOUBLE), 6) AS hi, round(CAST(embedding[3] AS DOUBLE), 6) AS third, CAST(len(list_distinct(list_transform(embedding, lambda x: sign(x)))) AS INTEGER) AS signs,
    CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS pos FROM embeddings""",
)
relational(
    "sql_collection_aggregates",
    "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, bool_or(n_name LIKE 'A%') AS any_a, bool_and(length(n_name) > 3) AS all_long, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, bool_or(n_name LIKE 'A%') AS any_a, bool_and(length(n_name) > 3) AS all_long, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey",
)
relational("sql_conditional", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, nullif(c_mktsegment, 'BUILDING') AS seg, coalesce(nullif(c_nationkey, 0), -1) AS nat FROM customer")
