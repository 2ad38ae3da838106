"""Graphs, campaigns, chains, templates, vectors, measures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntframe.operators import campaigns as cp
from huntframe.operators import evals, graph, templates, vectors
from test_detection import DDL, M, event


def test_entities_and_links(spark):
    rows = [event("a", host="h", actor="bash", kind="process", target="/x", target_kind="file"), event("b", ts=1 * M, host="h"), event("c", ts=50 * M, host="h", actor="bash", kind="process"), event("d", ts=51 * M), event("b2", ts=1 * M, host="h")]
    df = spark.createDataFrame(rows, DDL)
    assert {(r.src, r.dst) for r in graph.provenance_edges(df).where("id = 'a'").collect()} == {("host:h", "process:bash"), ("process:bash", "file:/x")}
    assert {(r.a, r.b) for r in graph.entity_links(df, 30 * M).collect()} == {("a", "b"), ("b", "b2")}
    chosen = df.where("id = 'a'")
    assert {r.other for r in graph.co_entity_events(df, chosen).collect()} == {"b", "b2", "c"} and {r.other for r in graph.co_entity_events(df, chosen, 30 * M).collect()} == {"b", "b2"}
    edges = graph.provenance_edges(df)
    start = spark.createDataFrame([("host:h",)], "node string")
    assert {(r.node, r.hop) for r in graph.k_hop(edges, start, 2).collect()} == {("process:bash", 1), ("file:/x", 2)}
    assert graph.k_hop(edges, start, 0).count() == 0 and graph.entity_links(df.limit(0), M).count() == 0


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {(x, find(x)) for x in list(up)}


@pytest.mark.parametrize("n,m", [(40, 25), (200, 260)])
def test_components_equal_union_find(spark, n, m):
    rng = random.Random(n)
    pairs = [(f"v{rng.randrange(n):03d}", f"v{rng.randrange(n):03d}") for _ in range(m)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(30)] + [(None, "x"), ("y", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert set(map(tuple, graph.components(df).collect())) == union_find(pairs)
    assert graph.components(df.limit(0)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    n = 4000
    pairs = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(n)] + [("hub", f"leaf{i}") for i in range(n)]
    got = spark.createDataFrame(pairs, "a string, b string").transform(graph.components)
    assert {tuple(r) for r in got.groupBy("component").count().collect()} == {("c00000", n + 1), ("hub", n + 1)}


def test_scenario_is_found(spark):
    got = evals.evaluate(evals.scenario(spark))
    assert got["ari"] > 0.9 and got["nmi"] > 0.9 and got["technique_f1"] == 1.0 and got["chain_similarity"] > 0.9 and got["alert_reduction"] == 0.8


def test_incident_and_campaigns(spark):
    rows = [event("e1", "failed password", 0, actor="m", host="h", cls=3002, severity=4), event("e2", "bash", 100, actor="m", host="h", cls=1007, severity=3), event("e3", "flow", 200, actor="m", host="h", cls=4001), event("far", "x", 10**12, actor="m", host="h", cls=4001), event("f1", "x", 0, host="z"), event("f2", "x", 5, host="z")]
    df = spark.createDataFrame(rows, DDL)
    rated, members = cp.campaigns(df)
    assert [(r.campaign, r.n_events, r.n_classes, r.n_links) for r in rated.collect()] == [("e1", 3, 3, 3)]
    assert cp.campaigns(df, cross_domain=False)[0].count() == 2
    edges = cp.causal_edges(members, df)
    assert {(r.src, r.dst) for r in edges.collect()} == {("e1", "e2"), ("e2", "e3")} and "shares host:h, user:m" in edges.first().reason
    tech = spark.createDataFrame([("e1", "T1110")], "id string, technique string")
    for way in ("beam", "greedy"):
        r = cp.incidents(cp.chains(members, df, edges, way), df, edges, tech).first()
        assert (r.n_steps, r.chain, r.techniques) == (3, "e1,e2,e3", "T1110") and 0 < r.confidence < 1 and len(r.explanation.split("\n")) == 2
    empty = df.limit(0)
    assert cp.campaigns(empty)[0].count() == 0 and cp.semantic_links(cp.embedded(empty), M).count() == 0
    links = cp.semantic_links(cp.embedded(df), 30 * M, 0.9)
    assert ("f1", "f2") in {(r.a, r.b) for r in links.collect()}


def heaviest(anomaly, out):
    best = (None, -1.0)

    def walk(path, score):
        nonlocal best
        if score > best[1]:
            best = (path, score)
        for j, w in out[path[-1]]:
            walk([*path, j], score + w + 0.1 * anomaly[j])

    for i, a in enumerate(anomaly):
        walk([i], 0.1 * a)
    return best


def test_paths():
    assert cp.beam([], []) == ([], 0.0) and cp.greedy([], []) == ([], 0.0)
    assert cp.beam([0.5, 0.5], [[], []])[0] == [1]
    rng = random.Random(2)
    for _ in range(20):
        n = 7
        anomaly = [rng.random() for _ in range(n)]
        out = [[(j, rng.random()) for j in range(i + 1, n) if rng.random() < 0.5] for i in range(n)]
        want = heaviest(anomaly, out)
        assert abs(cp.beam(anomaly, out, 50)[1] - want[1]) < 1e-9 and cp.greedy(anomaly, out)[1] <= want[1] + 1e-9


def test_templates(spark):
    got = templates.mine(["user ann from 1", "user bob from 2", "one", "user x y z w", "", "user eve from 3"])
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 1] and got[1][1:] == ("user <*> from <*>", ["bob", "2"]) and got[5][2] == ["eve", "3"]
    rows = [(f"login of {u} from {i}", i) for i, u in enumerate(["a", "b", "c"] * 20)] + [("disk full", 5), ("disk full", 6), (None, 7), ("", 8), ("x " * 5000, 9)]
    assigned, kinds = templates.mine_table(spark.createDataFrame(rows, "message string, ts bigint"))
    by = {r.template: r.n for r in kinds.collect()}
    assert by["login of <*> from <*>"] == 60 and by["disk full"] == 2 and len(by) == 4 and assigned.agg(F.sum("n")).first()[0] == 64
    assert templates.mine_table(spark.createDataFrame([], "message string, ts bigint"))[1].count() == 0
    many, few = templates.mine_table(spark.createDataFrame(rows, "message string, ts bigint"), shard_rows=7)[1], kinds
    assert {tuple(r) for r in many.collect()} == {tuple(r) for r in few.collect()}


def test_templates_of_a_table_equal_the_sequential_ones(spark):
    from conftest import SMALL
    from huntframe.schema import events

    rows = events(spark, SMALL).where("message is not null").groupBy("message").agg(F.min("ts").alias("ts")).orderBy("ts", "message").collect()
    final = templates.Miner()
    at = [final.add(r.message.split()) for r in rows]
    want = {r.message: " ".join(final.templates[i]) for r, i in zip(rows, at)}
    assigned, kinds = templates.mine_table(events(spark, SMALL))
    names = {r.template_id: r.template for r in kinds.collect()}
    assert {r.message: names[r.template_id] for r in assigned.collect()} == want


def test_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(98, None), (99, [0.0] * 8)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = set()
    for i in range(0, 60, 20):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:5]
        want |= {(i, j) for j in order}
    got = vectors.exact_topk(df.where("vec_id % 20 = 0"), df, 5)
    assert {(r.id, r.other) for r in got.collect()} == want
    assert vectors.exact_topk(df.limit(0), df, 5).count() == 0


def test_measures(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 6), (1, 6)], "a int, b int")
    assert tuple(evals.cluster_metrics(df, "a", "b").first()) == (1.0, 1.0)
    mixed = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert tuple(evals.cluster_metrics(mixed, "a", "b").first()) == (-0.5, 0.0)
    r = evals.precision_recall(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, t boolean"), "p", "t").first()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)
    assert evals.set_scores({1, 2}, {2, 3})[2] == 0.5 and evals.set_scores(set(), set()) == (0, 0, 0) and evals.alert_reduction(4, 1) == 0.75
    assert evals.edit_distance(list("abcd"), list("acbd")) == 2 and evals.chain_similarity([], []) == 1.0
    assert evals.mean_interval([1.0]) == (1.0, 0.0) and abs(evals.mean_interval([1.0, 2.0, 3.0])[1] - 4.303 / 3**0.5) < 1e-3
    assert list(itertools.islice(evals.T95, 2)) == [12.706, 4.303]
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", None)] + [("d", float(i)) for i in range(40)], "k string, v double")
    got = {r.k: (r.n, r.mean, r.half_width) for r in evals.intervals(v, ["k"], "v").collect()}
    for k, values in (("a", [1.0, 2.0, 3.0]), ("b", [5.0]), ("d", [float(i) for i in range(40)])):
        assert got[k][0] == len(values) and np.allclose(got[k][1:], evals.mean_interval(values))
    assert set(got) == {"a", "b", "d"}
    chains = [(list("abcd"), list("acbd")), ([], []), (list("ab"), []), (list("aaz"), list("aay"))]
    rows = spark.createDataFrame(chains, "a array<string>, b array<string>").select(evals.sequence_similarity(F.col("a"), F.col("b"), list("abcd")).alias("s")).collect()
    assert [r.s for r in rows] == [0.5, 1.0, 0.0, 1.0]


def cosines(rows):
    from huntframe.functions.scores import dense

    x = np.concatenate([dense(np.asarray(r.places or [], np.int64), np.array([len(r.places or [])])) for r in rows])
    n = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return (x / n) @ (x / n).T


def test_campaigns_cover_all_events_and_hosts(spark):
    import __spark_entry__
    from conftest import SMALL
    from huntframe.schema import unique_events

    rows = cp.embedded(unique_events(spark, SMALL)).withColumn("keys", F.array_distinct(graph.entity_keys())).orderBy("ts", "id").collect()
    cos, ts = cosines(rows), np.array([r.ts for r in rows])
    near = np.abs(ts[:, None] - ts[None, :]) <= 30 * M
    shared = [(i, j) for i in range(len(rows)) for j in range(i + 1, min(i + 400, len(rows))) if near[i, j] and set(rows[i].keys) & set(rows[j].keys)]
    assert sum("host:gw-core-01" in rows[i].keys and "host:gw-core-01" in rows[j].keys for i, j in shared) > 1
    similar = set()
    for i in range(len(rows)):
        best = sorted((-round(cos[i, j], 9), rows[j].id, j) for j in np.flatnonzero(near[i] & (cos[i] >= 0.5 - 1e-9)) if j != i)[:10]
        similar |= {(min(i, j), max(i, j)) for _, _, j in best}
    links = set(shared) | similar
    assert similar and any(rows[i].severity_id < 4 and rows[j].severity_id < 4 for i, j in similar)
    groups: dict = {}
    for i, c in union_find([(rows[i].id, rows[j].id) for i, j in links]):
        groups.setdefault(c, set()).add(i)
    kind = {r.id: r.ocsf_class for r in rows}
    of = {i: c for c, g in groups.items() for i in g}
    count, total = {}, {}
    for i, j in links:
        c = of[rows[i].id]
        count[c], total[c] = count.get(c, 0) + 1, total.get(c, 0.0) + cos[i, j]
    want = {(c, len(g), count[c], round(len({kind[i] for i in g}) + (len(g) - 1) * 0.5 + max(0, total[c] / count[c]), 4)) for c, g in groups.items() if len({kind[i] for i in g}) > 1}
    got = __spark_entry__.queries()["campaigns"](spark, SMALL).collect()
    assert {(r.campaign, r.n_events, r.n_links, round(r.score, 4)) for r in got} == want
    assert [(r.score, r.campaign) for r in got] == sorted(((r.score, r.campaign) for r in got), key=lambda x: (-x[0], x[1]))
    linked = {(r.a, r.b) for r in __spark_entry__.queries()["semantic_links"](spark, SMALL).collect()}
    every = np.abs(ts[:, None] - ts[None, :]) <= 360 * M
    assert linked == {(rows[i].id, rows[j].id) for i, j in zip(*np.nonzero(np.triu(every & (cos >= 0.5 - 1e-9), 1)))}


def test_shared_pairs_over_batches_and_spans(spark):
    rng = random.Random(4)
    rows = [("c", f"e{i:03d}", rng.randrange(60 * M), rng.sample(["a", "b", "d"], rng.randrange(1, 4)), [rng.choice([-1, 1]) * rng.randrange(1, 9) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "campaign string, id string, ts bigint, keys array<string>, vec array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = cp.shared_pairs(df, 2 * M).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    from huntframe.functions.scores import dense

    x = np.concatenate([dense(np.asarray(r[4]), np.array([4])) for r in rows])
    norm = np.linalg.norm(x, axis=1)
    want = [(x[i] @ x[j]) / (norm[i] * norm[j]) if norm[i] * norm[j] else 0.0 for i, j in itertools.combinations(range(200), 2) if abs(rows[i][2] - rows[j][2]) <= 2 * M and set(rows[i][3]) & set(rows[j][3])]
    assert (got.n, round(got.sim, 9)) == (len(want), round(sum(want), 9)) and len(want) > 300


def test_first_technique_in_the_order_of_rules(spark):
    from huntframe.operators import rules

    df = spark.createDataFrame([event("a", "x y")], DDL)
    listed = [rules.Rule(n, {"s": [w], "condition": "s"}, tags=[t] if t else []) for n, w, t in (("r0", "x", None), ("r1", "y", "attack.t1552"), ("r2", "x", "attack.t1003"))]
    found = rules.techniques(df, listed)
    assert [tuple(r) for r in found.orderBy("place").collect()] == [("a", "T1552", 1), ("a", "T1003", 2)]
    members = spark.createDataFrame([("a", "a")], "campaign string, id string")
    edges = cp.causal_edges(members, df)
    assert cp.incidents(cp.chains(members, df, edges), df, edges, found).first().techniques == "T1552"


def test_paths_of_a_large_campaign_are_linear():
    n = 100_000
    out = [[(j, 0.5) for j in (i + 1, i + 2) if j < n] for i in range(n)]
    assert cp.beam([0.2] * n, out)[0] == list(range(n)) and cp.greedy([0.2] * n, out)[0] == list(range(n))


def similar_pairs(rows, window, threshold):
    return {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows, key=lambda r: (r[1], r[0])), 2) if b[1] - a[1] <= window and np.dot(a[2], b[2]) >= threshold - 1e-9}


def random_vectors(times, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(len(times), 128)) + 1.2 * rng.normal(size=(3, 128))[rng.integers(0, 3, len(times))]
    return [(f"e{i:03d}", t, [float(c) for c in v / np.linalg.norm(v)]) for i, (t, v) in enumerate(zip(times, x))]


def test_similar_links_equal_brute_force(spark):
    rows = random_vectors([i * 1000 for i in range(150)])
    got = cp.semantic_links(spark.createDataFrame(rows, "id string, ts bigint, vec array<double>"), M, 0.5, block=40)
    want = similar_pairs(rows, M, 0.5)
    found = [(r.a, r.b) for r in got.collect()]
    assert len(want) > 1000 and set(found) == want and len(found) == len(want)


def test_similar_links_cross_bucket_borders(spark):
    rng = random.Random(3)
    rows = random_vectors([rng.randrange(6 * M) for _ in range(150)], 6)
    got = cp.semantic_links(spark.createDataFrame(rows, "id string, ts bigint, vec array<double>"), M, 0.5, block=10)
    want = similar_pairs(rows, M, 0.5)
    time = {i: t // M for i, t, _ in rows}
    found = [(r.a, r.b) for r in got.collect()]
    assert any(time[a] != time[b] for a, b in want) and set(found) == want and len(found) == len(want)
