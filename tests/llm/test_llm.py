"""The training-data operators: brute force, exact round trips, held-out accuracy, defined cases."""

import base64
import random

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from huntframe.llm import bpe, components, knn, packing, queries, reading

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Components


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


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(5)
    pairs = {
        "random": [(f"v{rng.randrange(300):03d}", f"v{rng.randrange(300):03d}") for _ in range(260)] * 2,
        "chain": [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(400)] + [("z", "z"), (None, "q"), ("r", None)],
        "star": [("hub", f"s{i:03d}") for i in range(300)] + [("a", "b")],
        "empty": [],
    }[shape]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(*p, "x") for p in pairs], "a string, b string, center string")
    assert set(map(tuple, components.components(df).collect())) == union_find(pairs)


def test_linked_events(spark):
    links = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "b", "unknown"), (3, None, "c"), (4, "c", "c"), (None, "d", "e")], "link_id bigint, event_a string, event_b string")
    lists = spark.createDataFrame([(1, ["e", "nowhere", "f", "f"]), (2, None), (3, []), (4, ["g"]), (5, ["h", None, "i"])], "campaign_id bigint, events array<string>")
    known = spark.createDataFrame([(x,) for x in "abcdefghij"] + [("a",), (None,)], "id string")
    got = set(map(tuple, components.components(components.linked_events(links, lists, known)).collect()))
    assert got == {("a", "a"), ("b", "a"), ("d", "d"), ("e", "d"), ("f", "d"), ("h", "h"), ("i", "h")}


def test_p5_equals_oracle(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("segment_events", "campaign_links", "campaigns"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = set(con.execute(queries.ORACLE["p5_found"]).df().itertuples(index=False, name=None))
    assert set(map(tuple, queries.p5_found(spark, SMALL).collect())) == want


# Neighbours


def brute_neighbours(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(ids)):
        others = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out |= {(ids[i], ids[j]) for j in others[: k[i]]}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, vec array<float>, knn int, leaf int, cid string")


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[10:40] = x[5]  # a third of all rows are copies
    k = [3] * 90
    rows = [(i, [float(v) for v in r], 3, 7, "x") for i, r in enumerate(x)]
    rows += rows[:5] + [(100, None, 3, 0, ""), (101, [0.0] * 8, 3, 0, ""), (102, [1.0] * 7, 3, 0, ""), (103, [float("nan")] * 8, 3, 0, ""), (None, [1.0] * 8, 3, 0, ""), (104, [float("inf")] + [1.0] * 7, 3, 0, "")]
    got = {(r.id, r.other) for r in knn.neighbours(frame(spark, rows), 8).collect()}
    want = brute_neighbours(list(range(90)), x.astype(np.float64), k)
    assert got == want


def test_wanted_numbers(spark):
    rows = [(i, [float(i + 1), 1.0], [None, 0, 1, 20, -1][i % 5], 0, "") for i in range(12)]
    got = pd.DataFrame([(r.id, r.other) for r in knn.neighbours(frame(spark, rows), 2).collect()], columns=["id", "other"]).groupby("id").size().to_dict()
    assert got == {i: {0: 10, 2: 1, 3: 11}[i % 5] for i in range(12) if i % 5 in (0, 2, 3)}
    for empty in (rows[:0], [(1, [1.0, 2.0], 0, 0, "")], [(1, [1.0, 2.0], 5, 0, "")]):
        assert knn.neighbours(frame(spark, empty), 2).count() == 0


def test_recall_of_the_tree(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(200, 16))
    x = (centers[rng.integers(0, 200, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = frame(spark, [(i, [float(v) for v in r], 5, 0, "") for i, r in enumerate(x)])
    got = {(r.id, r.other) for r in knn.neighbours(df, 16, leaf_rows=64).collect()}
    want = brute_neighbours(list(range(3000)), x.astype(np.float64), [5] * 3000)
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)


def test_full_leaves_are_cut_into_balls_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = (centers[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 16))).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = knn.Members(np.arange(1500), unit).answer(unit[:200], np.full(200, 0.8), 6)
    monkeypatch.setattr(knn, "BLOCK", 128)
    cut = knn.Members(np.arange(1500), unit)
    got = cut.answer(unit[:200], np.full(200, 0.8), 6)
    assert len(cut.balls) > 10 and all(np.array_equal(a, b) for a, b in zip(got, want))


def test_ranges_that_need_more_visits_take_all_leaves(spark, monkeypatch):
    monkeypatch.setattr(knn, "MOST_VISITS", 3)
    x = np.random.default_rng(1).normal(size=(1200, 12)).astype(np.float32)  # nothing to cluster: few visits find little
    df = frame(spark, [(i, [float(v) for v in r], 5, 0, "") for i, r in enumerate(x)])
    got = {(r.id, r.other) for r in knn.neighbours(df, 12, leaf_rows=40).collect()}
    want = brute_neighbours(list(range(1200)), x.astype(np.float64), [5] * 1200)
    assert len(got & want) >= 0.99 * len(want)


def test_a_collection_far_larger_than_its_sample(spark, monkeypatch):
    monkeypatch.setattr(knn, "TRAIN_SAMPLE", 64)  # as if the collection were far larger than its sample
    rng = np.random.default_rng(5)
    centers, sizes = rng.normal(size=(20, 8)), (500, 5000)
    monkeypatch.setattr(knn, "BLOCK", 64)
    for n in sizes:
        x = (centers[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, 8))).astype(np.float32)
        df = frame(spark, [(i, [float(v) for v in r], 3, 0, "") for i, r in enumerate(x)])
        got = {(r.id, r.other) for r in knn.neighbours(df, 8, leaf_rows=16).collect()}
        want = brute_neighbours(list(range(n)), x.astype(np.float64), [3] * n)
        assert len(got & want) >= 0.97 * len(want)


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(0)
    t = knn.Tree(rng.normal(size=(2000, 8)).astype(np.float32), 0.02)
    v = t.visit(rng.normal(size=(50, 8)).astype(np.float32), t.leaves)
    assert t.leaves > 30 and all(len(set(r)) == t.leaves for r in v.tolist())
    few = t.visit(rng.normal(size=(3, 8)).astype(np.float32), np.array([0, 1, 5]))
    assert [(r >= 0).sum() for r in few] == [0, 1, 5]
    assert knn.Tree(np.ones((500, 4), np.float32), 0.01).leaves == 1


def test_p7_recall(spark):
    v = pd.read_parquet(f"{SMALL}/event_vectors.parquet").drop_duplicates("vec_id")
    v = v[v.vec.map(lambda a: a is not None and len(a) == 64)]
    x = np.stack(v.vec.values).astype(np.float64)
    ok = np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0)
    want = {(min(a, b), max(a, b)) for a, b in brute_neighbours(v.vec_id[ok].tolist(), x[ok], v.knn.fillna(10).astype(int)[ok].tolist())}
    got = set(map(tuple, queries.p7_found(spark, SMALL).collect()))
    assert len(got & want) >= 0.98 * len(want)


# Tokens


def test_ids_equal_the_library(spark, tiktoken_encoding):
    texts = pd.read_parquet(f"{SMALL}/documents.parquet").set_index("doc_id").text
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, SMALL).collect()}
    assert got == {i: tiktoken_encoding.encode_ordinary(t) if t else [] for i, t in texts.items()}


TEXTS = [None, "", " ", "\n\n  x", "<|endoftext|> plain", "don't we'll I'M", "naïve café — 中文 текст 🙂🏽", "a" * 300_000, "\x1c\x1d odd \x85\xa0 spaces ", "tab\tand\r\nlines \r\n ", "0123456789" * 1000, "=" * 5000, "﻿mark", " " * 10_000 + "end"]


def test_defined_texts(spark, tiktoken_encoding):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] * 2, "doc_id bigint, text string, ids string, n_tokens int")
    want = {i: tiktoken_encoding.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    got = [(r.doc_id, r.ids) for r in bpe.encode(df, VOCABULARY).collect()]
    assert dict(got) == want and len(got) == 2 * len(TEXTS)
    assert {r.doc_id: r.n_tokens for r in bpe.lengths(df, VOCABULARY).collect()} == {i: len(x) for i, x in want.items()}
    assert bpe.encode(df.limit(0), VOCABULARY).count() == 0
    assert all(tiktoken_encoding.decode(want[i]) == t for i, t in enumerate(TEXTS) if t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(tiktoken_encoding, text):
    e = bpe.Encoder(VOCABULARY)
    assert e.encode([text])[0].tolist() == tiktoken_encoding.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdeilnorst é中 0", min_size=1, max_size=40), min_size=1, max_size=30))
def test_speculation_equals_exact_merging(parts):
    t = bpe.tables(VOCABULARY)
    assert t.encode_words(parts) == [tuple(t.merge([t.ids[bytes([c])] for c in w.encode()])) for w in parts]


def test_the_vocabulary_is_shipped(spark):
    bpe.vocabulary(spark)
    gone = "/no/such/folder/" + VOCABULARY.rsplit("/", 1)[1]  # what an executor without the folder sees
    df = spark.createDataFrame([(1, "hello there")], "doc_id bigint, text string")
    assert bpe.encode(df, gone).first().ids == bpe.encode(df, VOCABULARY).first().ids


def test_known_words_are_bounded(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    e = bpe.Encoder(VOCABULARY)
    for text in ("one two three four", "five six seven eight nine", "one nine", " ".join(map(str, range(50)))):
        assert e.encode([text])[0].tolist() == tiktoken_encoding.encode_ordinary(text)


# Containers


def test_open_bins_fit_best():
    b = packing.OpenBins(10, 2)
    assert [b.place(s) for s in (6, 7, 3, 4, 9, 5, 5, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 5), (2, 9)]
    b = packing.OpenBins(10, 2)
    assert [b.place(s)[0] for s in (5, 6, 8, 2, 5)] == [0, 1, 2, 2, 0]  # the fullest was closed, the emptier stays


@pytest.mark.parametrize("open_bins", [1, 16, 256])
def test_packing_loses_nothing(spark, monkeypatch, open_bins):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 5, 40, 64, 100, 129, 700]) for _ in range(2000)] + [None, 10_000, 64, 64]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container_id string")
    monkeypatch.setattr(packing, "SHARD_ITEMS", 600)
    got = packing.pack(df, 64, open_bins).toPandas()
    used = got.groupby("container_id")["size"].sum()
    assert used.max() <= 64 and got.groupby("doc_id")["size"].sum().to_dict() == {i: s for i, s in enumerate(sizes) if s}
    assert (got.groupby("doc_id").size() == pd.Series({i: -(-s // 64) for i, s in enumerate(sizes) if s})).all()
    for _, c in got.sort_values("position").groupby("container_id"):
        assert (c.position.to_numpy() == np.concatenate([[0], np.cumsum(c["size"])[:-1]])).all()
    for _, parts in got.sort_values("part_no").groupby("doc_id"):
        assert (parts["first"].to_numpy() == np.concatenate([[0], np.cumsum(parts["size"])[:-1]])).all()
    assert packing.pack(df.limit(0), 64).count() == 0


def test_the_bound_of_open_containers_binds():
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [n % queries.CAPACITY for n in bpe.Encoder(VOCABULARY).count(d.text.tolist()).tolist() if n % queries.CAPACITY]
    bins, most = packing.OpenBins(queries.CAPACITY, 8), 0
    for s in sizes:
        bins.place(s)
        most = max(most, bins.open)
    assert most == 8 and bins.closed > 0
    assert sum(sizes) >= 0.95 * bins.made * queries.CAPACITY


def test_p9_fills_containers(spark):
    r = packing.fill(queries.p9_packed(spark, SMALL), queries.CAPACITY).first()
    assert r.tokens == bpe.lengths(spark.read.parquet(f"{SMALL}/documents.parquet"), VOCABULARY).agg(F.sum("n_tokens")).first()[0]
    assert r.containers <= 1.1 * r.tokens / queries.CAPACITY + 1


# Reading level


def test_prose():
    easy = "Keep the key in a safe place. Do not open the door. Then test it."
    assert reading.prose(easy)[0] == 3 and reading.prose("- Keep the key here\n- Do not open it now\n- Then test it again")[0] == 3
    assert reading.prose("The door is shut for now, and then we call the guard at the gate. It took a day to fix the lock.")[0] == 3
    assert reading.prose("We keep the keys, the locks, and the doors shut, and so on. Do not open it.")[0] == 2
    for other in ("", "ok", "see above", "a1b2c3d4e5\nd4e5f6a7b8\nffeeddccbb", "host: web01\nport: 22\nmode: on", "2025-06-02T21:46:29Z mail-03 postfix[243]: RotateKey called", "Der Schlüssel liegt im Schrank. Bitte die Tür nicht öffnen. Danach noch einmal prüfen.", "Cierre la puerta por favor. No abra este archivo nunca. Luego pruebe otra vez."):
        assert reading.prose(other)[0] < 3
    assert reading.prose("The key is in the box. " * 50_000)[0] == 50_000


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    found = reading.levels(docs, labels.where(half == 0))
    test = labels.where(half == 1).groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    r = found.join(test, "doc_id").agg(F.avg((F.abs(F.col("reading_level") - F.col("grade")) <= 0.5).cast("int")), F.avg((F.abs(F.col("reading_level") - F.col("grade")) <= 1).cast("int"))).first()
    assert r[0] >= 0.75 and r[1] >= 0.97  # graders themselves are one step off in a tenth of the cases


def test_levels_are_settled_and_joins_compute_the_same(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    level = lambda **kw: {r.doc_id: (r.reading_level, r.difficulty) for r in reading.levels(docs, labels, **kw).collect()}
    settled, longer, joined = level(), level(residual=reading.RESIDUAL / 1000), level(in_arrays=0)
    assert {k: v[0] for k, v in settled.items()} == {k: v[0] for k, v in longer.items()} == {k: v[0] for k, v in joined.items()}
    assert max(abs(settled[k][1] - joined[k][1]) for k in settled) < 1e-9


def test_levels_of_odd_tables(spark):
    ddl = "doc_id bigint, text string, buckets string, grade string"
    text = "Keep the key in a safe place. Do not open the door. Then test it again."
    docs = spark.createDataFrame([(1, text, "", ""), (1, text, "", ""), (2, None, "", ""), (3, "", "", ""), (4, "zig zag of it. zog zug of it. zeg zyg of it.", "", ""), (None, text, "", "")], ddl)
    labels = spark.createDataFrame([(1, "g", 2), (1, "h", 2), (9, "g", 5), (2, "g", None)], "doc_id bigint, grader string, reading_level int")
    got = sorted(((r.doc_id or 0), r.reading_level) for r in reading.levels(docs, labels).collect())
    assert [g[0] for g in got] == [0, 1, 1, 4] and {g[1] for g in got} <= {1, 2, 3, 4, 5}
    assert sorted(((r.doc_id or 0), r.reading_level) for r in reading.levels(docs, labels, in_arrays=0).collect()) == got
    assert reading.levels(docs, labels.limit(0)).count() == 0 and reading.levels(docs.limit(0), labels).count() == 0


def test_cuts():
    at = reading.cuts(np.array([1.0, 1.1, 2.0, 2.2, 3.1, 4.0, 4.9]), np.array([1, 1, 2, 2, 3, 4, 5.0]))
    assert list(1 + np.searchsorted(at, [1.05, 2.1, 3.0, 4.1, 5.0])) == [1, 2, 3, 4, 5] and (np.diff(at) >= 0).all()
