"""The most similar vectors of every vector, through a hierarchical k-means tree.

The tree is grown by k-means on a bounded sample; every vector is then indexed in the leaf
whose centre is nearest. A query meets leaves in best-bin-first order: a priority queue, kept
as one key matrix for a whole batch of queries, holds nodes by the distance to their centre;
the nearest is popped, inner nodes push their children, leaves are visits. How many leaves to
visit is calibrated: the exact neighbours of a sample of queries are found by a blocked scan
of all vectors, and visits are widened until the leaves visited hold the wanted share of them.
Every query first visits a few leaves; the k-th cosine that it found there tells how far it is
widened, as queries in thin places need many leaves and most need few. A range of queries that
``MOST_VISITS`` leaves do not satisfy visits all leaves, which is exact.

Queries are then sent to the leaves they visit, where the members come first and the queries
stream past them, so a task holds one block of members and one batch of queries however many
queries a leaf draws. The members of a full leaf are cut by k-means into balls there and then:
a query skips a ball if the triangle inequality shows that nothing in it can reach what the
query has already. Each block answers with its best few and the answers of a query are merged.

Exact copies are one class in the index; a class stands for the smallest ids among its copies,
as many as a query can ask for, found by a rank limit that works before the shuffle. Thus a
crowd of copies costs its rows and no pairs between them.

Defined cases: vectors that are null, all zero, of another size or not finite take no part;
repeated ids count once (the greatest vector by order holds if copies differ); a null k is 10,
k below one asks for nothing; ties in the rounded cosine go to the smaller id; fewer vectors
than k give all there are; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from huntframe.session import Stages

#: Vectors that the tree is trained on, at most (64 numbers each: 17 MB on the driver).
TRAIN_SAMPLE = 65_536
#: Queries whose neighbours are found exactly to calibrate the visits.
CALIBRATION = 1_024
#: Cells of a batch's matrix of keys (32 MB), and visits beyond which a range of queries takes all leaves.
KEYS, MOST_VISITS = 8_000_000, 2_048
#: Leaves that every query visits before it is decided how far to widen, and ranges to decide by.
FIRST_VISITS, RANGES = 2, 12
#: Rows of one product, and members that a task holds of a leaf (17 MB of floats).
BLOCK, HELD = 4_096, 65_536
#: What single precision may lose of a cosine.
SLACK = 4e-6

log = logging.getLogger(__name__)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = _nearest(x, centers)
        n = np.bincount(near, minlength=k)
        empty = n == 0
        starts = (np.cumsum(n) - n)[~empty]
        centers[~empty] = np.add.reduceat(x[np.argsort(near, kind="stable")], starts, axis=0, dtype=np.float64) / n[~empty][:, None]
        if empty.any():
            centers[empty] = x[rng.choice(len(x), int(empty.sum()), replace=False)]
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, less the squared length of x, which changes no order."""
    return (centers**2).sum(1) - 2 * (x @ centers.T)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return _distances(x, centers).argmin(1)


class Tree:
    """Nodes with centres; ``children[i]`` is a range of nodes, empty for leaves."""

    def __init__(self, sample: np.ndarray, leaf_share: float, branch: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centers = [sample.mean(0) if len(sample) else np.zeros(0, np.float32)]
        self.children: list[tuple[int, int]] = [(0, 0)]
        most = max(2.0, leaf_share * len(sample))
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= most:
                continue
            k = int(min(branch, max(2, np.ceil(len(rows) / most))))
            centers = _kmeans(sample[rows], k, rng)
            near = _nearest(sample[rows], centers)
            if np.bincount(near, minlength=k).max() == len(rows):
                continue  # points that can't be told apart stay in one leaf
            self.children[node] = (len(self.centers), len(self.centers) + k)
            for c in range(k):
                self.centers.append(centers[c])
                self.children.append((0, 0))
                todo.append((self.children[node][0] + c, rows[near == c]))
        self.centers = np.stack(self.centers).astype(np.float32)
        self.inner = np.array([b > a for a, b in self.children])
        self.leaves = int((~self.inner).sum())

    def visit(self, x: np.ndarray, count: int | np.ndarray) -> np.ndarray:
        """The first leaves of each query in best-bin-first order, as (queries, greatest count).

        ``count`` may differ by query; places beyond it hold -1. The key matrix of a batch is
        kept within KEYS cells, so large trees are visited by smaller batches.
        """
        count = np.minimum(np.broadcast_to(count, len(x)), self.leaves)
        batch = max(1, KEYS // len(self.centers))
        if len(x) > batch:
            parts = [self.visit(x[a : a + batch], count[a : a + batch]) for a in range(0, len(x), batch)]
            wide = max(p.shape[1] for p in parts)
            return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1])), constant_values=-1) for p in parts])
        out = np.full((len(x), int(count.max(initial=1))), -1, dtype=np.int32)
        keys = np.full((len(x), len(self.centers)), np.inf, dtype=np.float32)
        keys[:, 0] = 0
        found = np.zeros(len(x), dtype=np.int64)
        live = np.flatnonzero(count > 0)
        while len(live):
            node = (keys if len(live) == len(x) else keys[live]).argmin(1)
            keys[live, node] = np.inf
            leaf = ~self.inner[node]
            at = live[leaf]
            out[at, found[at]] = node[leaf]
            found[at] += 1
            for p in np.unique(node[~leaf]):
                who = live[node == p]
                a, b = self.children[p]
                keys[who, a:b] = _distances(x[who], self.centers[a:b])
            live = live[found[live] < count[live]]
        return out


def prepare(vectors: DataFrame, dim: int, id_: str = "vec_id", vec: str = "vec", k: str = "knn", default_k: int = 10) -> DataFrame:
    """``(id, k, h1, h2, vec)``: valid vectors once each; h1 and h2 name the class of exact copies."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0) & F.col(id_).isNotNull())
    v = F.col(vec).cast("array<float>")
    rows = good.groupBy(F.col(id_).alias("id")).agg(F.max(F.struct(v.alias("vec"), F.coalesce(k, F.lit(default_k)).cast("int").alias("k"))).alias("r"))
    return rows.select("id", "r.k", F.xxhash64("r.vec").alias("h1"), F.xxhash64(F.lit(1), "r.vec").alias("h2"), "r.vec")


def _unit(raw: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors in double from the bytes of floats."""
    x = np.frombuffer(b"".join(raw.tolist()), dtype=np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrays of floats as bytes, which travel and stack faster."""
    for f in frames:
        yield f.assign(vec=[np.asarray(v, dtype=np.float32).tobytes() for v in f.vec])


def _best(score: np.ndarray, cid: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of scores the places of the first by score and class id, in that order."""
    want = min(want, score.shape[1])
    least = -np.partition(-score, want - 1, axis=1)[:, want - 1 : want]
    i, j = np.nonzero(score >= least)  # ties at the end included
    return _first(i, j, score[i, j], cid, want, len(score))[:2]


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, cid: np.ndarray, want: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored places the first of each of ``n`` rows by score and class id."""
    order = np.lexsort((cid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i] < want
    return i[keep], j[keep], score[keep]


class Members:
    """The members of a leaf block, in balls of about BLOCK members with a centre and a radius."""

    def __init__(self, cid: np.ndarray, unit: np.ndarray):
        self.cid, self.unit, self.single = cid, unit, unit.astype(np.float32)
        self.balls = [(np.arange(len(cid)), None, np.inf)]
        if len(cid) > BLOCK:
            k = -(-len(cid) // (BLOCK // 2))
            rng = np.random.default_rng(7)
            centers = _kmeans(self.single[rng.choice(len(cid), min(len(cid), 64 * k), replace=False)], k, rng)
            near = _nearest(self.single, centers)
            rows = [np.flatnonzero(near == c) for c in range(k)]
            self.balls = [(r, centers[c], float(np.linalg.norm(unit[r] - centers[c], axis=1).max())) for c, r in enumerate(rows) if len(r)]

    def answer(self, unit: np.ndarray, least: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, class id, cosine)``: each query's first members, as far as they reach what it has already."""
        single, found = unit.astype(np.float32), []
        reach = np.sqrt(np.maximum(0, 2 - 2 * (least - SLACK)))  # the distance at which the cosine is still enough
        for rows, center, radius in self.balls:
            who = np.arange(len(unit)) if center is None else np.flatnonzero(np.linalg.norm(unit - center, axis=1) - radius <= reach + 1e-6)
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                if not len(who):
                    break
                s = single[who] @ self.single[part].T
                floor = least[who]
                if want < s.shape[1] and (floor < -1).any():
                    floor = np.maximum(floor, -np.partition(-s, want - 1, axis=1)[:, want - 1])
                i, j = np.nonzero(s >= (floor - SLACK)[:, None])
                i, j = who[i], part[j]
                score = np.round(np.einsum("ij,ij->i", unit[i], self.unit[j]), 6)
                keep = score >= least[i]
                found.append((i[keep], j[keep], score[keep]))
        i, j, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        i, j, score = _first(i, j, score, self.cid, want, len(unit))
        return i, self.cid[j], score


def _exact(classes: DataFrame, queries: np.ndarray, most: int) -> DataFrame:
    """``(q, cid, leaf, score)``: the best classes of each of a few queries, by a scan in blocks."""
    dim = queries.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), BLOCK):
                part = f.iloc[a : a + BLOCK]
                s = np.round(queries @ _unit(part.vec, dim).T, 6)
                i, j = _best(s, part.cid.to_numpy(), most)
                yield pd.DataFrame({"q": i, "cid": part.cid.to_numpy()[j], "leaf": part.leaf.to_numpy()[j], "score": s[i, j]})

    return classes.select("cid", "leaf", "vec").mapInPandas(run, "q int, cid bigint, leaf int, score double")


def calibrated(tree: Tree, classes: DataFrame, near: DataFrame, dim: int, most: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """How far to widen: upper ends of ranges of the k-th cosine found so far, and visits for each.

    A sample of queries is compared with all vectors. The visits of a range are widened until
    the leaves visited hold the wanted share of the true neighbours of its queries.
    """
    some = classes.where("k > 0").orderBy(F.xxhash64(F.lit(2), "cid")).limit(CALIBRATION).select("cid", "k", "vec")
    some = some.join(near.select("cid", "least"), "cid").toPandas()
    queries = _unit(some.vec, dim)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    truth = _exact(classes, queries, most + 1).withColumn("r", F.row_number().over(best)).where(F.col("r") <= most + 1).orderBy("q", "r").toPandas()
    truth = truth[truth.cid.to_numpy() != some.cid.to_numpy()[truth.q]]
    truth = truth[truth.groupby("q").cumcount().to_numpy() < some.k.to_numpy()[truth.q]]
    ends = np.unique(np.quantile(some.least, np.linspace(0, 1, RANGES + 1)[1:-1]))
    own = np.searchsorted(ends, some.least.to_numpy())
    leaf, range_, far = truth.leaf.to_numpy(), own[truth.q.to_numpy()], np.iinfo(np.int32).max
    visits, reached = np.full(len(ends) + 1, FIRST_VISITS), np.ones(len(ends) + 1)
    depth, limit = np.full(len(truth), far, dtype=np.int64), 32
    while True:  # how deep the true neighbours lie, as far as the ranges that are not satisfied need to know
        limit = min(limit, tree.leaves, MOST_VISITS)
        for at in range(0, len(queries), 256):
            order = tree.visit(queries[at : at + 256].astype(np.float32), limit)
            place = np.full((len(order), len(tree.centers)), far, dtype=np.int64)
            np.put_along_axis(place, order, np.arange(limit)[None, :], axis=1)
            mine = (truth.q.to_numpy() >= at) & (truth.q.to_numpy() < at + 256)
            depth[mine] = place[truth.q.to_numpy()[mine] - at, leaf[mine]]
        for r in range(len(visits)):
            d = np.sort(depth[range_ == r])
            need = int(d[max(0, int(np.ceil(recall * len(d))) - 1)]) + 1 if len(d) else FIRST_VISITS
            visits[r] = max(FIRST_VISITS, need) if need <= limit else tree.leaves
            reached[r] = (d < visits[r]).mean() if need <= limit and len(d) else 1.0
        if (visits <= limit).all() or limit == min(tree.leaves, MOST_VISITS):
            break
        limit *= 4
    log.info("visits by range %s, recall on the sample %s", visits.tolist(), reached.round(4).tolist())
    return ends, visits


def neighbours(vectors: DataFrame, dim: int, *, id_: str = "vec_id", vec: str = "vec", k: str = "knn", recall: float = 0.99, leaf_rows: int = 2048) -> DataFrame:
    """``(id, other, cosine)``: the k most similar vectors of every vector."""
    spark = vectors.sparkSession
    stages = Stages(spark, "knn")
    rows = stages.cut(prepare(vectors, dim, id_, vec, k), "rows")
    most = rows.agg(F.max("k")).first()[0]
    if most is None or most < 1:
        return spark.createDataFrame([], "id bigint, other bigint, cosine double")
    # The smallest ids of each class: one more than can be asked for, as a vector is not its own neighbour.
    ranked = rows.select("id", "h1", "h2").withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= most + 1)
    ids = stages.cut(ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ids")
    vecs = rows.groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.any_value("vec").alias("vec"), F.max("k").alias("k")).select("cid", "k", "vec")
    vecs = stages.cut(vecs.mapInPandas(_packed, "cid bigint, k int, vec binary"), "vecs")

    # Trained on the classes with the smallest hashes: a sample that a repeated task draws again.
    total = vecs.count()
    sample = vecs.orderBy(F.xxhash64("cid")).limit(TRAIN_SAMPLE).select("vec").toPandas()
    tree = Tree(_unit(sample.vec, dim).astype(np.float32), leaf_rows / total)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), BLOCK):
                part = f.iloc[a : a + BLOCK]
                yield part.assign(leaf=tree.visit(_unit(part.vec, dim).astype(np.float32), 1)[:, 0])

    classes = stages.cut(vecs.mapInPandas(index, "cid bigint, k int, vec binary, leaf int"), "classes")
    # Full leaves are dealt to blocks of members; the list of blocks has one entry per leaf.
    blocks = np.ones(len(tree.centers), dtype=np.int64)
    for leaf, n in classes.groupBy("leaf").count().collect():
        blocks[leaf] = -(-n // HELD)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries by the leaf blocks of their visits from ``lo`` to ``hi``; each class's own row is a member of one block."""
        for f in frames:
            for a in range(0, len(f), BLOCK):
                part = f.iloc[a : a + BLOCK]
                own = part.assign(block=part.cid.to_numpy() % blocks[part.leaf.to_numpy()], member=True)
                part = part[part.hi > part.lo]
                to = tree.visit(_unit(part.vec, dim).astype(np.float32), part.hi.to_numpy()) if len(part) else np.zeros((0, 1), np.int32)
                who, nth = np.nonzero((to >= 0) & (np.arange(to.shape[1])[None, :] >= part.lo.to_numpy()[:, None]))
                leaf = to[who, nth]
                times = blocks[leaf]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who, leaf = np.repeat(who, times), np.repeat(leaf, times)
                yield pd.concat([own, part.iloc[who].assign(leaf=leaf, block=block, member=False)], ignore_index=True)[["cid", "vec", "least", "leaf", "block", "member"]]

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's best members of each block; in a block members come first, and queries stream past them."""
        now, held, members = None, [], None
        for f in frames:
            place = f.leaf.to_numpy().astype(np.int64) << 32 | f.block.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(f)]
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                if b == a:
                    continue
                if place[a] != now:
                    now, held, members = place[a], [], None
                part = f.iloc[a:b]
                member = part.member.to_numpy()
                if member.any():
                    held.append(part[member])
                asking = part[~member]
                if not len(asking) or not held:
                    continue
                if members is None:
                    members = Members(np.concatenate([h.cid.to_numpy() for h in held]), np.concatenate([_unit(h.vec, dim) for h in held]))
                for at in range(0, len(asking), BLOCK // 4):
                    q = asking.iloc[at : at + BLOCK // 4]
                    i, other, score = members.answer(_unit(q.vec, dim), q.least.to_numpy(), most + 1)
                    cut = np.searchsorted(i, np.arange(len(q) + 1))
                    out += [(c, other[x:y], score[x:y]) for c, x, y in zip(q.cid.tolist(), cut[:-1].tolist(), cut[1:].tolist()) if y > x]
            yield pd.DataFrame(out, columns=["cid", "other", "cosine"])

    def asked(queries: DataFrame) -> DataFrame:
        routed = queries.select("cid", "vec", "leaf", "lo", "hi", "least").mapInPandas(route, "cid bigint, vec binary, least double, leaf int, block bigint, member boolean")
        met = routed.repartition("leaf", "block").sortWithinPartitions("leaf", "block", F.desc("member"))
        answers = met.mapInPandas(meet, "cid bigint, other array<bigint>, cosine array<double>")
        return answers.select("cid", F.zip_with("cosine", "other", lambda c, o: F.struct((-c).alias("far"), o.alias("other"))).alias("found"))

    def best(answers: DataFrame) -> DataFrame:
        return answers.groupBy("cid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, most + 1).alias("found"))

    first = classes.withColumns({"lo": F.lit(0), "hi": F.when(F.col("k") > 0, FIRST_VISITS).otherwise(0), "least": F.lit(-2.0)})
    # The k-th best so far, the query itself not counted: what a further visit has to reach.
    near = best(asked(first)).join(classes.select("cid", "k"), "cid").withColumn("least", F.coalesce(-F.get("found", F.col("k"))["far"], F.lit(-2.0)))
    near = stages.cut(near.select("cid", "found", "least"), "near")
    ends, visits = calibrated(tree, classes, near, dim, most, recall)
    wider = F.lit(int(visits[0]))
    for end, n in zip(ends, visits[1:]):
        wider = F.when(F.col("least") > float(end), int(n)).otherwise(wider)
    again = classes.join(near.select("cid", "least"), "cid", "left").withColumns({"lo": F.lit(FIRST_VISITS), "hi": F.when(F.col("least").isNotNull(), wider).otherwise(0)})
    merged = best(asked(again).unionByName(near.select("cid", "found")))

    copies = ids.where(F.size("ids") > 1).select(F.col("ids")[0].alias("first"), "ids")
    options = (
        merged.select("cid", F.explode("found").alias("n"))
        .join(copies, F.col("n.other") == F.col("first"), "left")
        .select("cid", F.explode(F.coalesce("ids", F.array("n.other"))).alias("other"), F.col("n.far").alias("far"))
        .groupBy("cid")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, most + 1).alias("options"))
    )
    asking = rows.select("id", "k", "h1", "h2").where("k > 0").join(ids.select("h1", "h2", F.col("ids")[0].alias("cid")), ["h1", "h2"])
    own = F.filter("options", lambda o: o["other"] != F.col("id"))
    return asking.join(options, "cid").select("id", F.explode(F.slice(own, F.lit(1), F.col("k"))).alias("o")).select("id", "o.other", (-F.col("o.far")).alias("cosine"))


def pairs(found: DataFrame) -> DataFrame:
    """``(vec_a, vec_b)``: each unordered pair once, the smaller id first."""
    return found.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()
