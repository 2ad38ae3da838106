"""From events to campaigns, causal graphs, attack chains and incidents."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions import scores
from huntframe.operators.graph import components, entity_keys, entity_links, with_previous
from huntframe.session import Stages

MINUTE = 60_000_000


def embedded(events: DataFrame) -> DataFrame:
    """Adds ``places``, the hashed words of what an event states."""
    c = F.col
    text = scores.event_text(c("ocsf_class_name"), c("actor_kind"), c("actor"), c("target_kind"), c("target"), c("host"), c("message"))
    return events.withColumn("places", scores.hash_places(text))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of a column of hashed words, or of numbers as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type.value_type):
        return scores.dense(flat, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return flat.reshape(len(column), -1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All cosines; of whole-numbered vectors they come out the same wherever they are computed."""
    norm = np.outer((x * x).sum(1), (y * y).sum(1))
    return np.where(norm > 0, (x @ y.T) / np.sqrt(np.maximum(norm, 1e-300)), 0.0)


def _blocks(rows: DataFrame, window_us: int, block: int) -> DataFrame:
    """Rows dealt to groups ``(border, bucket, i, j)`` in which every two rows within the window meet exactly once.

    Time buckets are as wide as the window and cut, by hash, into blocks of some thousand rows. A
    pair of blocks of one bucket, or of neighbouring buckets, is a group of its own.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    mine = rows.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    pairs = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    both = pairs.select("bucket", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", F.lit(0).alias("side"), "id", "ts", "vec")

    def over(side: int):  # the blocks of a bucket (1) with those of the one before (-1), under the number of the later
        other = mine.drop("n").join(sizes.withColumn("bucket", F.col("bucket") + side), "bucket").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        i, j = ("o", "part") if side == 1 else ("part", "o")
        return other.select((F.col("bucket") + F.lit(int(side == -1))).alias("bucket"), F.col(i).alias("i"), F.col(j).alias("j"), "part", F.lit(side).alias("side"), "id", "ts", "vec")

    return both.withColumn("border", F.lit(False)).unionByName(over(1).unionByName(over(-1)).withColumn("border", F.lit(True)))


def _near(g: pa.Table, window_us: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of a group that lie within the window and reach the threshold, with their cosines."""
    i, j, border = g["i"][0].as_py(), g["j"][0].as_py(), g["border"][0].as_py()
    part, side, ts = g["part"].to_numpy(), g["side"].to_numpy(), g["ts"].to_numpy()
    vec = _matrix(g["vec"])
    left, right = (np.flatnonzero(side == k) for k in (-1, 1)) if border else (np.flatnonzero(part == k) for k in (i, j))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(left), 512):
        x = left[at : at + 512]
        cosine = _cosines(vec[x], vec[right])
        near = (cosine >= threshold - 1e-9) & (np.abs(ts[x][:, None] - ts[right][None, :]) <= window_us)
        if i == j and not border:
            near &= x[:, None] < right[None, :]
        p, q = np.nonzero(near)
        found.append((x[p], right[q], cosine[p, q]))
    p, q, sim = (np.concatenate(f) for f in zip(*found))
    return p, q, sim


def _vectors(events: DataFrame, window_us: int) -> DataFrame:
    vec = F.col("places") if "places" in events.columns else F.col("vec").cast("array<double>")
    return events.select("id", "ts", vec.alias("vec"), F.call_function("div", "ts", F.lit(window_us)).alias("bucket")).where("vec is not null")


def semantic_links(events: DataFrame, window_us: int, threshold: float = 0.5, block: int = 2048) -> DataFrame:
    """``(a, b, sim)``: all pairs of events whose texts reach the cosine and whose times lie within the window, the earlier first.

    Exact. The work grows with the pairs within the window, the result with those of them that
    are similar. ``events`` bring ``places`` or vectors ``vec``.
    """
    rows = Stages(events.sparkSession, "semantic").cut(_vectors(events, window_us), "rows")

    def products(g: pa.Table) -> pa.Table:
        p, q, sim = _near(g, window_us, threshold)
        ts, ids = g["ts"].to_numpy(), g["id"].combine_chunks()
        back = ts[p] > ts[q]
        a, b = ids.take(pa.array(np.where(back, q, p))), ids.take(pa.array(np.where(back, p, q)))
        same = pc.and_(pc.equal(pa.array(ts[p]), pa.array(ts[q])), pc.greater(a, b))
        return pa.table({"a": pc.if_else(same, b, a), "b": pc.if_else(same, a, b), "sim": pa.array(sim, pa.float64())})

    return _blocks(rows, window_us, block).groupBy("border", "bucket", "i", "j").applyInArrow(products, "a string, b string, sim double")


def nearest_links(events: DataFrame, window_us: int, k: int = 10, threshold: float = 0.5, block: int = 2048) -> DataFrame:
    """``(a, b, sim)``: each event with its k most similar ones within the window, as far as they reach the threshold; the smaller id first.

    Exact, ties to the smaller id. A group answers with the best k of each of its events, so what
    is shuffled and returned grows with the events and not with the similar pairs.
    """
    rows = Stages(events.sparkSession, "nearest").cut(_vectors(events, window_us), "rows")

    def best(g: pa.Table) -> pa.Table:
        p, q, sim = _near(g, window_us, threshold)
        ids = g["id"].combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        p, q, sim = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([sim, sim])
        order = np.lexsort((rank[q], -sim, p))
        p, q, sim = p[order], q[order], sim[order]
        keep = np.arange(len(p)) - np.searchsorted(p, p) < k
        return pa.table({"id": ids.take(pa.array(p[keep])), "other": ids.take(pa.array(q[keep])), "sim": pa.array(sim[keep], pa.float64())})

    found = _blocks(rows, window_us, block).groupBy("border", "bucket", "i", "j").applyInArrow(best, "id string, other string, sim double")
    first = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k).alias("o")).select("id", F.explode("o").alias("o"))
    return first.select(F.least("id", "o.other").alias("a"), F.greatest("id", "o.other").alias("b"), (-F.col("o.far")).alias("sim")).distinct()


def shared_pairs(rows: DataFrame, window_us: int) -> DataFrame:
    """``(campaign, n, sim)``: per campaign the number of pairs within the window that share an entity, and the sum of their cosines.

    ``rows``: (campaign, id, ts, keys, vec). No pair is emitted: rows of an entity lie sorted by
    time, and each is compared with those before it, one step further back at a time for all
    rows at once. A pair counts at the smallest entity that it shares. Entities are cut into spans
    of time that begin with the rows of the one before that are still within the window.
    """
    width = 8 * window_us
    hashed = F.array_sort(F.transform("keys", lambda x: F.xxhash64(x)))
    flat = rows.select("campaign", "id", "ts", hashed.alias("keys"), "vec").withColumn("entity", F.explode("keys"))
    span = F.call_function("div", "ts", F.lit(width))
    own = flat.withColumns({"span": span, "carried": F.lit(False)})
    late = own.where(F.col("ts") > (F.col("span") + 1) * width - window_us - 1).withColumns({"span": F.col("span") + 1, "carried": F.lit(True)})
    spread = own.unionByName(late).repartition("entity", "span").sortWithinPartitions("entity", "span", "ts", "id")

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None and rest.num_rows:
                t = pa.concat_tables([rest, t])
            old = t.num_rows - batch.num_rows
            entity, at, ts = t["entity"].to_numpy(), t["span"].to_numpy(), t["ts"].to_numpy()
            keys = np.full((t.num_rows, 3), np.iinfo(np.int64).max)
            sizes = pc.list_value_length(t["keys"]).to_numpy()
            keys[np.repeat(np.arange(t.num_rows), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = t["keys"].combine_chunks().flatten().to_numpy()
            vec = _matrix(t["vec"])
            norm = (vec * vec).sum(1)
            n, sim = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows)
            live, back = np.flatnonzero(~t["carried"].to_numpy(zero_copy_only=False)), 1
            live = live[live >= old]
            while len(live):
                live = live[live >= back]
                before = live - back
                live = live[(entity[before] == entity[live]) & (at[before] == at[live]) & (ts[live] - ts[before] <= window_us)]
                before = live - back
                first = np.ones(len(live), bool)
                for x in range(3):
                    for y in range(3):
                        first &= ~((keys[live, x] == keys[before, y]) & (keys[live, x] < entity[live]))
                a, b = live[first], before[first]
                n[a] += 1
                both = norm[a] * norm[b]
                sim[a] += np.where(both > 0, np.einsum("ij,ij->i", vec[a], vec[b]) / np.sqrt(np.maximum(both, 1e-300)), 0.0)
                back += 1
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([t["campaign"].combine_chunks().take(pa.array(used)), pa.array(n[used]), pa.array(sim[used])], names=["campaign", "n", "sim"])
            # What the next batch may still look back to.
            tail = np.flatnonzero((entity == entity[-1]) & (at == at[-1]) & (ts >= ts[-1] - window_us)) if t.num_rows else np.zeros(0, np.int64)
            rest = t.take(pa.array(tail))

    sums = spread.mapInArrow(run, "campaign string, n bigint, sim double")
    return sums.groupBy("campaign").agg(F.sum("n").alias("n"), F.sum("sim").alias("sim"))


def campaigns(events: DataFrame, window_us: int = 30 * MINUTE, cross_domain: bool = True, similar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Campaign candidates and their members.

    Candidates: ``(campaign, n_events, n_classes, n_links, score)``; members: ``(campaign, id)``.
    A campaign is named by its smallest event id. Its links are all pairs within the window that
    share an entity, and the given similar pairs ``(a, b, sim)``; the score rises with classes,
    events and the mean cosine of the links. Components need neighbours in time only, and links
    are counted without being listed.
    """
    stages = Stages(events.sparkSession, "campaigns")
    links = entity_links(events, window_us).select("a", "b")
    if similar is not None:
        similar = stages.cut(similar.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim")), "similar")
        links = links.unionByName(similar.select("a", "b"))
    members = stages.cut(components(links).withColumnRenamed("component", "campaign"), "members")
    facts = embedded(events).select("id", "ts", "ocsf_class", F.array_distinct(entity_keys()).alias("keys"), F.col("places").alias("vec"))
    facts = stages.cut(members.join(facts, "id"), "facts")
    stats = facts.groupBy("campaign").agg(F.count("*").alias("n_events"), F.size(F.collect_set("ocsf_class")).alias("n_classes"))
    strength = shared_pairs(facts, window_us)
    if similar is not None:
        a, b = (facts.select(F.col("id").alias(n), F.col("keys").alias(f"k{n}"), *([F.col("campaign")] if n == "a" else [])) for n in "ab")
        apart = similar.join(a, "a").join(b, "b").where(~F.arrays_overlap("ka", "kb"))
        strength = strength.unionByName(apart.groupBy("campaign").agg(F.count("*").alias("n"), F.sum("sim").alias("sim")))
    strength = strength.groupBy("campaign").agg(F.sum("n").alias("n_links"), F.sum("sim").alias("sim"))
    score = F.col("n_classes") + (F.col("n_events") - 1) * 0.5 + F.greatest(F.col("sim") / F.col("n_links"), F.lit(0.0))
    rated = stats.join(strength, "campaign").withColumn("score", F.round(score, 6))
    if cross_domain:
        rated = rated.where("n_classes >= 2")
    rated = stages.cut(rated.select("campaign", "n_events", "n_classes", "n_links", "score"), "rated")
    return rated, stages.cut(members.join(rated.select("campaign"), "campaign", "left_semi"), "kept")


def by_score(rated: DataFrame) -> DataFrame:
    """Candidates with their place by score, the best first; ties to the smaller name. One row per campaign is ranked."""
    return rated.orderBy(F.desc("score"), "campaign")


def causal_edges(members: DataFrame, events: DataFrame, window_us: int = 30 * MINUTE) -> DataFrame:
    """``(campaign, src, dst, delta_us, score, shared, reason)``: from an event to the next one on each of its entities.

    A longer edge over the same entity never lies on a best path: the way through the event in
    between scores higher, since every edge adds at least 0.45.
    """
    rows = events.join(members, "id").withColumns({"keys": F.array_distinct(entity_keys()), "anomaly": scores.anomaly(F.col("severity_id"), F.col("message"))})
    slim = rows.select("campaign", "id", "ts", "anomaly", "keys", F.explode("keys").alias("entity"))
    steps = with_previous(slim, ["campaign", "entity"], window_us).where(F.col("prev").isNotNull())
    steps = steps.withColumns({"src": F.col("prev.id"), "delta_us": F.col("ts") - F.col("prev.ts"), "shared": F.array_join(F.array_intersect("prev.keys", "keys"), ", ")})
    edges = steps.groupBy("campaign", "src", F.col("id").alias("dst")).agg(F.first("delta_us").alias("delta_us"), F.first("anomaly").alias("anomaly"), F.first("shared").alias("shared"))
    reason = F.concat(F.lit("shares "), F.col("shared"), F.lit("; Δt="), scores.time_gap(F.col("delta_us")))
    return edges.select("campaign", "src", "dst", "delta_us", F.round(scores.edge_score(F.col("delta_us"), F.col("anomaly")), 6).alias("score"), "shared", reason.alias("reason"))


class Edges:
    """Outgoing edges ``(target, weight)`` by node, from arrays that are sorted by source."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.at, self.dst, self.weight = np.searchsorted(src, np.arange(n + 1)), dst, weight

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, i: int) -> list[tuple[int, float]]:
        if i >= len(self):
            raise IndexError(i)
        cut = slice(self.at[i], self.at[i + 1])
        return list(zip(self.dst[cut].tolist(), self.weight[cut].tolist()))


def _forward(out) -> bool:
    return all(j > i for i, o in enumerate(out) for j, _ in o)


def beam(anomaly: list[float], out, width: int = 4) -> tuple[list[int], float]:
    """The heaviest forward path that a beam of this width finds; starts are not cut to the width.

    A path is its last state and the states before it, so that a step costs the same however
    long the path is.
    """
    if not anomaly:
        return [], 0.0
    bonus = [0.1 * a for a in anomaly]
    top = max(bonus)
    start = max(i for i, b in enumerate(bonus) if b == top)
    node, before, forward = array("q", range(len(bonus))), array("q", [-1]) * len(bonus), _forward(out)

    def trace(state: int) -> list[int]:
        path = []
        while state >= 0:
            path.append(node[state])
            state = before[state]
        return path[::-1]

    best, score, paths = (start, -1), top, list(enumerate(bonus))
    while True:
        longer = ((p, j, s + w + bonus[j]) for p, s in paths for j, w in out[node[p]] if forward or j not in trace(p))
        kept = heapq.nlargest(width, longer, key=itemgetter(2))
        if not kept:
            return trace(best[0]) + [j for j in best[1:] if j >= 0], score
        if kept[0][2] > score:
            best, score = kept[0][:2], kept[0][2]
        paths = [(len(node) + k, s) for k, (_, _, s) in enumerate(kept)]
        node.extend(j for _, j, _ in kept)
        before.extend(p for p, _, _ in kept)


def greedy(anomaly: list[float], out, gamma: float = 0.5) -> tuple[list[int], float]:
    """From every start, always the edge with the best score plus discounted best next one; the heaviest walk.

    Where all edges go forward, the next node does not depend on the way: totals are summed once
    from the end, and only starts whose total comes close to the greatest are walked.
    """
    best: tuple[list[int], float] = ([], float("-inf"))
    ahead = [max((w for _, w in o), default=0.0) for o in out]
    starts = range(len(anomaly))
    options = lambda i: ((w + gamma * ahead[j], -k, j, w) for k, (j, w) in enumerate(out[i]))
    if _forward(out):
        total = [0.1 * a for a in anomaly]
        for i in reversed(starts):
            if o := max(options(i), default=None):
                total[i] += o[3] + total[o[2]]
        near = max(total, default=0.0)
        starts = [i for i in starts if total[i] >= near - 1e-9 * max(1.0, abs(near))]
    for start in starts:
        path, total, seen = [start], 0.1 * anomaly[start], {start}
        while o := max((o for o in options(path[-1]) if o[2] not in seen), default=None):
            path.append(o[2])
            seen.add(o[2])
            total += o[3] + 0.1 * anomaly[o[2]]
        if total > best[1]:
            best = (path, total)
    return best if best[0] else ([], 0.0)


SELECTORS = {"beam": beam, "greedy": greedy}


def chains(members: DataFrame, events: DataFrame, edges: DataFrame, selector: str | Callable = "beam") -> DataFrame:
    """``(campaign, step, id, path_score)``: the chosen path of each campaign's causal graph.

    Nodes and edges of a campaign are linear in its events, and so are the searches; they are
    sequential by nature, so one campaign is one task.
    """
    choose = selector if callable(selector) else SELECTORS[selector]
    nodes = events.join(members, "id").select("campaign", "id", "ts", scores.anomaly(F.col("severity_id"), F.col("message")).alias("anomaly"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("double").alias("score"))
    both = nodes.unionByName(edges.select("campaign", F.col("dst").alias("id"), F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("double").alias("anomaly"), "src", "score"))

    def path(g: pa.Table) -> pa.Table:
        campaign = g["campaign"][0].as_py()
        n = g.filter(pc.is_null(g["src"])).select(["id", "ts", "anomaly"]).sort_by([("ts", "ascending"), ("id", "ascending")])
        e = g.filter(pc.is_valid(g["src"])).select(["src", "id", "score"])
        ids = n["id"].combine_chunks()
        src, dst, w = pc.index_in(e["src"], ids).to_numpy(), pc.index_in(e["id"], ids).to_numpy(), e["score"].to_numpy()
        order = np.lexsort((w, dst, src))
        best, score = choose(n["anomaly"].to_pylist(), Edges(len(ids), src[order], dst[order], w[order]))
        steps = len(best)
        return pa.table({"campaign": pa.array([campaign] * steps, pa.string()), "step": pa.array(range(steps), pa.int32()), "id": ids.take(pa.array(best, pa.int64())), "path_score": pa.array([round(score, 6)] * steps, pa.float64())})

    return both.groupBy("campaign").applyInArrow(path, "campaign string, step int, id string, path_score double")


def incidents(chain: DataFrame, events: DataFrame, edges: DataFrame, techniques: DataFrame) -> DataFrame:
    """One row per campaign: its chain, tactics, techniques, confidence and explanations.

    ``techniques``: (id, technique, place); an event has the technique of the first rule that
    matches it, by the rule's place in the list.
    """
    known = techniques if "place" in techniques.columns else techniques.withColumn("place", F.lit(0))
    known = known.groupBy("id").agg(F.min_by("technique", F.struct("place", "technique")).alias("technique"))
    steps = chain.join(events.select("id", "ts", "ocsf_class", "ocsf_class_name", "actor", "actor_kind", "severity_id", "message"), "id").join(known, "id", "left")
    label = F.when(F.col("actor").isNotNull(), F.concat("ocsf_class_name", F.lit(" "), F.coalesce("actor_kind", F.lit("user")), F.lit(":"), "actor")).otherwise(F.col("ocsf_class_name"))
    steps = steps.withColumns({"label": label, "tactic": scores.tactic(F.col("technique"), F.col("ocsf_class")), "anomaly": scores.anomaly(F.col("severity_id"), F.col("message"))})
    order = Window.partitionBy("campaign").orderBy("step")
    steps = steps.withColumns({"src": F.lag("id").over(order), "from": F.lag("label").over(order)})
    steps = steps.join(edges.select("campaign", "src", F.col("dst").alias("id"), "score", "reason"), ["campaign", "src", "id"], "left")
    told = F.when(F.col("from").isNotNull(), F.concat("from", F.lit(" → "), "label", F.lit(" ("), "reason", F.lit("; causal="), F.format_string("%.2f", F.round("score", 2)), F.lit(")")))
    ordered = F.array_sort(F.collect_list(F.struct("step", "id", "tactic", "technique", told.alias("told"))))
    out = steps.groupBy("campaign").agg(F.count("*").alias("n_steps"), F.avg("anomaly").alias("mean_anomaly"), F.first("path_score").alias("path_score"), ordered.alias("s"))
    distinct = lambda name: F.array_distinct(F.array_compact(F.transform("s", lambda x: x[name])))
    tactics = distinct("tactic")
    return out.select(
        "campaign",
        "n_steps",
        F.array_join(F.transform("s", lambda x: x["id"]), ",").alias("chain"),
        F.array_join(tactics, ",").alias("tactics"),
        F.array_join(distinct("technique"), ",").alias("techniques"),
        F.round(scores.confidence(F.col("n_steps"), F.size(tactics), F.col("mean_anomaly")), 6).alias("confidence"),
        F.array_join(F.array_compact(F.transform("s", lambda x: x["told"])), "\n").alias("explanation"),
        "path_score",
    )


def triplets(events: DataFrame) -> DataFrame:
    """``(id, subject, action, object)``: the actor, else the host, does something to the target."""
    return events.select("id", F.coalesce("actor", "host").alias("subject"), scores.action(F.col("ocsf_class")).alias("action"), F.col("target").alias("object"))
