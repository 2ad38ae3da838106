"""Entities and the events that touch them: provenance edges, links, k-hop, components.

Links between events of one entity are kept linear: only neighbours in time are paired. Where
all pairs within a window would be linked, the neighbours reach the same components, because
any event between two linked ones lies within the window of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.session import Stages


def with_previous(rows: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Adds ``prev``: the row before in time within the same keys, if no further away than the window.

    Rows are cut into time buckets as wide as the window; the last row of a bucket, found by
    partial aggregation, is also handed to the next one. A busy key is thus many small windows
    and never one task.
    """
    names = rows.columns
    cut = rows.withColumns({"_bucket": F.call_function("div", F.col("ts"), F.lit(window_us)), "_carried": F.lit(False)})
    last = cut.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*[c for c in names if c not in keys]), F.struct("ts", "id")).alias("_l"))
    carried = last.select(*keys, "_l.*", (F.col("_bucket") + 1).alias("_bucket"), F.lit(True).alias("_carried"))
    order = Window.partitionBy(*keys, "_bucket").orderBy("ts", "id")
    both = cut.unionByName(carried).withColumn("prev", F.lag(F.struct(*names)).over(order))
    return both.where(~F.col("_carried")).select(*names, F.when(F.col("ts") - F.col("prev.ts") <= window_us, F.col("prev")).alias("prev"))


def entity_keys() -> Column:
    """The entities of an event as ``kind:id``, in the order host, actor, target."""
    key = lambda kind, name: F.when(F.col(name).isNotNull(), F.concat(kind, F.lit(":"), F.col(name)))
    return F.array_compact(F.array(key(F.lit("host"), "host"), key(F.coalesce("actor_kind", F.lit("user")), "actor"), key(F.coalesce("target_kind", F.lit("host")), "target")))


def entity_events(events: DataFrame) -> DataFrame:
    """``(entity, id, ts, ocsf_class)``: one row per entity of each event."""
    return events.select(F.explode(F.array_distinct(entity_keys())).alias("entity"), "id", "ts", "ocsf_class")


def provenance_edges(events: DataFrame) -> DataFrame:
    """``(src, dst, id, ts, ocsf_class)``: the present entities of an event, one after the other."""
    keys = entity_keys()
    pairs = F.zip_with(F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0))), F.slice(keys, 2, F.greatest(F.size(keys) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return events.select(F.explode(pairs).alias("e"), "id", "ts", "ocsf_class").select("e.*", "id", "ts", "ocsf_class")


def entity_links(events: DataFrame, window_us: int) -> DataFrame:
    """``(a, b, entity, gap_us)``: neighbours in time on one entity, no further apart than the window."""
    rows = with_previous(entity_events(events).select("entity", "id", "ts"), ["entity"], window_us).where(F.col("prev").isNotNull())
    return rows.select(F.col("prev.id").alias("a"), F.col("id").alias("b"), "entity", (F.col("ts") - F.col("prev.ts")).alias("gap_us"))


def co_entity_events(events: DataFrame, chosen: DataFrame, window_us: int | None = None) -> DataFrame:
    """``(id, other)``: events that share an entity with each chosen event; for a stated set of ids.

    Entities and, with a window, time buckets are join keys, so a busy entity meets a chosen
    event only around its time.
    """
    rows = entity_events(events)
    mine = rows.join(chosen.select("id").distinct(), "id", "left_semi").select("entity", F.col("id").alias("me"), F.col("ts").alias("t"))
    if window_us is None:
        joined = mine.join(rows, "entity")
    else:
        bucket = lambda c: F.call_function("div", c, F.lit(window_us))
        around = mine.withColumn("bucket", F.explode(F.array(*[bucket(F.col("t")) + i for i in (-1, 0, 1)])))
        joined = around.join(rows.withColumn("bucket", bucket(F.col("ts"))), ["entity", "bucket"]).where(F.abs(F.col("ts") - F.col("t")) <= window_us)
    return joined.where("id != me").select(F.col("me").alias("id"), F.col("id").alias("other")).distinct()


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``(node, hop)``: nodes within some undirected hops of the start nodes, which are left out."""
    stages = Stages(edges.sparkSession, "khop")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = stages.cut(start.select(F.col("node"), F.lit(0).alias("hop")).distinct(), "seen")
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stages.cut(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = stages.cut(seen.unionByName(frontier), "seen")
        if frontier.isEmpty():
            break
    return seen.where("hop > 0")


def components(pairs: DataFrame, max_levels: int = 100, jumps: int = 2) -> DataFrame:
    """``(id, component)`` of pairs ``(a, b)``: the smallest id that each id reaches.

    Every vertex points at the neighbour, or itself, that comes first in an order drawn from a
    hash of id and level; pointers are followed by doubling, and the edges are drawn anew between
    the vertices pointed at. The order is as good as random, so pointers form short chains and
    each level has a fraction of the vertices of the one before, whatever the diameter. The
    levels' pointers are composed from the last to the first, and the smallest id names the rest.
    """
    stages = Stages(pairs.sparkSession, "components")
    edges = stages.cut(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        if len(levels) == max_levels:
            raise RuntimeError(f"edges are left after {max_levels} levels")
        u, v = (F.struct(F.xxhash64(c, F.lit(len(levels))).alias("h"), F.col(c).alias("id")) for c in "uv")
        # Both ends of an edge point at the end that comes first, which for one of them is itself.
        first = F.least(u, v)
        ends = F.explode(F.array(F.struct(F.col("u").alias("id"), first.alias("p")), F.struct(F.col("v").alias("id"), first.alias("p")))).alias("e")
        to = edges.select(ends).select("e.*").groupBy("id").agg(F.min("p").alias("p")).select("id", F.col("p.id").alias("p"))
        for _ in range(jumps):
            to = to.join(to.select(F.col("id").alias("p"), F.col("p").alias("far")), "p").select("id", F.col("far").alias("p"))
        to = stages.cut(to, f"level{len(levels)}")
        levels.append(to)
        drawn = edges.join(to.select(F.col("id").alias("u"), F.col("p").alias("pu")), "u").select("pu", "v").distinct()
        drawn = drawn.join(to.select(F.col("id").alias("v"), F.col("p").alias("pv")), "v").where("pu != pv")
        edges = stages.cut(drawn.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    root = levels[-1].select("id", F.col("p").alias("component"))
    for lower in reversed(levels[:-1]):
        root = lower.join(root.select(F.col("id").alias("p"), "component"), "p", "left").select("id", F.coalesce("component", "p").alias("component"))
    root = stages.cut(root, "root")
    least = root.groupBy("component").agg(F.min("id").alias("least"))
    return root.join(least, "component").select("id", F.col("least").alias("component"))
