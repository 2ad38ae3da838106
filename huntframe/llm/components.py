"""One group identifier for every record that pairwise matches link, directly or indirectly.

Low-diameter decomposition with exponentially shifted starts: every vertex draws a shift from
an exponential distribution (from a hash, so a lost task repeats it) and joins the vertex that
maximises shift minus distance. A few relaxation rounds, each one join and one aggregation,
grow these clusters; clusters contract to super-vertices; the rest is solved on the edges
between clusters. A constant share of the edges falls inside clusters at every level, so the
graph shrinks geometrically whatever its diameter. Assignments of all levels are composed from
the top, and the smallest member names the group.

Cutting the rounds short is safe: a vertex only ever takes a centre that a path leads to.

Defined cases: null ids and self-links link nothing; repeated links count once; an id that is
linked to no other has no row; an empty table gives an empty result. High-degree vertices meet
partial aggregation before every shuffle, and joins on them are left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.session import Stages


def _shift(vertex: Column, level: int, beta: float) -> Column:
    """A draw from Exp(beta) that depends on the vertex and the level alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level)), 11).cast("double") + 1.0) / float(2**53 + 1)
    return -F.log(uniform) / beta


def grow(edges: DataFrame, level: int, beta: float, rounds: int) -> DataFrame:
    """``(v, center)``: the clusters after some relaxation rounds over ``(src, dst)``, both directions."""
    # A vertex is its own neighbour at distance 0, so that a round reads the state once and the plan stays a chain.
    vertices = edges.select(F.col("src").alias("v")).distinct()
    near = edges.select("src", "dst", F.lit(1.0).alias("step")).unionByName(vertices.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("step")))
    state = vertices.select("v", F.struct(_shift(F.col("v"), level, beta).alias("value"), F.col("v").alias("center")).alias("s"))
    for _ in range(rounds):
        sent = near.join(state, F.col("src") == F.col("v")).select("dst", F.struct((F.col("s.value") - F.col("step")).alias("value"), F.col("s.center").alias("center")).alias("s"))
        state = sent.groupBy(F.col("dst").alias("v")).agg(F.max("s").alias("s"))
    return state.select("v", F.col("s.center").alias("center"))


def contract(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """The distinct edges between clusters, both directions."""
    a = clusters.select(F.col("v").alias("src"), F.col("center").alias("a"))
    b = clusters.select(F.col("v").alias("dst"), F.col("center").alias("b"))
    # Each undirected edge once until it is relabelled.
    once = edges.where("src < dst").join(a, "src").select("a", "dst").distinct().join(b, "dst").where("a != b")
    pair = once.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pair.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def components(pairs: DataFrame, beta: float = 0.15, rounds: int = 4, max_levels: int = 60) -> DataFrame:
    """``(id, group_id)`` for pairs ``(a, b)``: every linked id with the smallest id of its group."""
    spark = pairs.sparkSession
    stages = Stages(spark, "components")
    first = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    edges = stages.cut(first.select(both.alias("e")).select("e.*"), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        if len(maps) == max_levels:
            raise RuntimeError(f"edges are left after {max_levels} levels")
        clusters = stages.cut(grow(edges, len(maps), beta, rounds), f"map{len(maps)}")
        maps.append(clusters)
        edges = stages.cut(contract(edges, clusters), "edges")
    if not maps:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("group_id"))
    root = maps[-1].select("v", F.col("center").alias("root"))
    for lower in reversed(maps[:-1]):
        # Only super-vertices that still had edges were assigned anew; the others are roots.
        up = root.select(F.col("v").alias("center"), "root")
        root = lower.join(up, "center", "left").select("v", F.coalesce("root", "center").alias("root"))
    root = stages.cut(root, "root")
    stages.drop("edges", *[f"map{i}" for i in range(len(maps))])
    least = root.groupBy("root").agg(F.min("v").alias("group_id"))
    return root.join(least, "root").select(F.col("v").alias("id"), "group_id")


def linked_events(links: DataFrame, lists: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` from pairwise links and candidate lists, between known ids only.

    Links and lists alike are sets of ids; within a set every id is tied to its smallest known
    one, so a list of n ids gives n - 1 pairs.
    """
    pair = links.select(
        F.concat(F.lit("l"), F.coalesce(F.col("link_id").cast("string"), F.concat_ws("|", "event_a", "event_b"))).alias("s"), F.explode(F.array("event_a", "event_b")).alias("id")
    )
    many = lists.select(F.concat(F.lit("c"), F.coalesce(F.col("campaign_id").cast("string"), F.array_join("events", "|"))).alias("s"), F.explode("events").alias("id"))
    ids = known.select("id").where("id is not null")
    sets = pair.unionByName(many).where("id is not null").join(ids, "id", "left_semi")
    sets = Stages(links.sparkSession, "sets").cut(sets, "sets")
    hubs = sets.groupBy("s").agg(F.min("id").alias("hub"))
    return sets.join(hubs, "s").where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
