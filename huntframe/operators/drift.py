"""Schemas that drift between the files of a feed: changes reported, files read as one table.

Every file's columns are profiled with their type and a sketch of their values: the number of
distinct values and two order-free sums of their 64-bit hashes, so equal sets have equal
sketches and a hot file is reduced by partial aggregation. Columns that end and columns that
begin between neighbouring files of a feed are matched as a bipartite assignment: an edge asks
for the same type and sketch, its weight is the similarity of the names. Matched columns are
renames; chains of renames and widened types give the unified table.

Defined cases: a payload that is null or no JSON object has no columns; null values do not
make a column; a column with several types in one file is ``number`` if they are integer and
number, else ``string``; exact duplicate lines count once by nature of sets; files without
lines have no columns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.text import as_map
from huntframe.session import Stages

CHANGE = "file_id bigint, change_kind string, field_before string, field_after string, type_before string, type_after string"


def _type(v: Column) -> Column:
    """The JSON type of a variant. Variants keep short fractions as decimals and huge integers too."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BIGINT", "integer")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .when(s.rlike(r"^DECIMAL\((?:19|[23]\d),0\)$"), "integer")
        .otherwise("number")
    )


def fields(lines: DataFrame, payload: str = "payload", file_id: str = "file_id") -> DataFrame:
    """``(file_id, name, kind, val)``: one row per non-null top-level field of each line."""
    object_ = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    e = F.explode(F.map_entries(object_)).alias("e")
    v = F.col("e.value")
    return (
        lines.select(F.col(file_id).alias("file_id"), e)
        .where(v.isNotNull() & ~F.is_variant_null(v))
        .select("file_id", F.col("e.key").alias("name"), _type(v).alias("kind"), F.to_json(v).alias("val"))
    )


def profiles(lines: DataFrame, payload: str = "payload", file_id: str = "file_id") -> DataFrame:
    """``(file_id, name, kind, sketch)``: one row per column of each file."""
    hashed = fields(lines, payload, file_id).select("file_id", "name", "kind", F.xxhash64("kind", "val").alias("h"))
    values = hashed.groupBy("file_id", "name", "kind", "h").agg(F.lit(1).alias("one"))
    mixed = F.collect_set("kind")
    kind = F.when(F.size(mixed) == 1, mixed[0]).when(F.size(F.array_except(mixed, F.array(F.lit("integer"), F.lit("number")))) == 0, "number").otherwise("string")
    wrap = F.sum((F.col("h").bitwiseAND(2**40 - 1)))
    sketch = F.concat_ws(":", F.count("h"), F.bit_xor("h"), wrap)
    return values.groupBy("file_id", "name").agg(kind.alias("kind"), sketch.alias("sketch"))


def similarity(a: str, b: str) -> float:
    """Name similarity from 0 to 1: letters only, without regard to case."""
    plain = ["".join(c for c in x.lower() if c.isalnum()) for x in (a, b)]
    return SequenceMatcher(None, *plain).ratio()


def assign(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Maximum-weight assignment of rows to columns (shortest augmenting paths)."""
    n, m = len(weights), len(weights[0]) if weights else 0
    if n > m:
        turned = [[weights[i][j] for i in range(n)] for j in range(m)]
        return sorted((i, j) for j, i in assign(turned)) if m else []
    inf = float("inf")
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -weights[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def match_step(step: pd.DataFrame) -> pd.DataFrame:
    """Renames between two neighbouring files: ended columns against begun ones, per type and sketch."""
    out = []
    for _, part in step.groupby(["kind", "sketch"], sort=True):
        ended = sorted(part.name[part.side == "ended"])
        begun = sorted(part.name[part.side == "begun"])
        pairs = assign([[1.0 + similarity(a, b) for b in begun] for a in ended]) if ended and begun else []
        out += [(a, b) for a, b in ((ended[i], begun[j]) for i, j in pairs)]
    frame = pd.DataFrame(out, columns=["field_before", "field_after"])
    frame.insert(0, "file_id", step.file_id.iloc[0] if len(step) else pd.Series(dtype="int64"))
    return frame


def changes(files: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per change between a file and the one before it in its feed."""
    order = Window.partitionBy("feed").orderBy("file_no", "file_id")
    steps = files.select("file_id", "feed", "file_no").dropDuplicates(["file_id"]).withColumns({"before": F.lag("file_id").over(order), "after": F.lead("file_id").over(order)})
    # Each column goes to its own file's step as the new side and to the next file's as the old one.
    held = columns.join(steps, "file_id")
    new = held.where(F.col("before").isNotNull()).select("file_id", "name", F.struct("kind", "sketch").alias("new"), F.lit(None).cast("struct<kind:string,sketch:string>").alias("old"))
    old = held.where(F.col("after").isNotNull()).select(F.col("after").alias("file_id"), "name", F.lit(None).cast("struct<kind:string,sketch:string>").alias("new"), F.struct("kind", "sketch").alias("old"))
    both = new.unionByName(old).groupBy("file_id", "name").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    both = both.where(F.col("new").isNull() | F.col("old").isNull() | (F.col("new.kind") != F.col("old.kind")))
    retyped = both.where(F.col("new").isNotNull() & F.col("old").isNotNull()).select(
        "file_id", F.lit("retyped").alias("change_kind"), F.col("name").alias("field_before"), F.col("name").alias("field_after"), F.col("old.kind").alias("type_before"), F.col("new.kind").alias("type_after")
    )
    side = F.when(F.col("new").isNull(), "ended").otherwise("begun")
    one = both.where(F.col("new").isNull() | F.col("old").isNull()).select(
        "file_id", "name", side.alias("side"), F.coalesce("new.kind", "old.kind").alias("kind"), F.coalesce("new.sketch", "old.sketch").alias("sketch")
    )
    # Only steps where both sides share a type and sketch need an assignment; a step holds no more
    # rows than two files have columns.
    paired = Window.partitionBy("file_id", "kind", "sketch")
    one = one.withColumn("both", F.size(F.collect_set("side").over(paired)) == 2)
    renames = one.where("both").select("file_id", "name", "side", "kind", "sketch").groupBy("file_id").applyInPandas(match_step, "file_id bigint, field_before string, field_after string")
    sides = one.drop("both").join(
        renames.select("file_id", F.explode(F.array(F.struct(F.col("field_before").alias("name"), F.lit("ended").alias("side"), "field_before", "field_after"), F.struct(F.col("field_after").alias("name"), F.lit("begun").alias("side"), "field_before", "field_after"))).alias("r")).select("file_id", "r.*"),
        ["file_id", "name", "side"],
        "left",
    )
    empty = F.lit("")
    renamed = F.col("field_before").isNotNull()
    ended = F.col("side") == "ended"
    rest = sides.where(~renamed | ended).select(
        "file_id",
        F.when(renamed, "renamed").when(ended, "removed").otherwise("added").alias("change_kind"),
        F.when(renamed, F.col("field_before")).when(ended, F.col("name")).otherwise(empty).alias("field_before"),
        F.when(renamed, F.col("field_after")).when(ended, empty).otherwise(F.col("name")).alias("field_after"),
        F.when(renamed | ended, F.col("kind")).otherwise(empty).alias("type_before"),
        F.when(renamed | ~ended, F.col("kind")).otherwise(empty).alias("type_after"),
    )
    return retyped.unionByName(rest)


def canonical(files: DataFrame, columns: DataFrame, changed: DataFrame) -> DataFrame:
    """``(file_id, name, column, kind)``: the unified column of each file's columns.

    A chain of renames is one column, named as at its start. Types widen: integer to number,
    anything else to string.
    """
    renamed = changed.where("change_kind = 'renamed'").select("file_id", F.col("field_after").alias("name"), "field_before")
    steps = columns.join(files.select("file_id", "feed", "file_no").dropDuplicates(["file_id"]), "file_id").join(renamed, ["file_id", "name"], "left")

    def chain(feed: pd.DataFrame) -> pd.DataFrame:
        """One feed's columns, which number its files times their columns, not its rows."""
        current: dict[str, str] = {}
        out = []
        for _, file in feed.sort_values(["file_no", "file_id"]).groupby(["file_no", "file_id"], sort=True):
            now = {}
            for r in file.itertuples():
                now[r.name] = current.get(r.field_before, r.field_before) if isinstance(r.field_before, str) else current.get(r.name, r.name)
            current.update(now)
            out += [(r.file_id, r.name, now[r.name], r.kind) for r in file.itertuples()]
        return pd.DataFrame(out, columns=["file_id", "name", "column", "kind"])

    return steps.groupBy("feed").applyInPandas(chain, "file_id bigint, name string, column string, kind string")


def unified(files: DataFrame, lines: DataFrame, payload: str = "payload") -> DataFrame:
    """Every line as ``(file_id, line_no, fields map<string,string>)`` under unified names."""
    columns = Stages(lines.sparkSession, "unified").cut(profiles(lines, payload), "columns")
    names = canonical(files, columns, changes(files, columns))
    # A file's names are a map of as many entries as it has columns; rows are renamed where they are.
    entry = F.struct(F.col("name").alias("k"), F.col("column").alias("v"))
    renamed = names.groupBy(F.col("file_id").alias("_file")).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("_names"))
    object_ = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    held = lines.dropDuplicates(["file_id", "line_no"]).join(renamed, F.col("file_id") == F.col("_file"), "left")
    found = F.transform(F.map_entries(object_), lambda e: F.struct(F.try_element_at("_names", e["key"]).alias("k"), F.try_variant_get(e["value"], "$", "string").alias("v")))
    found = F.filter(F.coalesce(found, F.expr("cast(array() as array<struct<k:string,v:string>>)")), lambda e: e["v"].isNotNull())
    # Two old names may lead to one column in a line; the greater text holds.
    return held.select("file_id", "line_no", as_map(found).alias("fields"))
