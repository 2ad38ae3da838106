"""The pipe language: ``search … | where … | fields … | stats … | sort … | head …``.

A query is compiled once into a DataFrame: filters, then grouping or projection, then order,
then limit, whatever the order of the stages, so ``head 5 | where …`` filters first. Of several
``fields``, ``stats``, ``sort`` or ``head`` stages the last holds; ``search`` and ``where``
stages are joined by AND; ``fields`` is ignored once there is a ``stats``.

Literals take the type of their column, so a number against a text column is compared as text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z0-9_]+")
_OPS = {"=", "==", "!=", "<>", ">", "<", ">=", "<=", "contains"}


class DslError(ValueError):
    pass


def _name(text: str) -> str:
    if not _NAME.fullmatch(text):
        raise DslError(f"not a column name: {text!r}")
    return text


def split_stages(text: str) -> list[str]:
    """Stages between bars; bars inside quotes do not split."""
    out, now, quote = [], "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "|":
            out.append(now.strip())
            now = ""
            continue
        now += c
    return [s for s in [*out, now.strip()] if s]


@dataclass
class Query:
    searches: list[str] = field(default_factory=list)
    wheres: list[tuple[str, str, str]] = field(default_factory=list)
    columns: list[str] | None = None
    count_as: str | None = None
    by: list[str] = field(default_factory=list)
    sort: tuple[str, bool] | None = None
    limit: int | None = None


def parse(text: str) -> Query:
    q = Query()
    for stage in split_stages(text):
        verb, _, rest = stage.partition(" ")
        rest = rest.strip()
        verb = verb.lower()
        if verb == "search":
            if rest:
                q.searches.append(rest.strip("'\"") if rest[0] == rest[-1] and rest[0] in "'\"" else rest)
        elif verb == "where":
            parts = rest.split(None, 2)
            if len(parts) < 3 or parts[1] not in _OPS:
                raise DslError(f"where needs a column, an operator and a value: {stage!r}")
            value = parts[2].strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            q.wheres.append((_name(parts[0]), parts[1], value))
        elif verb == "fields":
            q.columns = [_name(c.strip()) for c in rest.split(",") if c.strip()]
        elif verb == "stats":
            m = re.fullmatch(r"count\(\)(?:\s+as\s+(\S+))?(?:\s+by\s+(.+))?", rest)
            if not m:
                raise DslError(f"stats knows count() [as name] [by columns]: {stage!r}")
            q.count_as = _name(m[1] or "count")
            q.by = [_name(c.strip()) for c in (m[2] or "").split(",") if c.strip()]
        elif verb == "sort":
            col, _, way = rest.partition(" ")
            q.sort = (_name(col), way.strip().lower() == "desc")
        elif verb in ("head", "limit"):
            if not rest.isdigit():
                raise DslError(f"not a number of rows: {rest!r}")
            q.limit = int(rest)
        else:
            raise DslError(f"unknown stage: {verb!r}")
    return q


def is_dsl(text: str) -> bool:
    """Whether a text is of this language rather than SQL."""
    return bool(re.match(r"\s*(search|where|fields|stats|sort|head|limit)\b", text, re.I))


def _finite(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def _condition(df: DataFrame, name: str, op: str, value: str) -> Column:
    c = F.col(name)
    if op == "contains":
        return c.cast("string").ilike(f"%{value}%")
    number = _finite(value)
    if isinstance(df.schema[name].dataType, T.NumericType):
        if number is None:
            raise DslError(f"{name} is a number, {value!r} is not")
        literal = F.lit(int(value)) if re.fullmatch(r"[+-]?\d{1,18}", value) else F.lit(number)
    else:
        literal = F.lit(value)
    return {"=": c == literal, "==": c == literal, "!=": c != literal, "<>": c != literal, ">": c > literal, "<": c < literal, ">=": c >= literal, "<=": c <= literal}[op]


def compile_query(q: Query, events: DataFrame) -> DataFrame:
    df = events
    for s in q.searches:
        df = df.where(F.col("message").ilike(f"%{s}%"))
    for w in q.wheres:
        df = df.where(_condition(events, *w))
    if q.count_as:
        df = df.groupBy(*q.by).agg(F.count("*").alias(q.count_as))
    elif q.columns:
        df = df.select(*q.columns)
    if q.sort:
        name, desc = q.sort
        df = df.orderBy(F.col(name).desc_nulls_first() if desc else F.col(name).asc_nulls_last())
    return df if q.limit is None else df.limit(q.limit)


def run(text: str, events: DataFrame) -> DataFrame:
    return compile_query(parse(text), events)


_INTERVAL = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def duration_us(text: str, units: str = "smhdw") -> int | None:
    """``15m`` and the like in microseconds; None if malformed."""
    m = re.fullmatch(rf"(\d+)([{units}])", text.strip())
    return int(m[1]) * _INTERVAL[m[2]] * 1_000_000 if m else None


def time_histogram(events: DataFrame, interval: str = "1h", like: str | None = None) -> DataFrame:
    """Counts per time bucket; a malformed interval is an hour; ``like`` is case-sensitive."""
    width = duration_us(interval) or duration_us("1h")
    if like:
        events = events.where(F.col("message").like(f"%{like}%"))
    return events.groupBy((F.call_function("div", F.col("ts"), F.lit(width)) * width).alias("bucket")).agg(F.count("*").alias("n"))


def facets(events: DataFrame, columns: list[str], top: int = 6) -> DataFrame:
    """The most frequent non-empty values of each column, counted in one pass."""
    from pyspark.sql import Window

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    counts = events.select(pairs).select("p.*").where("value is not null and value != ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)
