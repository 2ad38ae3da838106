"""Correlation rules over alerts: sliding windows per group that clear when they fire.

Alerts of one rule and group are folded in order of time. An entry leaves the window once it
is older than the span; when the condition holds, one correlated alert is emitted and the
window is emptied. A range frame over-reports this, so it is a fold.

Where two neighbouring alerts of a group lie further apart than the span, nothing of the past
is left in the window; the fold may start anew there. Such gaps are found from the first and
last alert of each time bucket as wide as the span, which partial aggregation yields, so a
group with a third of all alerts is seen as one row per span. The pieces between gaps are
spread over tasks, and each task folds its sorted rows one after another, holding no more than
one window. No group is ever collected, and the fold is linear. What a window holds depends on
all that fired since the last gap, so a group without gaps is one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.operators.rules import Rule, candidates, match
from huntframe.plans.dsl import duration_us
from huntframe.schema import ALERT, SEVERITY_IDS
from huntframe.session import Stages

KINDS = ("event_count", "value_count", "temporal", "temporal_ordered")
_COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}


class CorrelationError(ValueError):
    pass


@dataclass
class CorrelationRule:
    id: str
    title: str
    kind: str
    rules: list[str]
    timespan: str
    group_by: list[str] = field(default_factory=list)
    condition: dict[str, Any] = field(default_factory=dict)
    generate: bool = False
    level: str = "high"
    technique: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise CorrelationError(f"unknown kind: {self.kind!r}")
        span = duration_us(self.timespan, "smhd")
        if not span:
            raise CorrelationError(f"not a time span: {self.timespan!r}")
        self.span_us = span
        compares = {k: v for k, v in self.condition.items() if k in _COMPARE}
        if self.kind == "event_count" and not compares:
            raise CorrelationError("event_count needs a comparison")
        if self.kind == "value_count" and "field" not in self.condition:
            raise CorrelationError("value_count needs a field")
        self.compares = compares

    def window(self) -> "RunningWindow":
        return RunningWindow(self)


class RunningWindow:
    """The alerts of one group that lie within the span, with what the condition asks of them kept as they come and go.

    An alert costs the same however full the window is: counts per rule or value, and for the
    ordered kind per step the latest start of a chain of alerts that leads to it.
    """

    def __init__(self, rule: CorrelationRule):
        self.rule, self.held = rule, deque()
        self.wanted = set(rule.rules)
        self.clear()

    def clear(self) -> None:
        self.held.clear()
        self.counts: dict = {}
        self.starts: list[int | None] = [None] * len(self.rule.rules)

    def _key(self, row: tuple):
        return row[2] if self.rule.kind == "value_count" else row[1] if self.rule.kind == "temporal" and row[1] in self.wanted else None

    def _holds(self, now: int) -> bool:
        rule = self.rule
        if rule.kind == "event_count":
            return all(_COMPARE[k](len(self.held), v) for k, v in rule.compares.items())
        if rule.kind == "value_count":
            return all(_COMPARE[k](len(self.counts), v) for k, v in rule.compares.items())
        if rule.kind == "temporal":
            return len(self.counts) == len(self.wanted)
        return not rule.rules or (self.starts[-1] is not None and self.starts[-1] >= now - rule.span_us)

    def add(self, row: tuple, judged: bool = False) -> list[str] | None:
        """Takes (ts, rule_id, value, event id) in order of time; the event ids if the condition holds, after which the window is empty.

        Rows of a window that is restored were judged when they came.
        """
        self.held.append(row)
        if (k := self._key(row)) is not None:
            self.counts[k] = self.counts.get(k, 0) + 1
        if self.rule.kind == "temporal_ordered":
            for j in range(len(self.starts) - 1, -1, -1):
                if row[1] == self.rule.rules[j]:
                    start = row[0] if j == 0 else self.starts[j - 1]
                    self.starts[j] = start if self.starts[j] is None or (start is not None and start > self.starts[j]) else self.starts[j]
        while self.held[0][0] < row[0] - self.rule.span_us:
            if (k := self._key(self.held.popleft())) is not None:
                self.counts[k] -= 1
                if not self.counts[k]:
                    del self.counts[k]
        if judged or not self._holds(row[0]):
            return None
        ids: list[str] = []
        for w in self.held:  # repeated neighbours only, as arrival order matters
            if not ids or ids[-1] != w[3]:
                ids.append(w[3])
        self.clear()
        return ids


def load(source: dict | str) -> CorrelationRule:
    """A correlation rule from a mapping or from YAML text."""
    if isinstance(source, str):
        import yaml

        source = yaml.safe_load(source)
    c = source.get("correlation") or {}
    tags = source.get("tags") or []
    technique = next((t.split(".", 1)[1].upper() for t in tags if t.startswith("attack.t") and t[8:9].isdigit()), None)
    return CorrelationRule(
        id=str(source.get("id") or source["title"]), title=source["title"], kind=c.get("type", ""), rules=list(c.get("rules") or []), timespan=str(c.get("timespan", "")),
        group_by=list(c.get("group-by") or []), condition=dict(c.get("condition") or {}), generate=bool(c.get("generate")), level=str(source.get("level", "medium")), technique=technique,
    )


def _keys(rule: CorrelationRule) -> tuple[Column, Column]:
    """The group key over prepared events, values of each field sorted and joined (what is missing shares the empty key), and the value that is counted."""
    parts = [F.array_join(F.array_sort(candidates(g)), ",") for g in rule.group_by]
    key = F.concat_ws("\u001f", *parts) if parts else F.lit("")
    value = F.get(candidates(rule.condition["field"]), F.lit(0)) if rule.kind == "value_count" else F.lit(None).cast("string")
    return key, value


def matched(events: DataFrame, base: list[Rule], rules: list[CorrelationRule]) -> DataFrame:
    """Alerts of the base rules with ``entries``: for each correlation rule that refers to the alert's rule its place, group key and value.

    Keys and values are read from the event where it is matched, so events are scanned once for
    any number of rules and correlations and alerts are never joined back to them.
    """
    places = {i: [n for n, c in enumerate(rules) if b.rule_id in c.rules] for i, b in enumerate(base)}

    def entry(n: int) -> Column:
        key, value = _keys(rules[n])
        concerned = [i for i, used in places.items() if n in used]
        return F.when(F.col("_position").isin(concerned), F.struct(F.lit(n).alias("rule"), key.alias("key"), value.alias("value")))

    none = F.expr("cast(array() as array<struct<rule:int,key:string,value:string>>)")
    return match(events, base, {"entries": F.array_compact(F.array(*[entry(n) for n in range(len(rules))])) if rules and base else none})


def entries(alerts: DataFrame) -> DataFrame:
    """``(rule, key, ts, id, rule_id, value)``: one row per correlation rule and matched alert."""
    return alerts.select("rule_id", "ts", F.col("events")[0].alias("id"), F.explode("entries").alias("e")).select("e.rule", "e.key", "ts", "id", "rule_id", "e.value")


def fold(rule: CorrelationRule, rows: Iterator[tuple], window: RunningWindow | None = None) -> Iterator[tuple[int, list[str]]]:
    """Correlated alerts of one group's rows (ts, rule_id, value, id) in order: time and event ids."""
    window = rule.window() if window is None else window
    for row in rows:
        if (ids := window.add(row)) is not None:
            yield row[0], ids


def correlate(keyed: DataFrame, rules: CorrelationRule | list[CorrelationRule]) -> DataFrame:
    """``(key, ts, events)``, with ``rule`` for a list of rules: when rules fire, all of them in one pass over keyed entries."""
    single = isinstance(rules, CorrelationRule)
    listed = [rules] if single else rules
    rows = keyed.withColumn("rule", F.lit(0)) if single else keyed
    span = F.element_at(F.array(*[F.lit(r.span_us) for r in listed]), F.col("rule") + 1)
    bucketed = rows.withColumns({"span": span, "bucket": F.call_function("div", F.col("ts"), span)})
    spans = bucketed.groupBy("rule", "key", "span", "bucket").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    order = Window.partitionBy("rule", "key").orderBy("bucket")
    start = F.coalesce((F.col("lo") - F.lag("hi").over(order) > F.col("span")).cast("int"), F.lit(1))
    pieces = spans.withColumn("start", start).withColumn("piece", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("rule", "key", "bucket", "piece")
    cut = bucketed.join(pieces, ["rule", "key", "bucket"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = None, None
        for f in frames:
            out = []
            for rule, key, piece, *row in f[["rule", "key", "piece", "ts", "rule_id", "value", "id"]].itertuples(index=False, name=None):
                if (rule, key, piece) != now:
                    now, window = (rule, key, piece), listed[rule].window()
                if (ids := window.add(tuple(row))) is not None:
                    out.append((rule, key, row[0], ids))
            yield pd.DataFrame(out, columns=["rule", "key", "ts", "events"])

    spread = cut.repartition("rule", "key", "piece").sortWithinPartitions("rule", "key", "piece", "ts", "id", "rule_id")
    fired = spread.mapInPandas(run, "rule int, key string, ts bigint, events array<string>")
    return fired.drop("rule") if single else fired


def suppressed(rules: list[CorrelationRule]) -> list[str]:
    """Base rules whose own alerts give way to a correlation."""
    return sorted({r for c in rules if not c.generate for r in c.rules})


def retro_hunt(events: DataFrame, base: list[Rule], rules: list[CorrelationRule]) -> DataFrame:
    """History replayed: base alerts that are not suppressed, and correlated alerts. Events are scanned once."""
    alerts = Stages(events.sparkSession, "hunt").cut(matched(events, base, rules), "alerts")
    out = alerts.where(~F.col("rule_id").isin(suppressed(rules))).select(*ALERT.fieldNames())
    if not rules:
        return out
    fired = correlate(entries(alerts), rules)
    at = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("rule") + 1)
    named = fired.select(
        at([r.id for r in rules], "string").alias("rule_id"), at([r.title for r in rules], "string").alias("title"), at([SEVERITY_IDS.get(r.level, 3) for r in rules], "int").alias("severity_id"),
        at([r.technique for r in rules], "string").alias("technique"), "events", "ts",
    )
    return out.unionByName(named)
