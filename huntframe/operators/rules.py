"""Detection rules compiled to column expressions; a rule set is one pass over the events.

A rule is a mapping (from YAML or a dict): named selections and a condition over them. Each
rule becomes one boolean expression; all rules of a set become one array of alerts per event
that is exploded, so events are read once whatever the number of rules and nothing is joined.
Long rule sets are nested arrays of ``CHUNK`` rules, so that no expression has too many children.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.schema import ALERT, SEVERITY_IDS
from huntframe.schema import fields as as_map

CHUNK = 50

# Other names under which rules know the event's own columns.
ALIASES = {
    **dict.fromkeys(["message", "msg"], ("message", None)),
    **dict.fromkeys(["user", "username", "user.name", "targetusername", "subjectusername"], ("actor", "user")),
    **dict.fromkeys(["host", "hostname", "computer", "computername", "host.name"], ("host", None)),
    **dict.fromkeys(["image", "process", "process.name", "processname"], ("actor", "process")),
    **dict.fromkeys(["actor", "actor.name"], ("actor", None)),
    **dict.fromkeys(["target", "target.name", "targetobject"], ("target", None)),
    **dict.fromkeys(["commandline", "command_line", "cmd"], ("message", None)),
}
MODIFIERS = {"contains", "startswith", "endswith", "re", "all", "cased"}


class RuleError(ValueError):
    pass


@dataclass
class Rule:
    title: str
    detection: dict[str, Any]
    id: str = ""
    level: str = "medium"
    tags: list[str] = field(default_factory=list)
    logsource: dict[str, str] = field(default_factory=dict)

    @property
    def rule_id(self) -> str:
        return self.id or self.title

    @property
    def severity_id(self) -> int:
        return SEVERITY_IDS.get(str(self.level).lower(), 3)

    @property
    def technique(self) -> str | None:
        return next((t.split(".", 1)[1].upper() for t in self.tags if re.match(r"attack\.t\d", t)), None)


def load(source: str | dict) -> Rule:
    """A rule from a mapping or from YAML text."""
    if isinstance(source, str):
        import yaml

        source = yaml.safe_load(source)
    if not isinstance(source, dict) or "title" not in source or "condition" not in (source.get("detection") or {}):
        raise RuleError("a rule has a title and a detection with a condition")
    known = {k: source[k] for k in ("title", "detection", "id", "level", "tags", "logsource") if source.get(k) is not None}
    known["id"] = str(known.get("id", ""))
    rule = Rule(**known)
    compile_rule(rule)
    return rule


def prepared(events: DataFrame) -> DataFrame:
    """Events with the parsed field map and the keyword haystack, computed once for all rules."""
    with_map = events.withColumn("_fields", as_map(F.col("fields_json")))
    values = F.transform(F.array_sort(F.map_entries("_fields")), lambda e: e["value"])
    return with_map.withColumn("_hay", F.lower(F.concat_ws(" ", "message", F.array_join(values, " "), "actor", "host", "target")))


def candidates(name: str) -> Column:
    """Values of a field: the exact key, else keys that differ by case only, else the alias column."""
    low = name.lower()
    entries = F.map_entries("_fields")
    near = F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == low), lambda e: e["value"])
    none = F.array().cast("array<string>")
    other = none
    if low in ALIASES:
        column, kind = ALIASES[low]
        there = F.col(column).isNotNull() if kind is None else (F.col(column).isNotNull() & (F.col("actor_kind") == kind))
        other = F.when(there, F.array(column)).otherwise(none)
    exact = F.try_element_at("_fields", F.lit(name))
    return F.when(exact.isNotNull(), F.array(exact)).when(F.size(near) > 0, near).otherwise(other)


def _regex(pattern: str) -> str:
    return f"(?iud){pattern}"


def _predicate(value: Any, mods: set[str]):
    """A function from a value column to a boolean."""
    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    if "re" in mods:
        return lambda c: c.rlike(_regex(text))
    if "*" in text or "?" in text:
        body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in text)
        if "contains" not in mods:
            body = ("" if "endswith" in mods else "^") + body + ("" if "startswith" in mods else r"\z")
        return lambda c: c.rlike(_regex(body))
    low = text.lower()
    if "contains" in mods:
        return lambda c: F.lower(c).contains(low)
    if "startswith" in mods:
        return lambda c: F.lower(c).startswith(low)
    if "endswith" in mods:
        return lambda c: F.lower(c).endswith(low)
    return lambda c: F.lower(c) == low


def _field(key: str, wanted: Any) -> Column:
    name, *mods = key.split("|")
    if unknown := set(mods) - MODIFIERS:
        raise RuleError(f"unknown modifier: {', '.join(sorted(unknown))}")
    cands = candidates(name)
    values = wanted if isinstance(wanted, list) else [wanted]

    def one(value: Any) -> Column:
        if value is None:
            return F.size(cands) == 0
        test = _predicate(value, set(mods))
        return F.coalesce(F.exists(cands, test), F.lit(False))

    each = [one(v) for v in values]
    if "all" in mods:
        return reduce(lambda a, b: a & b, each, F.lit(True))
    return reduce(lambda a, b: a | b, each, F.lit(False))


def _keyword(value: Any) -> Column:
    return F.col("_hay").contains("" if value is None else str(value).lower())


def _selection(spec: Any) -> Column:
    if isinstance(spec, dict):
        return reduce(lambda a, b: a & b, [_field(k, v) for k, v in spec.items()], F.lit(True))
    if isinstance(spec, list):
        return reduce(lambda a, b: a | b, [_selection(s) if isinstance(s, dict) else _keyword(s) for s in spec], F.lit(False))
    return _keyword(spec)


class _Condition:
    """``or`` below ``and`` below ``not`` below parentheses, names and ``N of`` / ``all of``."""

    def __init__(self, text: str, selections: dict[str, Column]):
        self.tokens = re.findall(r"\(|\)|[^\s()]+", text)
        self.selections, self.at = selections, 0

    def word(self) -> str:
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else ""

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise RuleError("the condition ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Column:
        c = self.any_of()
        if self.at < len(self.tokens):
            raise RuleError(f"the condition goes on with {self.tokens[self.at]!r}")
        return c

    def any_of(self) -> Column:
        c = self.all_of()
        while self.word() == "or":
            self.at += 1
            c = c | self.all_of()
        return c

    def all_of(self) -> Column:
        c = self.negated()
        while self.word() == "and":
            self.at += 1
            c = c & self.negated()
        return c

    def negated(self) -> Column:
        if self.word() == "not":
            self.at += 1
            return ~self.negated()
        return self.primary()

    def primary(self) -> Column:
        t = self.take()
        if t == "(":
            c = self.any_of()
            if self.take() != ")":
                raise RuleError("a parenthesis is left open")
            return c
        if t == ")":
            raise RuleError("a parenthesis closes nothing")
        if (t.lower() == "all" or t.isdigit()) and self.word() == "of":
            self.at += 1
            target = self.take()
            if target.lower() == "them":
                group = list(self.selections.values())
            elif target.endswith("*"):
                group = [c for n, c in self.selections.items() if n.startswith(target[:-1])]
            else:
                group = [self.selections[target]] if target in self.selections else []
            if t.lower() == "all":
                return reduce(lambda a, b: a & b, group) if group else F.lit(False)
            return reduce(lambda a, b: a + b, [c.cast("int") for c in group], F.lit(0)) >= int(t)
        return self.selections.get(t, F.lit(False))


def compile_rule(rule: Rule) -> Column:
    """The rule as a boolean over ``prepared`` events."""
    selections = {n: _selection(s) for n, s in rule.detection.items() if n not in ("condition", "timeframe")}
    condition = rule.detection["condition"]
    parts = [_Condition(c, selections).parse() for c in (condition if isinstance(condition, list) else [condition])]
    return reduce(lambda a, b: a | b, parts)


def match(events: DataFrame, rules: list[Rule], keep: list[str] | dict[str, Column] | None = None) -> DataFrame:
    """One alert row per matching rule and event, in one scan whatever the number of rules.

    ``keep`` adds columns of the event by name, or expressions over ``prepared`` events. They may
    use ``_position``, which is the rule's place in the list.
    """
    keep = {k: F.col(k) for k in keep} if isinstance(keep, list) else keep or {}
    if not rules:
        none = prepared(events).withColumn("_position", F.lit(0)).where(F.lit(False))
        return none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ALERT], *[e.alias(k) for k, e in keep.items()])

    def alert(position: int, r: Rule) -> Column:
        fields = [
            F.lit(position).alias("_position"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("title"), F.lit(r.severity_id).alias("severity_id"),
            F.lit(r.technique).cast("string").alias("technique"), F.array("id").alias("events"), F.col("ts"),
        ]
        return F.when(compile_rule(r), F.struct(*fields))

    hits = [alert(i, r) for i, r in enumerate(rules)]
    parts = [F.array_compact(F.array(*hits[at : at + CHUNK])) for at in range(0, len(hits), CHUNK)]
    rows = prepared(events).withColumn("_alert", F.explode(F.flatten(F.array(*parts)))).withColumn("_position", F.col("_alert._position"))
    return rows.select(*[F.col(f"_alert.{c}").alias(c) for c in ALERT.fieldNames()], *[e.alias(k) for k, e in keep.items()])


def techniques(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(id, technique, place)`` of the matches of rules that name a technique; ``place`` is the rule's in the list."""
    found = match(events, rules, {"place": F.col("_position")})
    return found.where("technique is not null").select(F.col("events")[0].alias("id"), "technique", "place")


def run_cases(spark, rule: Rule, cases: list[dict]) -> DataFrame:
    """A rule's own test cases: ``(name, expected, matched, passed)``."""
    import json

    rows = [(c["name"], bool(c["expect_match"]), c.get("message", ""), json.dumps(c.get("fields", {})), *[c.get("fields", {}).get(k) for k in ("actor", "host", "target")]) for c in cases]
    df = spark.createDataFrame(rows, "name string, expected boolean, message string, fields_json string, actor string, host string, target string").withColumn("actor_kind", F.lit("user"))
    hit = compile_rule(rule)
    return prepared(df).select("name", "expected", hit.alias("matched"), (hit == F.col("expected")).alias("passed"))
