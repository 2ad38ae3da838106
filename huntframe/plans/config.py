"""Configuration as data: validated, compared with the running one, secrets hidden."""

from __future__ import annotations

from typing import Any

from huntframe.plans.dsl import duration_us

INPUTS = {"file", "syslog_udp", "syslog_tcp", "telemetry"}
CODECS = {"raw", "json", "syslog", "cef", "leef", "csv"}
SINKS = {"index", "rules", "correlation"}
SECRET = ("password", "secret", "token", "key")


def validate(config: dict[str, Any]) -> tuple[list[str], list[str]]:
    """Errors and warnings."""
    errors, warnings = [], []
    names = set()
    for i in config.get("inputs", []):
        name = i.get("id", "")
        if not name or name in names:
            errors.append(f"input {name!r}: ids are unique and not empty")
        names.add(name)
        if i.get("type") not in INPUTS:
            warnings.append(f"input {name!r}: type {i.get('type')!r} is skipped")
        if i.get("codec", "raw") not in CODECS:
            warnings.append(f"input {name!r}: codec {i.get('codec')!r} is read as raw")
    routed = set()
    for p in config.get("pipelines", []):
        errors += [f"pipeline {p.get('id')!r}: unknown input {i!r}" for i in p.get("inputs", []) if i not in names]
        errors += [f"pipeline {p.get('id')!r}: unknown sink {s!r}" for s in p.get("route", []) if s not in SINKS]
        routed |= set(p.get("route", []))
    if config.get("pipelines") and "index" not in routed:
        warnings.append("no pipeline leads to the index: it takes all inputs")
    for tier, age in config.get("retention", {}).items():
        if duration_us(str(age)) is None:
            errors.append(f"retention {tier}: {age!r} is no duration")
    return errors, warnings


def redacted(config: Any) -> Any:
    """The same structure with secret values hidden."""
    if isinstance(config, dict):
        return {k: "***" if any(s in k.lower() for s in SECRET) and not isinstance(v, (dict, list)) else redacted(v) for k, v in config.items()}
    return [redacted(x) for x in config] if isinstance(config, list) else config


def plan(old: dict[str, Any], new: dict[str, Any]) -> list[tuple[str, str]]:
    """``(add | remove | change, path)`` that lead from one configuration to another."""

    def flat(x: Any, at: str = "") -> dict[str, Any]:
        if isinstance(x, dict):
            return {k: v for n, c in x.items() for k, v in flat(c, f"{at}.{n}" if at else str(n)).items()}
        if isinstance(x, list):
            return {k: v for n, c in enumerate(x) for k, v in flat(c, f"{at}.{c['id'] if isinstance(c, dict) and 'id' in c else n}").items()}
        return {at: x}

    a, b = flat(old), flat(new)
    return sorted([("add", k) for k in b.keys() - a.keys()] + [("remove", k) for k in a.keys() - b.keys()] + [("change", k) for k in a.keys() & b.keys() if a[k] != b[k]])
