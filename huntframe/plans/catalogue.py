"""Every core query by name, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from huntframe.plans import analytics, data_quality, detection, hunting

MODULES = [analytics, detection, hunting, data_quality]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
