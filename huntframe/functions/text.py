"""Small text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def stripped(text: Column) -> Column:
    """Without white space (Unicode's too) at both ends."""
    return F.regexp_replace(text, f"^{_EDGE}|{_EDGE}$", "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_map(entries: Column) -> Column:
    """An array of ``(k, v)`` as a map in the order of its keys; of repeated keys the greatest value holds, null keys are left out."""

    def last(sorted_: Column) -> Column:
        ahead = lambda i: F.get(sorted_, i + 1)["k"]
        return F.map_from_entries(F.filter(sorted_, lambda e, i: F.coalesce(ahead(i) != e["k"], F.lit(True))))

    return let(F.array_sort(F.filter(entries, lambda e: e["k"].isNotNull())), last)
