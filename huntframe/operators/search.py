"""Full-text search: terms, phrases, fields, AND/OR/NOT, + and -, parentheses, ranges.

The query is compiled into one boolean expression over the event columns. Tokenized columns
are seen as their lower-case words between single spaces, so a word or phrase is one
``contains`` that stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZED = ("message", "actor", "target")
EXACT = ("host", "id", "tenant")
NUMERIC = ("ts", "ocsf_class", "severity_id")

_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND|&&)\b|(OR|\|\|)\b|(NOT|!)\b|([+-])(?=\S)|(?:([A-Za-z_]+):)?(?:"([^"]*)"|\[\s*(\S+)\s+TO\s+(\S+?)\s*\]|([^\s()"]+)))')


class SearchError(ValueError):
    pass


def words(c: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _phrase(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def _leaf(field: str | None, text: str, searched: tuple[str, ...]) -> Column:
    phrase = _phrase(text)

    def one(name: str) -> Column:
        if name in EXACT:
            return F.coalesce(F.col(name) == text, F.lit(False))
        if name in NUMERIC:
            return F.col(name) == F.lit(text).try_cast("bigint")
        return F.coalesce(F.replace(words(F.col(name)), F.lit("  "), F.lit(" ")).contains(f" {phrase} "), F.lit(False)) if phrase else F.lit(False)

    if field == "severity":
        field = "severity_id" if text.isdigit() else "severity"
    if field:
        return one(field)
    found = F.lit(False)
    for name in searched:
        found = found | one(name)
    return found


def parse(text: str, searched: tuple[str, ...] = (*TOKENIZED, "host")) -> Column:
    """A query text as a boolean column; an empty text matches everything."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SearchError(f"can't read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek(group: int) -> bool:
        return pos < len(tokens) and tokens[pos].group(group) is not None

    def any_of() -> Column:
        nonlocal pos
        c = all_of()
        while peek(4):
            pos += 1
            c = c | all_of()
        return c

    def all_of() -> Column:
        nonlocal pos
        c = unary()
        while pos < len(tokens) and not peek(2) and not peek(4):
            if peek(3):
                pos += 1
            c = c & unary()
        return c

    def unary() -> Column:
        nonlocal pos
        if peek(5) or (peek(6) and tokens[pos].group(6) == "-"):
            pos += 1
            return ~unary()
        if peek(6):
            pos += 1
            return unary()
        if peek(1):
            pos += 1
            c = any_of()
            if not peek(2):
                raise SearchError("a parenthesis is left open")
            pos += 1
            return c
        if pos >= len(tokens) or peek(2) or peek(3) or peek(4):
            raise SearchError("a term is missing")
        m = tokens[pos]
        pos += 1
        if m.group(9):
            lo, hi = (None if x == "*" else int(x) for x in (m.group(9), m.group(10)))
            c = F.col(m.group(7) or "ts")
            return (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c <= hi)
        return _leaf(m.group(7), m.group(8) if m.group(8) is not None else m.group(11), searched)

    if not tokens:
        return F.lit(True)
    c = any_of()
    if pos < len(tokens):
        raise SearchError("a parenthesis closes nothing")
    return c


def search(events: DataFrame, text: str, limit: int | None = 50) -> DataFrame:
    """Matching events, newest first; the limit is clamped to 1..1000, None gives all."""
    found = events.where(parse(text))
    if limit is None:
        return found
    return found.orderBy(F.desc("ts"), "id").limit(min(1000, max(1, limit)))
