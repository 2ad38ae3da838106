"""The SQL surface: queries over the table ``events`` (and any others given), nothing else."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Function names of other SQL dialects and their Spark forms.
RENAMED = {
    "array_concat": "concat", "array_has": "array_contains", "array_length": "size", "array_slice": "slice", "array_to_string": "array_join", "date_bin": "date_trunc", "ends_with": "endswith",
    "generate_series": "sequence", "list_extract": "element_at", "make_array": "array", "starts_with": "startswith", "strpos": "instr", "to_hex": "hex", "to_timestamp_micros": "timestamp_micros", "unnest": "explode",
}


class SqlError(ValueError):
    pass


def translated(text: str) -> str:
    """Other dialects' function names outside string literals, rewritten to Spark's."""
    parts = re.split(r"('(?:[^']|'')*')", text)
    name = re.compile(r"\b(" + "|".join(RENAMED) + r")\s*\(", re.I)
    return "".join(p if i % 2 else name.sub(lambda m: RENAMED[m[1].lower()] + "(", p) for i, p in enumerate(parts))


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Runs one read-only statement; tables are given by name and seen by this query alone."""
    body = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";")
    if not re.match(r"(select|with|values|from|\()", body, re.I) or ";" in re.sub(r"'(?:[^']|'')*'", "", body):
        raise SqlError("only one query per call, and only queries")
    names = {n: f"hf_{abs(hash((n, id(df)))):x}" for n, df in tables.items()}
    for n, df in tables.items():
        df.createOrReplaceTempView(names[n])
    views = ", ".join(f"{n} AS (SELECT * FROM {names[n]})" for n in tables)
    body = translated(body)
    m = re.match(r"with\s+(recursive\s+)?", body, re.I)
    try:
        if m:
            return spark.sql(f"WITH {'RECURSIVE ' if m[1] else ''}{views}, {body[m.end() :]}")
        return spark.sql(f"WITH {views} {body}")
    finally:
        for n in names.values():
            spark.catalog.dropTempView(n)


def describe(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Schema discovery: name, type, nullable."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
