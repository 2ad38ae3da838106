"""Schemas from short texts, without a running session (Spark's own parser needs one)."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType, "binary": T.BinaryType}


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    return _SIMPLE[text]()


def schema(text: str) -> T.StructType:
    """``"id string, n bigint, xs array<int>"`` as a struct type of nullable fields."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in pairs])
