"""Scores and labels of events as expressions: entropy, anomaly, tactics, embedding text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.functions.text import let
from huntframe.schema import lookup

# Keywords that raise the anomaly score, base scores, tactic and action tables.
ANOMALY_WORDS = ["shadow", "reverse shell", "nc -e", "/bin/sh", "mimikatz", "failed password", "exploit"]
ANOMALY_BASE = {6: 0.9, 5: 0.9, 4: 0.75, 3: 0.5, 2: 0.3}
TACTIC_OF_TECHNIQUE = {
    "T1110": "credential-access", "T1003": "credential-access", "T1552": "credential-access", "T1548": "privilege-escalation", "T1068": "privilege-escalation", "T1078": "privilege-escalation",
    "T1059": "execution", "T1203": "execution", "T1071": "command-and-control", "T1572": "command-and-control", "T1105": "command-and-control",
    "T1041": "exfiltration", "T1048": "exfiltration", "T1021": "lateral-movement", "T1210": "lateral-movement",
}
TACTIC_OF_CLASS = {
    3002: "credential-access", 1007: "execution", 6003: "execution", 4001: "command-and-control", 4002: "command-and-control", 4003: "command-and-control",
    1001: "collection", 1005: "defense-evasion", 1006: "persistence", 201002: "persistence",
}
ACTION_OF_CLASS = {3002: "authenticate", 1007: "execute", 1001: "access", 4001: "connect", 4002: "request", 6003: "invoke", 4003: "resolve", 1005: "load", 1006: "schedule", 201002: "registry"}


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""

    def of(chars: Column) -> Column:
        def share(c: Column) -> Column:
            p = F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
            return -p * F.log2(p)

        return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, b: a + b)

    return F.when(F.length(text) > 0, let(F.split(text, ""), of)).otherwise(F.lit(0.0))


def domain_label(name: Column) -> Column:
    """The label a generator would vary: third from the end, or the first of short names."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-3))).otherwise(F.get(parts, F.lit(0)))


def anomaly(severity_id: Column, message: Column) -> Column:
    low = F.lower(message)
    hits = sum((F.when(low.contains(w), 0.1).otherwise(0.0) for w in ANOMALY_WORDS), F.lit(0.0))
    return F.least(F.lit(1.0), lookup(ANOMALY_BASE, severity_id, F.lit(0.2)) + hits)


def temporal(delta_us: Column) -> Column:
    return 1 / (1 + delta_us / 1e6 / 60)


def edge_score(delta_us: Column, anomaly_after: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 + 0.25 * temporal(delta_us) + 0.30 * anomaly_after)


def tactic(technique: Column, ocsf_class: Column) -> Column:
    return F.coalesce(lookup(TACTIC_OF_TECHNIQUE, F.substring(technique, 1, 5)), lookup(TACTIC_OF_CLASS, ocsf_class, F.lit("unknown")))


def action(ocsf_class: Column) -> Column:
    return lookup(ACTION_OF_CLASS, ocsf_class, F.lit("event"))


def time_gap(delta_us: Column) -> Column:
    """Seconds below 90, else minutes with one digit; rounded first, as formatting rounds otherwise."""
    s = delta_us / 1e6
    return F.when(s < 90, F.concat(F.round(s).cast("bigint").cast("string"), F.lit("s"))).otherwise(F.format_string("%.1fmin", F.round(s / 60, 1)))


def confidence(steps: Column, tactics: Column, mean_anomaly: Column) -> Column:
    x = 0.2 + 0.15 * (steps - 1) + 0.10 * F.greatest(tactics - 1, F.lit(0)) + 0.3 * mean_anomaly
    return F.when(steps < 2, 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(0.99)))


def event_text(class_name: Column, actor_kind: Column, actor: Column, target_kind: Column, target: Column, host: Column, message: Column) -> Column:
    """One line that states an event; missing parts are left out."""

    def pair(name: str, kind: Column, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), F.coalesce(kind, F.lit("")), F.lit(":"), value))

    return F.concat_ws(
        " ",
        F.concat(F.lit("class="), class_name),
        pair("actor", actor_kind, actor),
        pair("target", target_kind, target),
        F.when(host.isNotNull(), F.concat(F.lit("host="), host)),
        F.when(message != "", F.concat(F.lit("msg="), message)),
    )


#: Places of a hashed embedding.
DIM = 128


def hash_places(text: Column) -> Column:
    """The words of a text hashed: per word its place from 1, negative where it counts minus one. A short array that stands for a long vector."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")

    def place(digest: Column) -> Column:
        at = F.conv(F.substring(digest, 39, 2), 16, 10).cast("int") % DIM + 1
        return F.when(F.conv(F.substring(digest, 32, 1), 16, 10).cast("int") % 4 >= 2, -at).otherwise(at)

    return F.transform(F.transform(tokens, lambda t: F.sha1(t)), place)


def dense(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole-numbered vectors, one per row, of ``hash_places`` arrays laid end to end."""
    flat = flat.astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row * DIM + np.abs(flat) - 1, np.sign(flat), minlength=len(sizes) * DIM).reshape(-1, DIM)


def _unit(places: pd.Series) -> pd.Series:
    sizes = places.map(lambda p: 0 if p is None else len(p)).to_numpy(dtype=np.int64)
    flat = np.concatenate([np.asarray(p) for p in places if p is not None and len(p)]) if sizes.sum() else np.zeros(0)
    v = dense(flat, sizes)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return pd.Series([None if p is None else x for p, x in zip(places, v.tolist())], dtype=object)


def hash_embed(text: Column) -> Column:
    """A unit vector of hashed words: each adds plus or minus one to the place its SHA-1 names. No words give the zero vector."""
    return F.pandas_udf(_unit, T.ArrayType(T.DoubleType()))(hash_places(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
