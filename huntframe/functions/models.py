"""Models by contract: ``embed`` maps texts to vectors of one length, ``score`` maps numbers to a score from 0 to 1.

A model is a callable over a whole Arrow batch, given as such or as ``module:name`` that every
executor can import. It runs vectorised, once per batch. A batch that the model fails on, or
answers in the wrong shape, falls back: to the hashed embedding for texts, to the given default
for scores, so that a broken model degrades results and never stops a job.
"""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.functions.scores import DIM, hash_embed

log = logging.getLogger(__name__)


def resolve(model: Callable | str) -> Callable:
    if callable(model):
        return model
    module, _, name = model.partition(":")
    return getattr(importlib.import_module(module), name)


def embed(text: Column, model: Callable | str, dim: int = DIM) -> Column:
    """Vectors of length ``dim``, scaled to length one; null texts have none. ``model``: list of texts to an array (texts, dim)."""

    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        try:
            v = np.asarray(resolve(model)(texts[there].tolist()), dtype=np.float64)
            if v.shape != (int(there.sum()), dim) or not np.isfinite(v).all():
                raise ValueError(f"the model answered {v.shape}")
        except Exception as e:  # whatever the model does, the batch falls back
            log.warning("embedding falls back to hashed words: %s", e)
            return out
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        out[there.to_numpy()] = pd.Series(v.tolist(), dtype=object).to_numpy()
        return out

    made = F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text)
    fallback = hash_embed(text) if dim == DIM else F.when(text.isNotNull(), F.array_repeat(F.lit(0.0), dim))
    return F.coalesce(made, fallback)


def score(features: list[Column], model: Callable | str, default: float = 0.0) -> Column:
    """A score from 0 to 1 of numeric features; nulls count as 0. ``model``: an array (rows, features) to an array (rows)."""
    width = len(features)

    def run(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, width))
        try:
            y = np.asarray(resolve(model)(x), dtype=np.float64)
            if y.shape != (len(x),) or not np.isfinite(y).all():
                raise ValueError(f"the model answered {y.shape}")
        except Exception as e:
            log.warning("scores fall back to %s: %s", default, e)
            y = np.full(len(x), default)
        return pd.Series(np.clip(y, 0.0, 1.0))

    packed = F.array(*[F.coalesce(f.cast("double"), F.lit(0.0)) for f in features])
    return F.pandas_udf(run, T.DoubleType())(packed)
