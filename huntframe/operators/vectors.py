"""Exact nearest vectors of a stated set of queries, in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks of the corpus that share a key.
BLOCK, GROUP = 4_096, 16


def _blocks(vectors: DataFrame, id_: str, vec: str, block: int) -> DataFrame:
    """Vectors packed row after row: ``(ids binary, data binary, dim)`` per block."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), block):
                part = f.iloc[a : a + block]
                m = np.stack(part.vec.to_numpy()).astype(np.float64)
                norm = np.linalg.norm(m, axis=1)
                m, ids = m[norm > 0] / norm[norm > 0][:, None], part.id.to_numpy(np.int64)[norm > 0]
                if len(ids):
                    yield pd.DataFrame({"ids": [ids.tobytes()], "data": [m.tobytes()], "dim": [m.shape[1]]})

    rows = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & F.col(id_).isNotNull()).select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    return rows.mapInPandas(pack, "ids binary, data binary, dim int")


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, id_: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(id, other, cosine)``: the k most similar vectors of each query, itself left out; ties to the smaller id.

    Every block of queries meets every block of the corpus once; a meeting keeps k per query.
    """

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                qi, ci = np.frombuffer(r.ids, np.int64), np.frombuffer(r.other_ids, np.int64)
                s = np.round(np.frombuffer(r.data).reshape(len(qi), -1) @ np.frombuffer(r.other_data).reshape(len(ci), -1).T, 6)
                s[qi[:, None] == ci[None, :]] = -np.inf
                n = min(k, len(ci))
                least = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                i, j = np.nonzero((s >= least) & np.isfinite(s))
                order = np.lexsort((ci[j], -s[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(qi)))[i] < n
                yield pd.DataFrame({"id": qi[i[keep]], "other": ci[j[keep]], "cosine": s[i[keep], j[keep]]})

    # Blocks against blocks: the stated query set against all rows. The corpus is dealt to groups, and
    # every block of queries goes to each group of its dimension, so no key holds more than GROUP blocks.
    q = _blocks(queries, id_, vec, BLOCK // 4)
    c = _blocks(corpus, id_, vec, BLOCK)
    groups = max(1, -(-corpus.count() // (GROUP * BLOCK)))
    c = c.select(F.col("ids").alias("other_ids"), F.col("data").alias("other_data"), F.col("dim").alias("other_dim"), F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("other_group"))
    q = q.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    met = q.join(c, (F.col("dim") == F.col("other_dim")) & (F.col("group") == F.col("other_group")))
    pairs = met.select("ids", "data", "other_ids", "other_data").mapInPandas(meet, "id bigint, other bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
