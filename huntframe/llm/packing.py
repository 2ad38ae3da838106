"""Containers of fixed capacity filled with items of varying size, by bounded best fit.

Items are dealt by a hash of their key to shards of a size that does not depend on the corpus,
and arrive in the order of that hash. A shard is packed online with a small fixed number of
open containers, which bounds a task's memory whatever the items. The open ones are kept in a
bitset keyed by free space: the best fit for an item of size s is the lowest set bit from s
upwards, found by one shift and one mask. If no open container fits and the allowed number is
open, the fullest closes first.

An item larger than a container is cut into full containers and a rest; nothing else is split.

Defined cases: null and zero sizes are no items; repeated keys are items of their own and
arrive the larger first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.session import Stages

#: Items of a shard: small enough for one task, large enough that its open ends do not matter.
SHARD_ITEMS = 50_000
#: Open containers of a shard. More of them hardly fill better: items are small against containers.
OPEN_BINS = 64


class OpenBins:
    """At most ``most`` open containers, found by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        held = self.at[free]
        bin_ = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def _put(self, bin_: int, free: int) -> None:
        if free:
            held = self.at.setdefault(free, [])
            if not held:
                self.bits |= 1 << free
            held.append(bin_)
            self.open += 1

    def place(self, size: int) -> tuple[int, int]:
        """The container of an item and where in it the item starts."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            bin_, free = self.made, self.capacity
            self.made += 1
        self._put(bin_, free - size)
        return bin_, self.capacity - free


def pack(items: DataFrame, capacity: int, open_bins: int = OPEN_BINS, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``(key, part_no, first, size, container_id, position)``.

    ``first`` is where the part starts in its item, ``position`` where it starts in its
    container. A container's number is its shard's times 2^32 plus a count.
    """
    spark = items.sparkSession
    stages = Stages(spark, "packing")
    rows = stages.cut(items.where(F.col(size) > 0).select(F.col(key), F.col(size).cast("bigint").alias("_size")), "items")
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(capacity, open_bins)
        shard = -1
        for f in frames:
            full = f["_size"].to_numpy() // capacity
            rest = f["_size"].to_numpy() % capacity
            shard = int(f["_shard"].iloc[0]) if len(f) else shard
            whole = np.repeat(np.arange(len(f)), full)
            part = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
            ids = bins.made + np.arange(len(whole))
            bins.made += len(whole)
            left = np.flatnonzero(rest)
            placed = np.array([bins.place(s) for s in rest[left].tolist()], dtype=np.int64).reshape(-1, 2)
            out = pd.DataFrame(
                {
                    key: pd.concat([f[key].iloc[whole], f[key].iloc[left]], ignore_index=True),
                    "part_no": np.concatenate([part, full[left]]),
                    "first": np.concatenate([part * capacity, full[left] * capacity]),
                    "size": np.concatenate([np.full(len(whole), capacity), rest[left]]),
                    "container_id": (shard << 32) + np.concatenate([ids, placed[:, 0]]),
                    "position": np.concatenate([np.zeros(len(whole), dtype=np.int64), placed[:, 1]]),
                }
            )
            yield out

    # The shard's number is the partition's, so that one task packs one shard from start to end.
    dealt = rows.repartition(shards, F.xxhash64(key, "_size")).sortWithinPartitions(F.xxhash64(key), key, F.desc("_size")).withColumn("_shard", F.spark_partition_id().cast("long"))
    return dealt.mapInPandas(run, f"{key} {kind}, part_no bigint, first bigint, size bigint, container_id bigint, position bigint")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of space that is used."""
    per = packed.groupBy("container_id").agg(F.sum("size").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("used_share"))
