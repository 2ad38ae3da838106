"""Log templates mined by token similarity.

``mine`` is the sequential algorithm over messages in order; it is exact and meant for one
file or one stream partition. ``mine_table`` is for whole tables: messages are dealt to shards
by token count and a hash, each shard mines its own templates, and the templates
of one token count, which are few, are merged by the same rule. Messages never meet in one
task by group; a pass over them assigns each the merged template of its local one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.session import Stages

WILDCARD = "<*>"
#: Distinct messages of a shard; there are as many shards as these make of the table.
SHARD_ROWS = 200_000


class Miner:
    """Clusters of token lists; a message joins the most similar one of its length, the last of equals."""

    def __init__(self, threshold: float = 0.5):
        self.threshold, self.templates = threshold, []
        self.by_length: dict[int, list[int]] = {}

    def add(self, tokens: list[str]) -> int:
        best, most = -1, -1.0
        for i in self.by_length.get(len(tokens), []):
            t = self.templates[i]
            same = sum(a == WILDCARD or a == b for a, b in zip(t, tokens)) / len(t) if t else 1.0
            if same >= most:
                best, most = i, same
        if best >= 0 and most >= self.threshold:
            self.templates[best] = [a if a == b else WILDCARD for a, b in zip(self.templates[best], tokens)]
            return best
        self.templates.append(list(tokens))
        self.by_length.setdefault(len(tokens), []).append(len(self.templates) - 1)
        return len(self.templates) - 1


def mine(messages: list[str], threshold: float = 0.5) -> list[tuple[int, str, list[str]]]:
    """``(template id from 1, template so far, variables)`` of each message in order."""
    m, out = Miner(threshold), []
    for text in messages:
        tokens = text.split()
        i = m.add(tokens)
        t = m.templates[i]
        out.append((i + 1, " ".join(t), [b for a, b in zip(t, tokens) if a == WILDCARD]))
    return out


def mine_table(rows: DataFrame, message: str = "message", order: str = "ts", threshold: float = 0.5, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Assignments ``(message, n, template_id)`` of distinct messages, and templates ``(template_id, template, n)``.

    Up to ``shard_rows`` distinct messages the result is that of ``mine`` over the messages in order.
    """
    stages = Stages(rows.sparkSession, "templates")
    distinct = rows.where(F.col(message).isNotNull()).groupBy(F.col(message).alias("message")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    words = F.filter(F.split("message", r"\s+"), lambda w: w != "")
    distinct = stages.cut(distinct, "distinct")
    shards = -(-distinct.count() // shard_rows) or 1
    distinct = distinct.withColumns({"n_tokens": F.size(words), "shard": F.pmod(F.xxhash64("message"), F.lit(shards))})
    distinct = distinct.repartition("n_tokens", "shard").sortWithinPartitions("n_tokens", "shard", "first", "message")

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, miner = None, Miner(threshold)
        for f in frames:
            out = []
            for msg, n, first, length, shard in f[["message", "n", "first", "n_tokens", "shard"]].itertuples(index=False, name=None):
                if (length, shard) != now:
                    now, miner = (length, shard), Miner(threshold)
                out.append((msg, n, first, length, shard, miner.add(msg.split())))
            yield pd.DataFrame(out, columns=["message", "n", "first", "n_tokens", "shard", "local"])

    assigned = stages.cut(distinct.mapInPandas(local, "message string, n bigint, first bigint, n_tokens int, shard bigint, local int"), "assigned")
    # A local template is what all its messages agree on: position by position, the one token or a wildcard.
    tokens = assigned.select("n_tokens", "shard", "local", "n", "first", F.posexplode_outer(F.filter(F.split("message", r"\s+"), lambda w: w != "")).alias("pos", "token"))
    spots = tokens.groupBy("n_tokens", "shard", "local", "pos").agg(F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(WILDCARD).alias("token"), F.min("first").alias("first"))
    templates = spots.groupBy("n_tokens", "shard", "local").agg(F.min("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("template"))

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        """Local templates of one token count: as many as there are kinds of messages, times the shards."""
        if g.shard.nunique() == 1:
            return g.assign(merged=g.local)[["n_tokens", "shard", "local", "merged", "template"]]
        g = g.sort_values(["first", "template", "shard", "local"])
        miner = Miner(threshold)
        at = [miner.add(t.split()) for t in g.template]
        return pd.DataFrame({"n_tokens": g.n_tokens, "shard": g.shard, "local": g.local, "merged": at, "template": [" ".join(miner.templates[i]) for i in at]})

    names = templates.groupBy("n_tokens").applyInPandas(merged, "n_tokens int, shard bigint, local int, merged int, template string")
    joined = stages.cut(assigned.join(names, ["n_tokens", "shard", "local"]), "joined")
    kinds = joined.groupBy("n_tokens", "merged", "template").agg(F.sum("n").alias("n"), F.min(F.struct("first", "message")).alias("start"))
    # Ids in order of first appearance; templates are few, so one sorted window numbers them.
    kinds = kinds.withColumn("template_id", F.row_number().over(Window.orderBy("start")).cast("bigint"))
    return joined.join(kinds.select("n_tokens", "merged", "template_id"), ["n_tokens", "merged"]).select("message", "n", "template_id"), kinds.select("template_id", "template", "n")
