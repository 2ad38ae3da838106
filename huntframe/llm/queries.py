"""Queries p5 and p7 to p10 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huntframe.llm import bpe, components, knn, packing, reading
from huntframe.session import table

CAPACITY = 2048


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = components.linked_events(table(spark, d, "campaign_links"), table(spark, d, "campaigns"), table(spark, d, "segment_events"))
    return components.components(pairs)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), bpe.vocabulary(spark))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.lengths(table(spark, d, "documents"), bpe.vocabulary(spark)), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.pairs(knn.neighbours(table(spark, d, "event_vectors"), 64))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "reading_level")


QUERIES = {"p5_found": p5_found, "p8_ids": p8_ids, "p9_packed": p9_packed, "p7_found": p7_found, "p10_found": p10_found}
ORACLE: dict[str, str] = {
    # The closure of all links; pairs of every group, so for small tables only.
    "p5_found": """WITH RECURSIVE s AS (SELECT DISTINCT id FROM segment_events), p AS (SELECT 'l' || link_id AS s, unnest([event_a, event_b]) AS id FROM campaign_links UNION SELECT 'c' || campaign_id, unnest(events) FROM campaigns),
      k AS (SELECT DISTINCT p.s, p.id FROM p JOIN s ON p.id = s.id), h AS (SELECT s, min(id) AS hub FROM k GROUP BY s), e AS (SELECT DISTINCT k.id AS a, h.hub AS b FROM k JOIN h ON k.s = h.s WHERE k.id != h.hub),
      u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS id, min(b) AS group_id FROM r GROUP BY a""",
}
