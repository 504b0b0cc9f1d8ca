"""Connected components by alternating large-star and small-star steps, as joins and
group-bys over written tables; no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.llm.shared import stored


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node of
    ``edges`` (u, v long). Each round pre-aggregates its minima, so a node with very many
    neighbours costs no single task more than its share of the joins."""
    edges = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "links")
    last = _signature(edges)
    if not last[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        large = stored(large, "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", "m")).distinct())
        edges = stored(small, "links-small")
        now = _signature(edges)
        if now == last:
            break
        last = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
