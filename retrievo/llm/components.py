"""Connected components of a link table by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievo.staging import scratch, stage


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: the smallest node that links reach. Nodes without a link to another are not listed.

    Every round turns each node's neighbours towards the smallest one seen, in the number of rounds that the longest
    chain's logarithm needs. Minima are aggregated before they are shuffled and hubs are split by the skew join, so a
    node with very many links stays in no single task. Nulls are no nodes.
    """
    with scratch(links.sparkSession) as own:
        pairs = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
        before = _state(pairs)
        while before[0]:
            both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
            large = stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .distinct(), "cc-large")
            low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
            small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            pairs = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
            after = _state(pairs)
            if after == before:
                break
            before = after
        roots = pairs.select("v", "v").toDF("node", "component")
        return own.keep(pairs.select("u", "v").toDF("node", "component").union(roots).distinct())
