"""Percentiles of any time range from stored sketches: one small sketch for each label set and time bucket.

A sketch is made in one pass with partial aggregation, has a size that does not follow the number of values, and merges
with others, so a range is answered from its buckets without the events. Its rank error is below ``RANK_ERROR`` with
high probability, whatever the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from retrievo.operators.telemetry import TIMER_PERCENTILES
from retrievo.sources.index import require_writable

K = 400            # items of a sketch's top level
RANK_ERROR = 0.01  # of a percentile, as a share of all values


def timer_sketches(df: DataFrame, tags: Sequence[str], value: str = "value", bucket: str = "1 minute", k: int = K) -> DataFrame:
    """``at`` (start of the bucket), tags, n, total, max and ``sketch`` of the values; negative ones count as 0, null ones
    do not count."""
    rows = df.filter(F.col(value).isNotNull()).withColumn("_v", F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    return rows.groupBy(F.window("ts", bucket).alias("_w"), *tags).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.max("_v").alias("max"),
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch")).select(
        F.col("_w.start").alias("at"), *tags, "n", "total", "max", "sketch")


def write_sketches(sketches: DataFrame, path: str, read_only: bool = False) -> None:
    """Append sketches, a folder for each day. A bucket may have several rows, as late values come in runs of their own."""
    require_writable(read_only)
    sketches.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def read_sketches(spark, path: str, start, end) -> DataFrame:
    """Sketches of the buckets that begin in ``start`` (inclusive) to ``end`` (exclusive); other days are not read."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return spark.read.parquet(path).filter((F.col("day") >= F.to_date(first)) & (F.col("day") <= F.to_date(last))
                                           & (F.col("at") >= first) & (F.col("at") < last)).drop("day")


def sketched_percentiles(sketches: DataFrame, tags: Sequence[str], percentiles: dict[str, float] | None = None,
                         k: int = K) -> DataFrame:
    """Tags, n, total, max and percentiles of all buckets given, merged."""
    percentiles = percentiles or TIMER_PERCENTILES
    merged = sketches.groupBy(*tags).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("max").alias("max"),
                                         F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    return merged.select(*tags, "n", "total", "max", *[
        F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(name) for name, p in percentiles.items()])


def rank_errors(percentiles: DataFrame, df: DataFrame, tags: Sequence[str], value: str = "value",
                wanted: dict[str, float] | None = None) -> DataFrame:
    """Tags and, for each percentile, how far its rank among the values lies from the wanted one, as a share of them.

    Values equal to the percentile take up a range of ranks; the nearest of them counts.
    """
    wanted = wanted or TIMER_PERCENTILES
    rows = df.filter(F.col(value).isNotNull()).select(*tags, F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    joined = rows.join(F.broadcast(percentiles.select(*tags, *wanted)), list(tags)) if tags else \
        rows.crossJoin(F.broadcast(percentiles.select(*wanted)))
    shares = [F.struct((F.sum((F.col("_v") < F.col(name)).cast("long")) / F.count("*")).alias("below"),
                       (F.sum((F.col("_v") <= F.col(name)).cast("long")) / F.count("*")).alias("upto")).alias(name)
              for name in wanted]
    apart = [F.greatest(F.col(f"{name}.below") - F.lit(p), F.lit(p) - F.col(f"{name}.upto"), F.lit(0.0)).alias(name)
             for name, p in wanted.items()]
    return joined.groupBy(*tags).agg(*shares).select(*tags, *apart)
