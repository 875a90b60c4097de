"""Order-dependent building blocks that stay distributed when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each task to ``k`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe key equality, keeping the left key columns."""
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in keys])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column,
                  out: str) -> DataFrame:
    """Running sum of ``value`` per key in ``order``, the current row included.

    ``bucket`` must not decrease along ``order``. Totals per bucket give each bucket its starting point, and the rows
    are then summed inside their own bucket, so a task holds one bucket of one key and never the whole key.
    """
    keys = list(keys)
    rows = df.withColumn("_rt_bucket", bucket).withColumn("_rt_value", value)
    totals = rows.groupBy(*keys, "_rt_bucket").agg(F.sum("_rt_value").alias("_rt_total"))
    before = Window.partitionBy(*keys).orderBy("_rt_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_rt_bucket", F.coalesce(F.sum("_rt_total").over(before), F.lit(0)).alias("_rt_base"))
    inside = Window.partitionBy(*keys, "_rt_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _match(rows, base, keys + ["_rt_bucket"])
    return (joined.withColumn(out, F.col("_rt_base") + F.sum("_rt_value").over(inside))
            .drop("_rt_bucket", "_rt_value", "_rt_base"))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """Row number per key in ``order``, computed bucket by bucket (see ``running_total``)."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("long"), out)


def spans(df: DataFrame, order: str, size: int, before: int) -> DataFrame:
    """Cut consecutively numbered rows into spans of ``size``: adds ``span`` and ``copied``.

    The last ``before`` rows of a span are copied to the front of the next one, so a window over (key, span) sees the
    rows just before each of its own rows. Drop the copies afterwards.
    """
    here = F.floor(F.col(order) / size)
    own = F.struct(here.alias("span"), F.lit(False).alias("copied"))
    after = F.struct((here + 1).alias("span"), F.lit(True).alias("copied"))
    places = F.when(F.col(order) % size >= size - before, F.array(own, after)).otherwise(F.array(own))
    return df.withColumn("_place", F.explode(places)).select(*df.columns, "_place.span", "_place.copied")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    method: str = "nearest", width: float = 1.0) -> DataFrame:
    """Exact quantiles per key with row count ``n``.

    ``nearest`` takes the value of rank ``ceil(p * n)``; ``linear`` interpolates at position ``p * (n - 1)``. Equal
    values are counted before any shuffle of rows, and ranks come from ``running_total`` over buckets of ``width``.
    """
    keys = list(keys)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(hist, keys, [value], F.floor(F.col(value) / F.lit(width)), F.col("_n"), "_cum")
    totals = hist.groupBy(*keys).agg(F.sum("_n").alias("n"))
    if keys:
        joined = _match(ranked, totals, keys)
    else:
        joined = ranked.withColumn("n", totals.select("n").scalar())
    aggs: list[Column] = []
    for name, p in probs.items():
        if method == "nearest":
            target = F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))
            aggs.append(F.min(F.when(F.col("_cum") >= target, F.col(value))).alias(name))
        else:
            pos = F.lit(p) * (F.col("n") - 1)
            aggs.append(F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"))
            aggs.append(F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"))
    out = joined.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    if method == "linear":
        for name, p in probs.items():
            pos = F.lit(p) * (F.col("n") - 1)
            frac = pos - F.floor(pos)
            out = out.withColumn(
                name, F.col(f"_lo_{name}") * (1 - frac) + F.col(f"_hi_{name}") * frac
            ).drop(f"_lo_{name}", f"_hi_{name}")
    return out
