"""Metric events: rollups, percentiles, rates, ratios, alerts and request quotas.

Event tables have ``ts`` (timestamp), label columns and ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from retrievo.operators.ordered import exact_quantiles, top_k

# Latency objectives and timer percentiles.
SLO_SECONDS = (0.1, 0.5, 2.0)
TIMER_PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
MIN_DENOMINATOR = 0.001


def counter_rollup(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    return df.groupBy(*tags).agg(F.count(F.lit(1)).alias("total"))


def timer_percentiles(df: DataFrame, tags: Sequence[str], value: str = "value", width: float = 1.0) -> DataFrame:
    """Count, sum, maximum and percentiles of a summary or timer; negative values count as 0."""
    clamped = df.withColumn("_v", F.greatest(F.col(value), F.lit(0.0)))
    totals = clamped.groupBy(*tags).agg(F.sum("_v").alias("total"), F.max("_v").alias("max"))
    return exact_quantiles(clamped, list(tags), "_v", TIMER_PERCENTILES, "nearest", width).join(totals, list(tags))


def slo_buckets(df: DataFrame, tags: Sequence[str], value: str = "value",
                bounds: Sequence[float] = SLO_SECONDS) -> DataFrame:
    """Cumulative counts per upper bound ``le``; the last bucket has le = infinity."""
    counts = [F.count(F.when(F.greatest(F.col(value), F.lit(0.0)) <= b, 1)).alias(f"_{i}")
              for i, b in enumerate(bounds)]
    wide = df.groupBy(*tags).agg(*counts, F.count(F.lit(1)).alias("_all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("cumulative")))
    return wide.select(*tags, F.explode(F.array(*rows)).alias("_b")).select(*tags, "_b.*")


def rate(df: DataFrame, labels: Sequence[str], window: str = "5 minutes", slide: str = "1 minute",
         seconds: int = 300) -> DataFrame:
    """Events per second over a sliding window: at, labels, rate."""
    w = F.window("ts", window, slide)
    return df.groupBy(w.alias("_w"), *labels).agg((F.count(F.lit(1)) / F.lit(seconds)).alias("rate")).select(
        F.col("_w.end").alias("at"), *labels, "rate")


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets (le, cumulative), linear inside the bucket that reaches it.

    The lowest bucket starts at 0; a quantile in the infinite bucket takes the highest finite bound; no observations
    give null. There is one row per bound and key, so a key's window is small.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    total = F.max("cumulative").over(Window.partitionBy(*keys))
    steps = (buckets.withColumn("_n", total)
             .withColumn("_lo", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
             .withColumn("_below", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
             .withColumn("_rank", F.lit(q) * F.col("_n")))
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * F.try_divide(
        F.col("_rank") - F.col("_below"), F.col("cumulative") - F.col("_below"))
    point = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside)
    reached = (F.col("cumulative") >= F.col("_rank")) & (F.col("_n") > 0)
    out = steps.groupBy(*keys).agg(F.min(F.when(reached, F.struct("le", point.alias("v")))).alias("_first"))
    return out.select(*keys, F.col("_first.v").alias("quantile"))


def ratio(df: DataFrame, numerator: Column, keys: Sequence[Column | str], seconds: float,
          denominator: Column | None = None) -> DataFrame:
    """Rate of matching events over the rate of all events, the denominator at least 0.001 per second.

    ``numerator`` is a condition, or a number to sum. ``denominator`` is a condition; all events by default.
    """
    num = F.sum(numerator.cast("double"))
    den = F.count(F.lit(1)) if denominator is None else F.count(F.when(denominator, 1))
    return df.groupBy(*keys).agg(
        (num / seconds / F.greatest(den / F.lit(float(seconds)), F.lit(MIN_DENOMINATOR))).alias("ratio"))


def windowed_ratio(df: DataFrame, numerator: Column, window: str, slide: str, seconds: float,
                   labels: Sequence[str] = ()) -> DataFrame:
    """``ratio`` per sliding window: at, labels, ratio."""
    out = ratio(df.withColumn("_num", numerator), F.col("_num"),
                [F.window("ts", window, slide).alias("_w"), *labels], seconds)
    return out.select(F.col("_w.end").alias("at"), *labels, "ratio")


def increase(df: DataFrame, labels: Sequence[str], window: str = "1 day") -> DataFrame:
    return df.groupBy(F.window("ts", window).alias("_w"), *labels).agg(F.count(F.lit(1)).alias("increase")).select(
        F.col("_w.start").alias("day"), *labels, "increase")


def sustained(points: DataFrame, limit: float, step_seconds: int, hold_seconds: int, labels: Sequence[str] = (),
              value: str = "ratio") -> DataFrame:
    """Spans in which a value stays above its limit at consecutive evaluation points for ``hold_seconds``.

    ``points`` has one row per label set and evaluation time ``at``; its size follows the time range and not the number
    of events. A missing point ends a span.
    """
    over = points.filter(F.col(value) > limit).withColumn("_s", F.unix_timestamp(F.col("at").cast("timestamp")))
    w = Window.partitionBy(*labels).orderBy("_s")
    island = F.floor(F.col("_s") / step_seconds) - F.row_number().over(w)
    spans = over.withColumn("_island", island).groupBy(*labels, "_island").agg(
        F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.max(value).alias("peak"),
        (F.max("_s") - F.min("_s")).alias("held_seconds"))
    return spans.filter(F.col("held_seconds") >= hold_seconds).drop("_island")


def _epoch() -> Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


def bucketed(df: DataFrame, window_s: int) -> DataFrame:
    """Add the epoch bucket and the seconds until it ends."""
    return df.withColumn("bucket", F.floor(_epoch() / window_s)).withColumn(
        "retry_after", F.greatest(F.lit(1), window_s - _epoch() % window_s))


def _with_prior(df: DataFrame, keys: Sequence[str], prior: DataFrame | None) -> DataFrame:
    """Add the requests ``_n`` and tokens ``_used0`` that earlier batches counted for the same identity and bucket."""
    if prior is None:
        return df.withColumn("_n", F.lit(0)).withColumn("_used0", F.lit(0))
    return (df.join(prior.select(*keys, "n", "used"), list(keys), "left")
            .withColumn("_n", F.coalesce("n", F.lit(0))).withColumn("_used0", F.coalesce("used", F.lit(0)))
            .drop("n", "used"))


def rate_limit(df: DataFrame, identity: str, limit: int = 30, window_s: int = 60, request: str = "event_id",
               prior: DataFrame | None = None) -> DataFrame:
    """Add ``allowed`` and ``retry_after``: the first ``limit`` requests of an identity per bucket pass.

    The last passing request of each bucket is found with a bounded top-k and joined back, so a bucket full of requests
    is never ordered in one task. ``prior`` (identity, bucket, n, used) holds the counts of earlier batches.
    """
    marked = bucketed(df, window_s)
    keys = [identity, "bucket"]
    first = _with_prior(top_k(marked.select(*keys, "ts", request), keys, [F.asc("ts"), F.asc(request)], limit),
                        keys, prior)
    cut = first.filter(F.col("rank") + F.col("_n") <= limit).groupBy(*keys).agg(
        F.max(F.struct("ts", request)).alias("_last"))
    return marked.join(cut, keys, "left").withColumn(
        "allowed", F.coalesce(F.struct("ts", request) <= F.col("_last"), F.lit(False))).withColumn(
        "retry_after", F.when(~F.col("allowed"), F.col("retry_after"))).drop("_last")


def request_tokens(text_length: Column, rate_per_char: float = 1.0, overhead: int = 256) -> Column:
    return F.lit(max(1, overhead)) + F.ceil(text_length * F.lit(max(rate_per_char, 0.01)))


def token_budget(df: DataFrame, identity: str, text_length: Column, per_min: int = 12_000, per_request: int = 4_000,
                 max_chars: int = 12_000, requests: int = 30, window_s: int = 60, rate_per_char: float = 1.0,
                 overhead: int = 256, request: str = "event_id", prior: DataFrame | None = None) -> DataFrame:
    """Add bucket, tokens, retry_after and ``decision``: the first check that rejects a request, or ``allowed``.

    ``retry_after``: null for allowed requests, 0 where a smaller request is needed, else the seconds left of the bucket.
    Order: input length, request rate, tokens of the request, tokens of the identity in the bucket. Rejected requests
    count towards the rate, and those that reach the last check use budget even when they fail it. Each request costs
    at least ``overhead`` tokens, so at most ``per_min / overhead`` requests of a bucket can pass the last check and
    only that many are ordered.
    """
    sized = df.withColumn("_chars", text_length).withColumn("tokens", request_tokens(
        F.col("_chars"), rate_per_char, overhead))
    too_long = sized.filter(F.col("_chars") > max_chars)
    limited = rate_limit(sized.filter(F.col("_chars") <= max_chars), identity, requests, window_s, request, prior)
    costly = limited.filter("allowed").filter(F.col("tokens") > per_request)
    last = limited.filter("allowed").filter(F.col("tokens") <= per_request)
    keys = [identity, "bucket"]
    reach = per_min // (max(1, overhead)) + 1
    first = _with_prior(top_k(last.select(*keys, "ts", request, "tokens"), keys, [F.asc("ts"), F.asc(request)], reach),
                        keys, prior)
    used = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("rank"))  # at most ``reach`` rows per bucket
    passing = first.withColumn("_used", used + F.col("_used0")).filter(F.col("_used") <= per_min).select(
        *keys, F.col(request), F.lit(True).alias("_pass"))
    keep = [*df.columns, "bucket", "retry_after", "tokens", "decision"]
    decided = last.join(passing, [*keys, request], "left").withColumn(
        "decision", F.when(F.col("_pass"), "allowed").otherwise("cost_budget_exceeded"))
    parts = [
        bucketed(too_long, window_s).withColumn("decision", F.lit("request_too_large")),
        limited.filter("NOT allowed").withColumn("decision", F.lit("rate_limit_exceeded")),
        costly.withColumn("decision", F.lit("request_cost_limit_exceeded")),
        decided,
    ]
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    left = F.greatest(F.lit(1), window_s - _epoch() % window_s)
    return out.withColumn("retry_after", F.when(F.col("decision") == "allowed", None).when(
        F.col("decision").isin("request_too_large", "request_cost_limit_exceeded"), 0).otherwise(left))


def quota_counters(decided: DataFrame, identity: str, prior: DataFrame | None = None) -> DataFrame:
    """identity, bucket, n, used after the decided requests: what a following batch needs as ``prior``."""
    keys = [identity, "bucket"]
    spends = F.col("decision").isin("allowed", "cost_budget_exceeded")
    counts = decided.filter("decision <> 'request_too_large'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(spends, F.col("tokens")).otherwise(0)).alias("used"))
    both = counts if prior is None else counts.unionByName(prior.select(*keys, "n", "used"))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("used").alias("used"))
