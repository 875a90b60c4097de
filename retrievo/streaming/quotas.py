"""Request quotas over a stream.

Each micro-batch is decided with the batch operator plus the counters of the open buckets. The counters are a table per
batch in the sink's folder: a repeated batch reads those of the batch before it and replaces its own. Counters of buckets
that are no longer open are counted again from the written decisions when a late request needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from retrievo.operators import telemetry
from retrievo.streaming.sinks import drain


def _prior(spark, path: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/counters/batch_id={batch_id - 1}") if batch_id > 0 else None


def _open_from(counters: DataFrame, keep_s: int, window_s: int) -> int | None:
    """The oldest bucket whose counters are kept; None if there are no counters."""
    newest = counters.agg(F.max("bucket")).first()[0]
    return None if newest is None else newest - keep_s // window_s - 1


def _closed(df: DataFrame, path: str, batch_id: int, identity: str, window_s: int, open_from: int) -> DataFrame | None:
    """Counters of the closed buckets that late requests of ``df`` fall into, from the decisions of earlier batches."""
    keys = [identity, "bucket"]
    late = telemetry.bucketed(df, window_s).select(*keys).filter(F.col("bucket") < open_from)
    oldest = late.agg(F.min("bucket")).first()[0]
    if oldest is None:
        return None
    decided = df.sparkSession.read.parquet(f"{path}/decisions").filter(
        (F.col("batch_id") < batch_id) & F.col("bucket").between(oldest, open_from - 1))
    return telemetry.quota_counters(decided.join(late.distinct(), keys, "left_semi"), identity)


def run_quotas(requests: DataFrame, path: str, checkpoint: str, identity: str, request: str = "event_id",
               text_length: Column | None = None, limit: int = 30, window_s: int = 60, per_min: int = 12_000,
               per_request: int = 4_000, max_chars: int = 12_000, overhead: int = 256, keep_s: int = 600):
    """Decide the requests of a stream into ``path/decisions``: the request columns, bucket, retry_after, tokens and
    ``decision``.

    Without ``text_length`` only the request rate is checked. Requests of a micro-batch are taken in time order, later
    batches come after. Counters are kept until their bucket ended ``keep_s`` before the newest request; a later request
    of such a bucket meets what the decisions of earlier batches used up, so ``path/decisions`` must stay.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        prior = _prior(spark, path, batch_id)
        open_from = None if prior is None else _open_from(prior, keep_s, window_s)
        closed = None if open_from is None else _closed(df, path, batch_id, identity, window_s, open_from)
        if closed is not None:
            prior = prior.filter(F.col("bucket") >= open_from).unionByName(closed)
        if text_length is None:
            marked = telemetry.rate_limit(df, identity, limit, window_s, request, prior)
            decided = marked.withColumn("tokens", F.lit(0).cast("long")).withColumn("decision", F.when(
                F.col("allowed"), "allowed").otherwise("rate_limit_exceeded")).drop("allowed")
        else:
            decided = telemetry.token_budget(df, identity, text_length, per_min, per_request, max_chars, limit,
                                             window_s, 1.0, overhead, request, prior)
        decided.write.mode("overwrite").parquet(f"{path}/decisions/batch_id={batch_id}")
        written = spark.read.parquet(f"{path}/decisions/batch_id={batch_id}")
        counters = telemetry.quota_counters(written, identity, prior)
        open_from = _open_from(counters, keep_s, window_s)
        if open_from is not None:
            counters = counters.filter(F.col("bucket") >= open_from)
        counters.write.mode("overwrite").parquet(f"{path}/counters/batch_id={batch_id}")

    return drain(requests, sink, checkpoint)
