"""Windowed metrics over an event stream. Rows later than the watermark no longer change a closed window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from retrievo.operators import telemetry
from retrievo.streaming.sinks import drain

WATERMARK = "10 minutes"


def rate_stream(events: DataFrame, labels: Sequence[str], window: str = "5 minutes", slide: str = "1 minute",
                seconds: int = 300, watermark: str = WATERMARK) -> DataFrame:
    return telemetry.rate(events.withWatermark("ts", watermark), labels, window, slide, seconds)


def ratio_stream(events: DataFrame, numerator: Column, window: str, slide: str, seconds: float,
                 labels: Sequence[str] = (), watermark: str = WATERMARK) -> DataFrame:
    return telemetry.windowed_ratio(events.withWatermark("ts", watermark), numerator, window, slide, seconds, labels)


def increase_stream(events: DataFrame, labels: Sequence[str], window: str = "1 day",
                    watermark: str = WATERMARK) -> DataFrame:
    return telemetry.increase(events.withWatermark("ts", watermark), labels, window)


def with_late_split(df: DataFrame, delay_seconds: int, newest) -> tuple[DataFrame, DataFrame]:
    """Rows on time and late rows against the newest event time seen before (None at the start)."""
    if newest is None:
        return df, df.limit(0)
    late = F.col("ts") < F.lit(newest) - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS")
    return df.filter(~late), df.filter(late)


def split_late(events: DataFrame, path: str, checkpoint: str, delay_seconds: int = 600):
    """Write a stream into ``path/on_time`` and ``path/late``, one folder per batch.

    The newest event time before a batch is read from the folders of earlier batches, so a repeated batch splits the
    same way.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        before = None
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/marks").filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        on_time, late = with_late_split(df, delay_seconds, before)
        on_time.write.mode("overwrite").parquet(f"{path}/on_time/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        df.agg(F.max("ts").alias("newest")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/marks/batch_id={batch_id}")

    return drain(events, sink, checkpoint)
