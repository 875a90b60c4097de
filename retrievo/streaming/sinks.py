"""Running streams to the end of their input and restartable sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "append") -> StreamingQuery:
    """Process what is there now, batch by batch, and stop. A restart with the same checkpoint goes on after the last
    finished batch; a batch cut short is run again, so ``sink`` must replace what it wrote for a batch id."""
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).foreachBatch(sink).start())
    query.awaitTermination()
    return query


def batch_files(path: str) -> Callable[[DataFrame, int], None]:
    """Append sink: each batch replaces its own folder."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def progress(spark: SparkSession, *paths: str) -> dict:
    """Batches and rows so far, counted from the batch folders that the sinks of a stream have written."""
    seen = None
    for path in paths:
        rows = spark.read.parquet(path).select("batch_id")
        seen = rows if seen is None else seen.unionByName(rows)
    counts = seen.agg(F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("rows")).first()
    return counts.asDict()
