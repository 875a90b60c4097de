"""Resumable import of chat JSONL files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from retrievo.operators.ingestion import extract_qa
from retrievo.sources.index import require_writable
from retrievo.sources.readers import parse_chat_lines
from retrievo.streaming.sinks import drain


def chat_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files under ``path``: file_name and line."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("line"))


def run_import(spark: SparkSession, source: str, target: str, checkpoint: str, read_only: bool = False,
               files_per_batch: int | None = None):
    """Import the files that were not imported before: pairs to ``target/pairs``, rejects to ``target/rejects``.

    Progress is the stream's checkpoint. A batch that fails is repeated and replaces what it had written; lines that
    cannot be used become rejects and never stop the import.
    """
    require_writable(read_only)

    def sink(lines: DataFrame, batch_id: int) -> None:
        good, rejected = extract_qa(parse_chat_lines(lines))
        good.write.mode("overwrite").parquet(f"{target}/pairs/batch_id={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{target}/rejects/batch_id={batch_id}")

    return drain(chat_stream(spark, source, files_per_batch), sink, checkpoint)


def import_totals(spark: SparkSession, target: str) -> DataFrame:
    """success_count, fail_count and total per file of everything imported so far."""
    good = spark.read.parquet(f"{target}/pairs").select(F.col("source_file").alias("file_name"), F.lit(1).alias("ok"))
    bad = spark.read.parquet(f"{target}/rejects").select("file_name", F.lit(0).alias("ok"))
    return good.unionByName(bad).groupBy("file_name").agg(
        F.sum("ok").alias("success_count"), F.sum(1 - F.col("ok")).alias("fail_count"),
        F.count(F.lit(1)).alias("total"))
