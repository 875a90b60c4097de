"""Import of chat JSONL files line by line: batches of a number of lines, resumed inside a file, with running progress.

The stream's checkpoint holds the next file and line. Each batch replaces its own folder of ``target/lines``, which has
one row for each line that is not blank: the pair, or the reason why there is none. A listener writes one progress row
for each batch while the import runs. Several batches may be imported at once, as one micro-batch of the stream with tasks
of their own: a micro-batch of few lines takes its fixed time and uses one core.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from retrievo.operators.ingestion import judged_lines
from retrievo.sources.index import require_writable
from retrievo.sources.line_stream import LINES_PER_BATCH, LINES_PER_TASK, build_index, indexed_files, line_stream, offset_lines
from retrievo.sources.readers import parse_chat_lines

BATCH_LINES = 18  # lines of an import batch, where every batch calls a model


class ImportProgress(StreamingQueryListener):
    """Writes ``target/progress``: for each batch its lines, pairs and rejects and the lines done of all.

    A batch that is repeated replaces its row. Rows are small files, one for each batch, written by the driver as Spark
    reports them.
    """

    def __init__(self, target: str, files: list[int], lines_per_batch: int, at_once: int = 1):
        self.files, self.lines_per_batch, self.at_once = files, lines_per_batch, at_once
        self.store, self.folder = fs.FileSystem.from_uri(target if "://" in target else f"file://{target}")
        self.store.create_dir(f"{self.folder}/progress", recursive=True)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = p.observedMetrics.get("import")
        if not counts or not p.numInputRows:
            return
        done, total = offset_lines(p.sources[0].endOffset, self.files), sum(self.files)
        done -= p.numInputRows
        for i in range(-(-p.numInputRows // self.lines_per_batch)):
            lines = min(self.lines_per_batch, p.numInputRows - i * self.lines_per_batch)
            done, batch = done + lines, p.batchId * self.at_once + i
            row = {"batch_id": batch, "lines": lines, "success": counts[f"success{i}"] or 0,
                   "fail": counts[f"fail{i}"] or 0, "lines_done": done, "lines_total": total,
                   "percent": round(100.0 * done / max(total, 1), 2), "at": p.timestamp}
            with self.store.open_output_stream(f"{self.folder}/progress/batch-{batch:012d}.json") as f:
                f.write(json.dumps(row).encode())


PROGRESS = ("batch_id long, lines long, success long, fail long, lines_done long, lines_total long, percent double, "
            "at string")


def import_progress(spark: SparkSession, target: str) -> DataFrame:
    """One row for each batch reported so far; readable while the import runs."""
    return spark.read.schema(PROGRESS).json(f"{target}/progress")


def run_line_import(spark: SparkSession, source: str, target: str, checkpoint: str, read_only: bool = False,
                    lines_per_batch: int = LINES_PER_BATCH, after_batch=None, at_once: int = 1):
    """Import what is under ``source`` now and stop; a restart with the same checkpoint goes on at the line it reached.

    Lines that cannot be used are kept with their reason and never stop the import. ``at_once`` batches are imported side
    by side and repeated together after a stop; a checkpoint goes on with the number it was begun with. Their numbers skip
    some where an import ended before so many were full. ``after_batch`` is called with the number of the first of these
    batches once they are written.
    """
    require_writable(read_only)
    index = build_index(spark, source, f"{target}/index")
    lines = parse_chat_lines(line_stream(spark, index, lines_per_batch * at_once, min(lines_per_batch, LINES_PER_TASK),
                                         lines_per_batch))
    of = [(i, F.col("step") == i) for i in range(at_once)]
    judged = judged_lines(lines, keep=("line_no", "step")).observe(
        "import", *[F.count(F.when(own & F.col("reason").isNull(), 1)).alias(f"success{i}") for i, own in of],
        *[F.count(F.when(own, F.col("reason"))).alias(f"fail{i}") for i, own in of])

    def sink(df: DataFrame, batch_id: int) -> None:
        first = batch_id * at_once
        if at_once == 1:
            df.drop("step").write.mode("overwrite").parquet(f"{target}/lines/batch_id={first}")
        else:
            df.withColumn("batch_id", F.lit(first).cast("long") + F.col("step")).drop("step").write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/lines")
        if after_batch is not None:
            after_batch(first)

    listener = ImportProgress(target, indexed_files(spark, index), lines_per_batch, at_once)
    spark.streams.addListener(listener)
    try:
        query = judged.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return query


def line_import_totals(spark: SparkSession, target: str) -> DataFrame:
    """success_count, fail_count and total for each file of everything imported so far."""
    bad = F.col("reason").isNotNull().cast("long")
    return spark.read.parquet(f"{target}/lines").groupBy("file_name").agg(
        F.sum(1 - bad).alias("success_count"), F.sum(bad).alias("fail_count"), F.count(F.lit(1)).alias("total"))
