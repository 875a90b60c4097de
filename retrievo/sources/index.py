"""Chunk table, question/answer index, reports and messages: writers and keyed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from retrievo.functions import text as t
from retrievo.operators.ordered import row_numbers

DEFAULT_INDEX_CATEGORY = "document"
HISTORY_DEFAULT, HISTORY_MAX = 20, 100
# Fixed value: name of a report file.
REPORT_NAME = r"^rag-evaluation-\d{13}(?:-[0-9a-fA-F-]{36})?\.json$"


class ReadOnlyError(RuntimeError):
    """Raised when a writer runs in a read-only setup."""


def require_writable(read_only: bool) -> None:
    if read_only:
        raise ReadOnlyError("the index is read-only")


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether an index table can be read at ``path``."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def write_chunks(chunks: DataFrame, path: str, buckets: int = 256, read_only: bool = False) -> None:
    """Append chunks in hash buckets of the document, so lookups and deletes by document touch one bucket.

    A bucket is one file of each write, however many tasks made its chunks.
    """
    require_writable(read_only)
    (chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).repartition("bucket")
     .write.mode("append").partitionBy("bucket").parquet(path))


def chunks_of(chunks: DataFrame, doc_id) -> DataFrame:
    return chunks.filter(F.col("doc_id") == F.lit(doc_id)).orderBy("chunk_index")


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def delete_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks that remain once the documents in ``ids`` (doc_id) are deleted."""
    return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def shape_index_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows and rejects from qa_pair_id, text, question, query, answer, category, embedding, ts (epoch s).

    The question is the first of question, query and text that is not blank; answer and question fall back to the
    text, the category to ``document``. Rows without a numeric qa_pair_id are rejected.
    """
    body = F.substring(F.coalesce("text", F.lit("")), 1, t.QA_TEXT_CHARS)
    pair_id = F.expr("try_cast(CASE WHEN qa_pair_id RLIKE '^[+-]?[0-9]+$' THEN qa_pair_id END AS BIGINT)")
    good = df.filter(pair_id.isNotNull())
    shaped = good.select(
        F.substring(F.coalesce(t.first_text(F.col("question"), F.col("query"), F.col("text")), body), 1,
                    t.QUESTION_CHARS).alias("question"),
        F.substring(F.coalesce(t.first_text(F.col("answer")), body), 1, t.ANSWER_CHARS).alias("answer"),
        body.alias("qa_text"), pair_id.alias("qa_pair_id"),
        F.substring(F.coalesce(t.first_text(F.col("category")), F.lit(DEFAULT_INDEX_CATEGORY)), 1,
                    t.CATEGORY_CHARS).alias("category"),
        "embedding", "ts")
    rejected = df.filter(pair_id.isNull()).withColumn("reason", F.when(
        t.is_blank(F.col("qa_pair_id")), "missing qa_pair_id").otherwise("qa_pair_id is not numeric"))
    return shaped, rejected


def write_index(rows: DataFrame, path: str, read_only: bool = False) -> None:
    require_writable(read_only)
    rows.write.mode("append").partitionBy("category").parquet(path)


def fetch_corpus(index: DataFrame, max_docs: int = 0) -> DataFrame:
    """id, content and string metadata (all columns but the vector) of the rows with content; 0 means no cap."""
    doc_id = t.first_text(F.col("qa_pair_id").cast("string"), F.col("id").cast("string"))
    content = t.first_text(F.col("qa_text"), F.col("answer"), F.col("question"))
    kept = [c for c in index.columns if c != "embedding"]
    meta = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in kept]),
                                          F.array(*[F.col(c).cast("string") for c in kept])), lambda _, v: v.isNotNull())
    rows = index.select(doc_id.alias("id"), content.alias("content"), meta.alias("metadata")).filter(
        F.col("content").isNotNull())
    return rows.orderBy("id").limit(max_docs) if max_docs > 0 else rows


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Index rows that remain once the pairs in ``ids`` (qa_pair_id) are removed."""
    return index.join(ids.select("qa_pair_id").distinct(), "qa_pair_id", "left_anti")


def append_report(report: DataFrame, path: str, run_id: str) -> None:
    """Store one run's long report under its own partition."""
    (report.withColumn("run_id", F.lit(run_id)).withColumn("generated_at", F.current_timestamp())
     .write.mode("append").partitionBy("run_id").parquet(path))


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """Every stored run's long report with ``run_id`` and ``generated_at``."""
    return spark.read.parquet(path)


def report_history(reports: DataFrame, limit: int = HISTORY_DEFAULT) -> DataFrame:
    """Newest reports (file_name, modified_at, payload): other files are ignored, unreadable ones skipped."""
    n = min(max(limit, 1), HISTORY_MAX)
    newest = reports.filter(F.col("file_name").rlike(REPORT_NAME)).orderBy(
        F.desc("modified_at"), F.asc("file_name")).limit(n)
    return newest.filter(F.expr("try_parse_json(payload) IS NOT NULL"))


def session_messages(messages: DataFrame, session_id=None, bucket_turns: int = 4096) -> DataFrame:
    """Messages of one session, or of all, numbered in time order. conv_id, turn, role, text, position."""
    if session_id is not None:
        messages = messages.filter(F.col("conv_id") == F.lit(session_id))
    return row_numbers(messages, ["conv_id"], ["turn"], F.floor(F.col("turn") / bucket_turns), "position")


def delete_sessions(messages: DataFrame, ids: DataFrame) -> DataFrame:
    return messages.join(ids.select("conv_id").distinct(), "conv_id", "left_anti")
