"""Readers: text documents, chat JSONL, evaluation datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from retrievo.functions.formats import structured_text
from retrievo.functions.text import is_blank, strip
from retrievo.sources.files import read_files

CHAT_SCHEMA = "messages array<struct<role:string,content:string>>, _corrupt string"
DEFAULT_CATEGORY = "uncategorized"
SUPPORTED_TYPES = ("txt", "md")


def file_type(name: Column) -> Column:
    """Lower-cased text after the last dot, else ``unknown``."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit("unknown"))


def document_text(kind: Column, raw: Column) -> Column:
    """Text files go through format detection; Markdown stays as it is."""
    return F.when(kind == "txt", structured_text(raw)).otherwise(raw)


def read_raw_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per UTF-8 file as it is, in folders below the path too: doc_id, file_name, file_type, raw. Empty files are
    not listed. The driver holds no file's name."""
    return read_files(spark, path, pattern).select(
        F.sha2(F.col("path").cast("binary"), 256).alias("doc_id"), "file_name",
        file_type(F.col("file_name")).alias("file_type"), F.col("content").cast("string").alias("raw"))


def read_text_documents(spark: SparkSession, path: str, pattern: str = "*.{txt,md,TXT,MD}") -> DataFrame:
    """One row per UTF-8 file: doc_id, file_name, file_type, text."""
    raw = read_raw_documents(spark, path, pattern)
    return raw.withColumn("text", document_text(F.col("file_type"), F.col("raw"))).drop("raw")


def parse_chat_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``messages`` and ``bad`` (malformed JSON) to a table of JSONL lines; blank lines are dropped."""
    kept = lines.filter(~is_blank(F.col(line)))
    parsed = kept.withColumn("_json", F.from_json(
        strip(F.col(line)), CHAT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.withColumn("bad", F.col("_json").isNull() | F.col("_json._corrupt").isNotNull()).withColumn(
        "messages", F.col("_json.messages")).drop("_json")


def read_chat_jsonl(spark: SparkSession, path: str | list[str], streaming: bool = False) -> DataFrame:
    """file_name, line, messages, bad. The streaming form follows the files that appear under ``path``."""
    raw = spark.readStream.text(path) if streaming else spark.read.text(path)
    return parse_chat_lines(raw.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line")))


def decode_ids(raw: Column) -> Column:
    """Ids of a JSON array, or of a text split at ``|`` and ``;``: trimmed, not blank, distinct, in order."""
    text = strip(raw)
    as_json = F.when(text.rlike(r"(?s)^\[.*\]$"), F.from_json(text, "array<string>"))
    ids = F.coalesce(as_json, F.split(text, "[|;]"))
    out = F.array_distinct(F.filter(F.transform(ids, strip), lambda x: ~is_blank(x)))
    return F.when(is_blank(raw), F.array().cast("array<string>")).otherwise(out)


def _alias(df: DataFrame, *names: str) -> Column | None:
    by_name = {c.strip().lower(): c for c in df.columns}
    for n in names:
        if n.lower() in by_name:
            return F.col(f"`{by_name[n.lower()]}`")
    return None


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array or a quoted CSV: question, relevant_ids, category."""
    if path.lower().endswith(".csv"):
        raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
        question, ids = _alias(raw, "question"), _alias(raw, "relevantDocIds", "relevant_doc_ids")
        category = _alias(raw, "category", "type")
        if question is None or ids is None:
            raise ValueError("an evaluation CSV needs the columns question and relevantDocIds")
        return raw.filter(question.isNotNull() & ids.isNotNull()).select(
            question.alias("question"), decode_ids(ids).alias("relevant_ids"),
            (F.lit(None).cast("string") if category is None else category).alias("category"))
    raw = spark.read.schema("question string, relevantDocIds array<string>, category string").json(
        path, multiLine=True)
    return raw.select("question", F.col("relevantDocIds").alias("relevant_ids"), "category")
