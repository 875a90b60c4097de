"""Documents to rows: parsed entries and chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from retrievo.functions import formats
from retrievo.functions.recursive_split import recursive_chunks
from retrievo.functions.text import clean_text, let

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
CHARS_PER_TOKEN = 4  # sizes are given in tokens; the splitter counts characters


def _numbered(df: DataFrame, items: Column, doc_id: str, number: str) -> DataFrame:
    return df.select(doc_id, F.posexplode(items).alias("_i", "_x")).select(
        doc_id, (F.col("_i") + 1).alias(number), "_x.*")


def parse_faq(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return _numbered(df, formats.faq_entries(F.col(text)), doc_id, "entry")


def parse_dialogue(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    blocks = df.select(doc_id, F.posexplode(formats.dialogues(F.col(text))).alias("_d", "_turns"))
    return blocks.select(doc_id, (F.col("_d") + 1).alias("dialogue"), F.posexplode("_turns").alias("_i", "_x")).select(
        doc_id, "dialogue", (F.col("_i") + 1).alias("turn"), "_x.*")


def parse_articles(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return _numbered(df, formats.articles(F.col(text)), doc_id, "article")


def parse_csv_qa(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return _numbered(df, formats.csv_pairs(F.col(text)), doc_id, "record")


def parse_mixed(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return _numbered(df, formats.mixed_blocks(F.col(text)), doc_id, "block")


def chunks(col: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` words that share ``overlap`` words with the window before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in 0..size-1")
    step = size - overlap

    def cut(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - overlap) / F.lit(step)), F.lit(1)) - 1
        return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.array_join(
            F.slice(words, (i * step + 1).cast("int"), size), " "))

    return let(F.array_remove(F.split(clean_text(col), " "), ""),
               lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(cut(w)))


def chunk_text(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """doc_id, chunk_index, total_chunks, content, char_count and the other columns of ``df`` but the text."""
    rest = [c for c in df.columns if c not in (doc_id, text)]
    cut = df.select(doc_id, *rest, chunks(F.col(text), size, overlap).alias("_chunks"))
    return cut.select(doc_id, *rest, F.size("_chunks").alias("total_chunks"),
                      F.posexplode("_chunks").alias("chunk_index", "content")).withColumn(
        "char_count", F.length("content"))


def chunk_recursive(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text",
                    doc_id: str = "doc_id", chars_per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """``chunk_text`` by paragraphs, lines, sentences, words and characters instead of word windows.

    ``size`` and ``overlap`` count tokens of ``chars_per_token`` characters; no chunk has more characters than that. Null
    and blank texts have no chunks. A text is one row, so its chunks come from one task; nothing is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in 0..size-1")
    rest = [c for c in df.columns if c not in (doc_id, text)]
    narrow = df.select(doc_id, *rest, F.col(text).alias("_text"))
    chars, shared = size * chars_per_token, overlap * chars_per_token

    def cut(batches):
        for batch in batches:
            found = [recursive_chunks(t, chars, shared) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))],
                                             names=[*batch.schema.names[:-1], "_chunks"])

    schema = StructType([*narrow.schema.fields[:-1], StructField("_chunks", ArrayType(StringType()))])
    return narrow.mapInArrow(cut, schema).select(
        doc_id, *rest, F.size("_chunks").alias("total_chunks"),
        F.posexplode("_chunks").alias("chunk_index", "content")).withColumn("char_count", F.length("content"))
