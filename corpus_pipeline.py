"""A corpus pipeline of four stages: quality, near copies, benchmark passages, tokens.

Each stage takes what its predecessor kept, as a table read back from Parquet in the shared staging folder, so a lost
executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievo.llm.bpe import default_path, read_definition, tokenize
from retrievo.llm.decontaminate import remove_passages
from retrievo.llm.ngram_join import one_of_each
from retrievo.llm.quality import classify, fit
from retrievo.llm.registry import prepare
from retrievo.staging import stage


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier takes for neither low quality nor toxic."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs.select(COLUMNS), fit(docs, labels)).where("keep").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: Jaccard similarity of at least 0.8 on five-word shingles."""
    prepare(spark)
    return one_of_each(docs.select(COLUMNS), width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with benchmark passages cut out; ``n_chars`` follows the text."""
    prepare(spark)
    clean = remove_passages(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))
                            .otherwise(F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document with the number and digest of its tokens and the digest of what they decode to."""
    prepare(spark)
    return tokenize(docs.select(COLUMNS), read_definition(default_path()), digests=True, remember=0.35) \
        .select("doc_id", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # trained models and iterated contractions; tests compare every stage with a brute-force version
