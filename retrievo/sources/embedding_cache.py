"""A table of embeddings that outlives a run: each distinct text is embedded once in a lifetime.

The table is a base and the additions of runs since, each a folder of parquet files that is written once. Compaction
writes a new base with the newest living entry of each key; bases and additions before it are then not read any more.
An addition written while a compaction runs is not part of it: its texts are embedded again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from retrievo.functions.text import cache_key
from retrievo.operators.embedding import hashed_embedding
from retrievo.staging import stage

PREFIX = "ai:embedding:"  # fixed value
LIFETIME_S = 24 * 3600
SCHEMA = "key string, embedding array<float>, written_at timestamp"


@dataclass
class Found:
    """Rows with their vectors, and how many distinct texts there were and were embedded."""

    rows: DataFrame
    distinct: int
    embedded: int


def _folders(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in store.listStatus(hadoop)]
    done = lambda n: store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(n for n in names if n.startswith(("base-", "added-")) and done(n))


def _generation(names: list[str]) -> int:
    return max([int(n.split("-")[1]) for n in names if n.startswith("base-")], default=0)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the newest base and of what was added since; a key may have several."""
    names = _folders(spark, path)
    now = _generation(names)
    live = [f"{path}/{n}" for n in names if int(n.split("-")[1]) == now]
    return spark.read.schema(SCHEMA).parquet(*live) if live else spark.createDataFrame([], SCHEMA)


def _living(entries: DataFrame, now: Column, lifetime_s: int) -> DataFrame:
    """The newest entry of each key that lives at ``now``; entries of the future are left out."""
    ends = F.timestamp_add("SECOND", F.lit(lifetime_s), F.col("written_at"))
    return entries.filter((F.col("written_at") <= now) & (ends > now)).groupBy("key").agg(
        F.max_by("embedding", "written_at").alias("embedding"), F.max("written_at").alias("written_at"))


def cached_embedding(df: DataFrame, path: str, now, embed: Callable[[DataFrame, str, str], DataFrame] = hashed_embedding,
                     text: str = "text", out: str = "embedding", lifetime_s: int = LIFETIME_S) -> Found:
    """Vectors of all rows' texts; only texts without a living entry at ``now`` are embedded, and then added.

    Texts that get no vector are not stored, so the next run asks again. Null texts have none. A text in a third of all
    rows is one entry; its rows meet it in a join that adaptive execution splits.
    """
    spark = df.sparkSession
    now = F.lit(now).cast("timestamp")
    keyed = df.drop(out).withColumn("_key", cache_key(PREFIX, F.col(text)))
    asking = keyed.filter(F.col(text).isNotNull()).select("_key", F.col(text).alias("_text"))
    texts = stage(asking.select("_key").distinct(), "text_keys")
    known = _living(read_cache(spark, path), now, lifetime_s)
    open_keys = stage(texts.join(known, texts["_key"] == known["key"], "left_anti"), "open_keys")
    # only texts that are embedded are moved
    fresh = asking.join(open_keys, "_key", "left_semi").dropDuplicates(["_key"])
    made = embed(fresh, "_text", out).select(F.col("_key").alias("key"), F.col(out).alias("embedding"),
                                             now.alias("written_at"))
    folder = f"{path}/added-{_generation(_folders(spark, path))}-{uuid.uuid4().hex}"
    asked = stage(made, "embedded")
    asked.filter("embedding IS NOT NULL").write.parquet(folder)
    vectors = _living(read_cache(spark, path), now, lifetime_s).select(F.col("key").alias("_key"), F.col("embedding").alias(out))
    return Found(keyed.join(vectors, "_key", "left").drop("_key"), texts.count(), asked.count())


def compact_cache(spark: SparkSession, path: str, now, lifetime_s: int = LIFETIME_S) -> int:
    """Write a new base of the living entries, delete what it replaces, and return its number of entries."""
    names = _folders(spark, path)
    number = _generation(names) + 1
    base = f"{path}/base-{number}"
    _living(read_cache(spark, path), F.lit(now).cast("timestamp"), lifetime_s).write.parquet(base)
    for name in names:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.parquet(base).count()
