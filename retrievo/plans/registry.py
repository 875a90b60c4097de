"""Name -> query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from retrievo.session import bound_batches, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            bound_batches(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold times without a zone
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# texts up to this size are dealt to all cores, as one small file may be a single row group that cannot be split
SMALL_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table as ``spark.sql.files.maxPartitionBytes`` splits it; only small texts are dealt anew."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _TEXT_TABLES and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


# tables whose rows cost much more to process than to move
_TEXT_TABLES = {"documents", "pages", "conversations"}
