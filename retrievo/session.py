"""Session construction for local runs; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH_BYTES = 4 << 20  # rows that a Python task is handed at once


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, wherever it was imported from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "retrievo.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Hand Python tasks batches of bounded bytes, so that what they hold follows neither the table nor its longest run
    of long texts. A lower limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < set_to <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def build_session(app: str = "retrievo", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution on and timestamps in UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    bound_batches(spark)
    return spark
