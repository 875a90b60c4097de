import pyarrow as pa
from pyspark.sql import functions as F

from retrievo.plans import registry
from retrievo.session import BATCH_BYTES


def test_python_tasks_get_batches_of_bounded_bytes(spark, sf_dir):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    @registry.register("batch_sizes")
    def batch_sizes(spark, sf_dir):
        texts = spark.range(0, 9000, 1, 1).select(F.expr("repeat('abcdefghij', 300)").alias("t"))
        return texts.mapInArrow(sizes, "n long")

    try:
        found = registry.QUERIES["batch_sizes"](spark, sf_dir).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    finally:
        del registry.QUERIES["batch_sizes"]
    assert found["most"] < 1.1 * BATCH_BYTES and found["all"] > 9000 * 3000
