import glob

from pyspark.sql import functions as F

from retrievo.functions.text import is_blank, strip
from retrievo.operators import ingestion


def test_a_bucket_is_one_file(spark, tmp_path):
    docs = spark.range(0, 400, 1, 16).select(
        F.md5(F.col("id").cast("string").cast("binary")).alias("doc_id"), F.format_string("f%d.md", "id").alias("file_name"),
        F.lit("md").alias("file_type"), F.lit("some words of a text").alias("raw"))
    chunks, status = ingestion.ingest_index(docs, str(tmp_path / "index"), size=3, overlap=1)
    assert chunks.count() == 800 and status.filter("chunk_count = 2").count() == 400
    buckets = chunks.select("bucket").distinct().count()
    assert len(glob.glob(f"{tmp_path}/index/chunks/bucket=*/*.parquet")) == buckets


def test_trim_and_blank(spark):
    texts = ["", " ", "\x00a\x1f b\n\n", "\t \r\n", "　x　", "\x1c\x1d", " ", "x  ", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b")).orderBy("i").collect()
    cut = "".join(map(chr, range(0x21)))
    assert [r.s for r in got] == [None if t is None else t.strip(cut) for t in texts]
    assert [r.b for r in got] == [True, True, False, True, False, False, False, False, True]
