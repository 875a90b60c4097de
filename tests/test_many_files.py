import os

import pytest
from pyspark.sql import functions as F

from retrievo.operators import ingestion
from retrievo.sources import readers
from retrievo.sources.files import read_files, write_text_files

ODD = ["a b.TXT", "é%41.md", "q?.txt", "[x]+y=z.txt"]


@pytest.fixture()
def folder(spark, tmp_path):
    rows = spark.range(300).select(F.format_string("d%d.txt", "id").alias("file_name"), F.format_string("text %d", "id").alias("text"))
    more = spark.createDataFrame([(n, n) for n in ODD] + [("none.txt", None), ("empty.txt", "")], "file_name string, text string")
    assert write_text_files(rows.union(more), str(tmp_path / "in"), folders=8) == 305
    (tmp_path / "in" / "_left.txt").write_text("hidden")
    (tmp_path / "in" / "top.txt").write_text("top")
    return str(tmp_path / "in")


def test_files_of_folders_below(spark, folder):
    assert len([d for d in os.listdir(folder) if os.path.isdir(f"{folder}/{d}")]) == 8
    got = {r.file_name: r.raw for r in readers.read_raw_documents(spark, folder).collect()}
    assert got == {f"d{i}.txt": f"text {i}" for i in range(300)} | {n: n for n in ODD} | {"top.txt": "top"}
    assert readers.read_raw_documents(spark, folder).select("doc_id").distinct().count() == 305
    named = {r.file_name for r in readers.read_text_documents(spark, folder, "*.{TXT,md}").collect()}
    assert named == {"a b.TXT", "é%41.md"}
    assert read_files(spark, f"{folder}/top.txt").count() == 1
    assert read_files(spark, f"{folder}/t*.txt").select("file_name").first()[0] == "top.txt"
    with pytest.raises(FileNotFoundError):
        read_files(spark, f"{folder}/missing")


def test_the_driver_lists_no_files(spark, folder):
    """No file index in the plan: it would hold a status for each file."""
    read = readers.read_raw_documents(spark, folder)
    assert read.inputFiles() == [] and "binaryFile" not in read._jdf.queryExecution().toString()


def test_ingest_of_folders_below(spark, folder, tmp_path):
    chunks, status = ingestion.ingest_index(readers.read_raw_documents(spark, folder), str(tmp_path / "out"))
    assert status.filter("processing_status = 'COMPLETED' AND chunk_count = 1").count() == 305
    assert {r.file_name for r in status.collect()} == {f"d{i}.txt" for i in range(300)} | {"top.txt"} | set(ODD)
    assert {r.chunk_id: r.content for r in chunks.collect()}["d7.txt#0"] == "text 7" and chunks.count() == 305
