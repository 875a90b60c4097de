"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import oracle
from retrievo import plans
from retrievo.plans import registry

plans.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    outcome = oracle.compare(spark, con, name, sf_dir, registry.QUERIES[name], registry.SQL.get(name))
    assert outcome.startswith(("ok", "ROWS")), outcome


def test_runs_from_any_directory(tmp_path):
    """A plain session in another folder: tasks must still find the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
import __spark_entry__ as m
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", m.entry(spark).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_names():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) >= 90
