"""Queries against their SQL over documents with blank texts, texts without terms and null."""

import os

import duckdb
import pytest

import oracle
from retrievo import plans
from retrievo.plans import registry

plans.load()
ODD = ["", " ", "\n", "  \n \t ", "!!!", "... ---", "\x01", "\x1c\x1d", "\x0b", "　", " ", " ", "\r\n",
       "a\rb", "\U0001f600", "x  \n", "Hi\n\n  \nthere"]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory, sf_dir):
    folder = tmp_path_factory.mktemp("odd")
    for t in oracle.TABLES:
        if t != "documents":
            os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE d AS SELECT * FROM '{sf_dir}/documents.parquet'")
    texts = [(lang, t) for lang in ("en", "de") for t in ODD for _ in range(2)] + [("de", None), ("de", None)]
    con.executemany("INSERT INTO d VALUES (?, ?, ?, 'web', 0)", [(900_000 + i, t, lang) for i, (lang, t) in enumerate(texts)])
    con.execute(f"COPY d TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder)


def same(spark, odd_dir, name):
    outcome = oracle.compare(spark, oracle.connect(odd_dir), name, odd_dir, registry.QUERIES[name], registry.SQL[name])
    assert outcome.startswith("ok"), outcome


def test_embed_cache_runs(spark, odd_dir):
    same(spark, odd_dir, "embed_cache_runs")


def test_embed_dedupe(spark, odd_dir):
    same(spark, odd_dir, "embed_dedupe")


def test_subtasks(spark, odd_dir):
    same(spark, odd_dir, "subtasks")
