"""Each stage on its own input against a plain version, and the whole run."""

import brute
import pytest

import corpus_pipeline
from retrievo.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    sf_dir, docs = "/root/testdata/sf0.01", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        out.append(docs)
    return sf_dir, out


def test_quality(spark, steps):
    sf_dir, (docs, kept, *_) = steps
    assert kept.columns == COLUMNS
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, r in labels.items() if r.quality and not r.toxic]
    bad = [i for i, r in labels.items() if not r.quality]
    assert sum(i in ids for i in clean) > 0.97 * len(clean) and sum(i in ids for i in bad) < 0.1 * len(bad)


def test_near_copies(steps):
    _, (_, before, after, *_) = steps
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d for d, (n, c) in brute.similar(rows, 5, 80).items() if d == c}
    assert {r.doc_id for r in after.collect()} == want and after.columns == COLUMNS and len(want) < len(rows)


def test_decontamination(spark, steps):
    sf_dir, (_, _, before, after, _) = steps
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in before.collect()}
    hit = {d: n for d, _, n, _ in brute.passages(list(rows.items()), items)}
    left = after.collect()
    assert len(left) == len(rows) and any(hit.values())
    assert not any(n for _, _, n, _ in brute.passages([(r.doc_id, r.text) for r in left], items))
    assert all((r.text == rows[r.doc_id]) == (hit[r.doc_id] == 0) and r.n_chars == len(r.text) for r in left)


def test_tokens_and_run(spark, steps):
    sf_dir, (*_, before, after) = steps
    assert after.count() == before.count() and after.where("n_tokens > 0").count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "tokens"]
    assert corpus_pipeline.run(spark, sf_dir).exceptAll(after).isEmpty()
