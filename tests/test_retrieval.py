"""Ranking fixtures, equal results of alternative routes, and skewed input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievo.functions.text import bm25_tokenize
from retrievo.operators import embedding, fusion, lexical, vector


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def ranked(df):
    return [(r.query_id, r.doc_id) for r in df.orderBy("query_id", "rank").collect()]


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(bm25_tokenize(F.col("t")).alias("x")).first().x


def test_tokenizer(spark):
    assert tokens(spark, "如何申请退款abc") == ["如何", "何申", "申请", "请退", "退款", "abc"]
    assert tokens(spark, "Hello, WORLD! 3.5") == ["hello", "world", "3", "5"]
    assert tokens(spark, "单 a b") == ["单", "ab"]
    assert tokens(spark, "  !!! ") == [] and tokens(spark, None) == [] and tokens(spark, "") == []


def test_bm25_ranking(spark):
    d = docs(spark, [(1, "apple apple banana"), (2, "apple"), (3, "orange pear")])
    out = lexical.bm25_top(d, asks(spark, "apple banana"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [1, 2] and out[0].score > out[1].score > 0


def test_bm25_empty(spark):
    assert lexical.bm25_top(docs(spark, []), asks(spark, "apple"), 5).count() == 0
    d = docs(spark, [(1, "apple")])
    assert lexical.bm25_top(d, asks(spark, "   ", "!!!", "pear"), 5).count() == 0


def test_bm25_ideographs(spark):
    out = lexical.bm25_top(docs(spark, [(1, "订单 查询 订单")]), asks(spark, "订单"), 5).collect()
    assert len(out) == 1 and out[0].score > 0


def brute_bm25(rows, queries, k):
    toks = {i: t.split() for i, t in rows}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = []
    for q, text in enumerate(queries):
        scores = []
        for i, t in toks.items():
            s = 0.0
            for w in text.split():
                tf = t.count(w)
                if tf:
                    df = sum(w in x for x in toks.values())
                    s += np.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(t) / avg))
            if s > 0:
                scores.append((-round(s, 9), i))
        out += [(q, i) for _, i in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join((["the"] if i % 3 else ["a"]) * 5 + [f"w{x}" for x in rng.zipf(1.6, 12) if x < 500]))
            for i in range(600)]
    queries = ["the w1 w7 w40", "the the a", "w2 w3 w90 w91", "w499 the w1"]
    return rows, queries


def test_bm25_routes_agree(spark, skewed):
    rows, queries = skewed
    d, q = docs(spark, rows).repartition(4), asks(spark, *queries)
    want = brute_bm25(rows, queries, 7)
    index = lexical.bm25_index(d)
    assert ranked(lexical.bm25_top(d, q, 7)) == want
    assert ranked(lexical.bm25_search(index, q, 7)) == want
    assert ranked(lexical.bm25_search(index, q, 7, prune_pairs=0, seed_rows=50)) == want
    assert ranked(lexical.bm25_search(index, q, 7, prune_pairs=0, seed_rows=50, salts=3)) == want


def test_scan_limit_falls_back_to_index(spark, skewed, monkeypatch):
    rows, queries = skewed
    monkeypatch.setattr(lexical, "SCAN_TERMS", 2)
    assert ranked(lexical.bm25_top(docs(spark, rows), asks(spark, *queries), 7)) == brute_bm25(rows, queries, 7)


def test_stored_index(spark, skewed, tmp_path):
    rows, queries = skewed
    path = str(tmp_path / "index")
    lexical.write_index(lexical.bm25_index(docs(spark, rows)), path, partitions=4)
    fresh = lexical.read_index(spark, path, max_age="5 minutes")
    assert ranked(lexical.bm25_search(fresh, asks(spark, *queries), 7)) == brute_bm25(rows, queries, 7)
    assert lexical.read_index(spark, path, max_age="0 seconds") is None


def vectors(spark, n, dim=8, seed=1, name="doc_id"):
    data = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)],
                               f"{name} long, embedding array<float>")
    return data.astype(np.float64), df


def test_vector_routes_agree(spark):
    base, index = vectors(spark, 300)
    probes, q = vectors(spark, 20, seed=2, name="query_id")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(probes) @ unit(base).T, 9)
    want = [(i, int(j)) for i in range(20) for j in sorted(range(300), key=lambda d: (-scores[i, d], d))[:6]
            if scores[i, j] >= 0.2]
    assert ranked(vector.vector_search(index, q, 6, 0.2)) == want
    assert ranked(vector.vector_search(index, q, 6, 0.2, broadcast_bytes=256, block_rows=40)) == want
    near = vector.vector_search(index, q, 6, 0.6, score="relevance")
    assert ranked(near) == want and near.agg(F.min("score")).first()[0] >= 0.6


def test_vectors_of_other_sizes_score_nothing(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0])],
                                  "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert ranked(vector.vector_search(index, q, 5, 0.5)) == [(0, 1)]


@pytest.mark.parametrize("method", ["sampled", "kmeans"])
def test_all_cells_are_exact(spark, method):
    _, index = vectors(spark, 200)
    _, q = vectors(spark, 10, seed=3, name="query_id")
    exact = ranked(vector.vector_search(index, q, 5, -1.0))
    ivf = vector.build_ivf(index, 6, method)
    assert ranked(vector.ivf_search(ivf, q, 5, nprobe=6, block_rows=30)) == exact
    part = vector.ivf_search(ivf, q, 5, nprobe=3)
    mean = vector.recall_against(part, vector.vector_search(index, q, 5, -1.0)).agg(F.avg("recall")).first()[0]
    assert mean > 0.4


def hits(spark, *ids):
    return spark.createDataFrame([(0, d, float(9 - i), i + 1) for i, d in enumerate(ids)],
                                 "query_id long, doc_id long, score double, rank int")


def test_fusion(spark):
    out = fusion.rrf_fuse(hits(spark, 1, 2, 3), hits(spark, 1, 2, 3), 2).orderBy("rank").collect()
    assert out[0].doc_id == 1 and out[0].retrieval_source == "both" and out[0].rrf_score == pytest.approx(2 / 61)
    none = hits(spark, 9).limit(0)
    out = fusion.rrf_fuse(none, hits(spark, 2, 3)).collect()
    assert {r.doc_id for r in out} == {2, 3} and {r.retrieval_source for r in out} == {"bm25_only"}
    a, b = hits(spark, 4, 5, 6), hits(spark, 6, 7)
    score = lambda df: {r.doc_id: r.rrf_score for r in df.collect()}
    assert score(fusion.rrf_fuse(a, b)) == score(fusion.rrf_fuse(b, a))
    only = fusion.annotate_vector_only(hits(spark, 8, 9, 10), 2).orderBy("rank").collect()
    assert [r.vector_rank for r in only] == [1, 2] and only[0].retrieval_source == "vector_only"


def test_search_options():
    assert fusion.SearchOptions(0, -1.0, False).resolved() == fusion.SearchOptions(5, 0.7, False)


def test_hybrid_needs_texts(spark):
    _, index = vectors(spark, 5)
    with pytest.raises(ValueError):
        fusion.hybrid_search(index, asks(spark, "x"))


def test_hashed_embedding(spark):
    d = docs(spark, [(1, "red apple"), (2, "red apple"), (3, "blue sky"), (4, " ")])
    out = {r.doc_id: r.embedding for r in embedding.dedupe_embed(d).collect()}
    assert out[1] == out[2] != out[3] and out[4] is None
    assert np.linalg.norm(out[1]) == pytest.approx(1, abs=1e-6)
    assert sum(x > 0 for x in out[1]) in (1, 2)


def test_a_corpus_is_cut_into_words_once(spark):
    """Later batches with the same terms or fewer read the first one's matches; other terms take a new pass."""
    d = docs(spark, [(i, f"apple {'pear ' * (i % 3)}plum{i}") for i in range(40)] + [(99, None), (98, "")])
    scan = lexical.CorpusScan(d)
    for batch, again in ((["apple pear", "plum7"], True), (["plum7", "pear"], False), (["plum9 pear"], True)):
        held, got = scan.held, scan.top(asks(spark, *batch), 5)
        assert (scan.held is not held) == again
    assert ranked(got) == ranked(lexical.bm25_top(d, asks(spark, "plum9 pear"), 5))
