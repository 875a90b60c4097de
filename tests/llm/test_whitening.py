import numpy as np
import pytest

from retrievo.llm.queries import op11
from retrievo.llm.whitening import whiten


def plain(vectors: list) -> dict:
    """The same from one matrix: n, deviations, |projections|, shares."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    centred = ((n * fit - s) / n).astype(float)
    covariance = centred.T @ centred / n
    values, turn = np.linalg.eigh(covariance)
    values, turn = values[::-1][:16], turn[:, ::-1][:, :16]
    keep = values > 1e-12 * values[0]
    projected = ((n * x - s) / n).astype(float) @ turn[:, keep] / np.sqrt(values[keep])
    return {"n": n, "deviation": deviation, "size": np.abs(projected), "share": values[keep] / np.trace(covariance)}


def test_query(spark, sf_dir):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = sorted(rows)
    want = plain([rows[i] for i in ids])
    got: dict = {}
    out = op11(spark, sf_dir)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    for r in out.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        own = [got[i][c] for c in range(1, 17)]
        assert {(r.n, r.deviation) for r in own} == {(want["n"], want["deviation"][k])}
        assert np.allclose([abs(r.whitened) for r in own], want["size"][k], atol=1e-8)
        assert np.allclose([r.explained for r in own], want["share"], rtol=1e-10)
        assert len({r.identity_error for r in own}) == 1 and own[0].identity_error < 1e-9
    whitened = np.array([[got[i][c].whitened for c in range(1, 17)] for i in ids])
    assert np.abs(whitened.T @ whitened / len(ids) - np.eye(16)).max() < 0.2


def test_blocks_and_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=5).tolist() for _ in range(60)]
    vectors += [vectors[0]] * 70 + [[c + 1e-9 for c in vectors[1]]]
    rows = [(i, v, "z") for i, v in enumerate(vectors)]
    rows += [(None, vectors[2], "z"), (1, None, "z"), (2, [1.0, None, 0.0, 0.0, 0.0], "z"), (3, [float("nan")] * 5, "z"),
             (4, [float("inf"), 0.0, 0.0, 0.0, 0.0], "z"), (5, [], "z"), (0, vectors[0], "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").repartition(7)
    want = plain(vectors)
    for size in (7, 4096):
        got = whiten(table, block_rows=size).collect()
        assert len(got) == len(vectors) + 2
        by_id = {}
        for r in got:
            by_id.setdefault(r.vec_id, []).append(r)
        assert len(by_id[0]) == 2 and len(by_id[None]) == 1
        for i in range(len(vectors)):
            r = by_id[i][0]
            assert (r.n, r.deviation) == (want["n"], want["deviation"][i]) and r.n <= 61
            assert np.allclose(np.abs(r.whitened), want["size"][i], atol=1e-9)
            assert np.allclose(r.explained, want["share"]) and r.identity_error < 1e-9


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * [3, 2, 1]).tolist()) for i in range(50)]
    got = {r.vec_id: r.whitened for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                                                block_rows=9).collect()}
    whitened = np.array([got[i] for i in range(50)])
    assert np.allclose(whitened.T @ whitened / 50, np.eye(3), atol=1e-9)  # all 50 are distinct


def test_tables_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted(round(abs(x), 9) for r in flat for x in r.whitened) == [1.0, 1.0]  # the second dimension has no variance
    one = whiten(spark.createDataFrame([(1, [1.0]), (2, [3.0])], schema)).collect()
    assert {len(r.whitened) for r in one} == {1}
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], schema))
