import numpy as np

from retrievo.operators import vector
from retrievo.operators.blocks import SCORE_DIGITS, LocalTopK


def test_block_scores_are_made_in_parts(monkeypatch):
    made = []

    class Watched(LocalTopK):
        def add(self, ids, scores):
            made.append(scores.size)
            super().add(ids, scores)

    monkeypatch.setattr(vector, "LocalTopK", Watched)
    monkeypatch.setattr(vector, "SCORE_CELLS", 500)
    rng = np.random.default_rng(3)
    rows, asks = rng.normal(size=(300, 4)).round(1), rng.normal(size=(50, 4)).round(1)
    got = vector._block_hits(np.arange(50), asks, np.arange(300), rows, 3, 0.0, ("bigint", "bigint")).to_pylist()
    assert max(made) <= 500 and sum(made) == 300 * 50
    scores = np.round(rows @ asks.T, SCORE_DIGITS)
    want = [(q, d, scores[d, q]) for q in range(50) for d in np.lexsort((np.arange(300), -scores[:, q]))[:3]
            if scores[d, q] >= 0]
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in got] == want


def test_scores_that_are_no_numbers_take_no_place():
    best = LocalTopK(1, 2, -1.0)
    best.add(np.arange(20), np.r_[np.nan, np.linspace(0, 1, 18), np.nan][:, None])
    assert best.ids.tolist() == [18, 17]
