import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from retrievo.llm.periodic_runs import find_runs, maximal_pairs, runs_of, suffix_order, words_column
from retrievo.llm.queries import periodic_tails


def plain_runs(words, least=6, periods=4):
    """Start, length and smallest period of every run, distance by distance."""
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, periods * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    hidden = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in hidden)


def _agrees(docs, least=6, periods=4):
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    got = runs_of(np.array(sum(docs, []), np.int64), first, least, periods)
    want = sorted(((int(s + first[i]), n, q) for i, d in enumerate(docs) for s, n, q in plain_runs(d, least, periods)),
                  key=lambda r: (r[0], r[2]))
    assert [tuple(r) for r in got.tolist()] == want


def test_made_texts():
    rng = random.Random(5)
    for _ in range(600):
        docs = []
        for _ in range(rng.randint(0, 4)):
            k, words = rng.randint(1, 4), []
            for _ in range(rng.randint(0, 6)):
                words += [rng.randint(0, k) for _ in range(rng.randint(1, 5))] * rng.randint(1, 7)
                words += [rng.randint(0, k) for _ in range(rng.randint(0, 3))]
            docs.append(words)
        _agrees(docs, *rng.choice([(6, 4), (6, 4), (2, 2), (5, 3), (10, 2), (1, 2)]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=40), max_size=3))
def test_any_words(docs):
    _agrees(docs)
    _agrees(docs, 2, 2)


def test_suffix_order():
    rng = random.Random(2)
    words = [rng.randint(0, 2) for _ in range(300)]
    order, shared = suffix_order(np.array(words), np.array([0, 120, 300]), 3)
    ends = [120 if p < 120 else 300 for p in range(300)]
    suffixes = [words[p:ends[p]] for p in order]
    rows = [int(p >= 120) for p in order]
    for k in range(1, len(order)):
        common = 0
        while common < min(len(suffixes[k]), len(suffixes[k - 1])) and suffixes[k][common] == suffixes[k - 1][common]:
            common += 1
        if rows[k] == rows[k - 1] and common >= 3:
            assert suffixes[k - 1] < suffixes[k] and shared[k] == common
        else:
            assert shared[k] == 0


def test_only_close_pairs_are_made():
    """One word n times: as many pairs as it has periods within reach, not all of its places' pairs."""
    n = 50_000
    assert runs_of(np.zeros(n, np.int64), np.array([0, n])).tolist() == [[0, n, 1]]
    order, shared = suffix_order(np.zeros(n, np.int64), np.array([0, n]), 5)
    left = np.where(order > 0, 0, -1)
    assert len(maximal_pairs(order.tolist(), shared.tolist(), left.tolist(), 4)) < n // 3
    blocks = sum(([i + 1] + [0] * 200 for i in range(200)), [])  # many words before the same repetition
    assert len(runs_of(np.array(blocks), np.array([0, len(blocks)]))) == 200


TEXTS = ["", None, " \n\t", "a", "x x x x x x", "x x x x x", "A a A a A a A a", "a b " * 5 + "c", "the cat " * 3000 + "sat",
         "é é é é é é é é é é é é", "w" * 100_000, " ".join(str(i % 977) for i in range(30_000)), "x x x x x x"]


def test_rows(spark):
    rows = [(i if i % 3 else None, t, "k") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = find_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted((r.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    want = []
    for t in TEXTS:
        words = (t or "").split() if not (t or "").count(" ") else t.split(" ")
        found = plain_runs(words) if len(words) < 20_000 else [(0, 30_000, 977)]
        want.append((t or "", len(words), found, plain_collapse(words, found)))
    assert got == sorted(want)
    assert find_runs(docs.where("false")).count() == 0
    words, first = words_column(pa.array([None, "a\x0bb", "", "c"]))
    assert words.to_pylist() == ["a", "b", "c"] and first.tolist() == [0, 0, 2, 2, 3]


def test_tails(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 23))) for i in range(300)] + [(None, "a b")],
                                 "doc_id long, text string")
    for r in periodic_tails(docs).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        words = [f"w{j}" for j in range(r.doc_id % 23)] if r.doc_id is not None else ["a", "b"]
        n = len(words)
        if r.doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (r.text or "").split() == words
