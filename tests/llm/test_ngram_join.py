import random

import brute
import numpy as np
import pytest

from retrievo import staging
from retrievo.llm.ngram_join import _members, one_of_each, signatures, similar_sets, single_from

SCHEMA = "doc_id long, text string"


def _varied():
    """Copies, near copies on both sides of the limit, a shared passage in many, short and empty texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(words)
    rows += [passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))] for _ in range(120)]
    rows += [[rng.choice(vocabulary) for _ in range(rng.randint(1, 80))] for _ in range(100)]
    rows += [["A", "b"], ["a", "B"], ["a"], ["a", "b", "c"], ["a", "b", "c", "a", "b", "c", "a"]]
    texts = [" ".join(w) for w in rows] + ["", None, " \t\n", "a b c", "X" * 5000, "x" * 5000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_same_as_all_pairs(spark, width, percent):
    rows = _varied()
    got = similar_sets(spark.createDataFrame(rows, SCHEMA), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.similar(rows, width, percent)
    assert len(got) == len(rows)


def test_edge_rows(spark):
    rows = [(5, "one two three four", 1), (5, "one two three four", 2), (5, "other words stand here", 3),
            (None, "one two three four", 4), (None, None, 5), (7, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_sets(docs, 3, 90).collect())
    assert got == [("5", 2, "5")] * 3 + [("7", 0, "7"), ("None", 0, "None"), ("None", 2, "5")]
    kept = sorted((str(r.doc_id), r.text) for r in one_of_each(docs.select("doc_id", "text"), 3, 90).collect()
                  if r.text)
    assert kept == [("5", "one two three four"), ("5", "other words stand here")]
    assert similar_sets(docs.where("false"), 3, 90).count() == 0


def test_similar_sets_share_a_signature():
    """Also across the size from which sets carry single tokens; whatever tokens are frequent."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        border = single_from(percent)
        for _ in range(300):
            n = int(rng.integers(max(1, border - 60), border + 60))
            base = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
            away = int(rng.integers(0, len(base) // 8 + 1))
            near = np.unique(np.concatenate([rng.permutation(base)[away:],
                                             rng.integers(1, 1 << 63, int(rng.integers(0, 40))).astype(np.uint64)]))
            seen = {t: int(rng.choice([1, 5, 100, 1000])) for t in np.union1d(base, near).tolist()}
            a, b = (signatures(s, np.array([seen[t] for t in s.tolist()]), 64, percent) for s in (base, near))
            shared = len(np.intersect1d(base, near))
            if 100 * shared >= percent * len(np.union1d(base, near)):
                assert len(np.intersect1d(a, b)), (percent, border, len(base), len(near))


def test_signatures_are_linear_in_the_set():
    for n in (300, 2_000, 20_000, 200_000):
        tokens = np.arange(1, n + 1).astype(np.uint64)
        for percent in (80, 90):
            assert len(signatures(tokens, np.full(n, 1000), 64, percent)) <= max(2 * n, 3000)


def test_long_texts(spark):
    """Near copies of a long text, below and above the border, many of them; one text of 200,000 words."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for size in (280, 330, 900):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for i in range(80):
            words = list(base)
            for _ in range(rng.randint(0, size // 60)):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append(" ".join(words + [rng.choice(vocabulary) for _ in range(rng.randint(0, size // 12))]))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(200_000))]
    rows += [rows[-1] + " more words"]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = similar_sets(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.similar(rows, 5, 80)


def _near_rows():
    base = [" ".join(f"w{i * 7 + k}" for k in range(60)) for i in range(40)]
    return [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " more") for i, t in enumerate(base)] + [(200, base[0])]


def test_what_was_staged_on_the_way_is_deleted(spark, tmp_path, monkeypatch):
    """The job leaves only the tables that its result reads."""
    monkeypatch.setattr(staging, "staging_root", lambda spark: str(tmp_path))
    docs = spark.createDataFrame(_near_rows(), "doc_id long, text string")
    one = one_of_each(docs, 5, 80)
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "retrievo").iterdir()) == ["gone", "repeated"]
    assert sorted(r.doc_id for r in one.collect()) == list(range(40))


def test_signatures_of_one_node_are_not_shuffled(spark):
    """Members are the same as by a join of all signatures, and few others pass the filter."""
    rng = random.Random(8)
    carried = {n: [rng.randrange(-1 << 62, 1 << 62) for _ in range(20)] + [n % 50] for n in range(500)}
    nodes = spark.createDataFrame(list(carried.items()), "node long, signatures array<long>")
    hubs = spark.createDataFrame([(s, s, s) for s in range(50)], "signature long, low long, hub long")
    got = sorted((r.signature, r.node, r.low, r.hub) for r in _members(nodes, hubs).collect())
    assert got == sorted((n % 50, n, n % 50, n % 50) for n in carried)
    none = _members(nodes, hubs.where("false"))
    assert none.count() == 0 and none.columns == ["signature", "node", "low", "hub"]


def _shuffled_bytes(spark):
    java = spark._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(
        java(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), java()).iterator()
    out = 0
    while stages.hasNext():
        out += stages.next().shuffleWriteBytes()
    return out


def test_texts_that_stay_are_not_shuffled(spark):
    """Also where the table of copies is too large to broadcast, a text without copies meets no join."""
    rng = random.Random(9)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1200)) for _ in range(60)]
    rows = [*enumerate(texts), (100, texts[0]), (101, texts[1] + " more"), (2, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4).localCheckpoint()
    size = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(size)
    try:
        spark.conf.set(size, "-1")
        one = one_of_each(docs, 5, 80)
        before = _shuffled_bytes(spark)
        got = one.collect()
        assert _shuffled_bytes(spark) - before < 0.3 * sum(map(len, texts))
    finally:
        spark.conf.set(size, own)
    assert sorted((r.doc_id, r.text) for r in got) == list(enumerate(texts))
