import random

import brute
import numpy as np
import pytest

from retrievo.llm import decontaminate, fm_index
from retrievo.llm.decontaminate import find_passages, remove_passages

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("alphabet", [3, 17, 3000])
def test_index_against_scan(alphabet):
    rng = np.random.default_rng(alphabet)
    text = rng.integers(1, alphabet, 400)
    text = np.concatenate([text, text[50:300], text[50:300], np.full(70, 1)])
    index = fm_index.FMIndex(text, alphabet)
    assert np.array_equal(fm_index.suffix_order(np.append(text, 0), alphabet),
                          sorted(range(len(text) + 1), key=lambda i: (*text[i:], 0)))
    for size in (1, 2, 5):
        phrases = np.concatenate([np.lib.stride_tricks.sliding_window_view(text, size)[::7],
                                  rng.integers(1, alphabet, (20, size))])
        for phrase, low, high in zip(phrases, *index.search(phrases)):
            at = sorted(index.locate(np.arange(low, high)).tolist())
            assert at == [i for i in range(len(text) - size + 1) if np.array_equal(text[i:i + size], phrase)]


def _case():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äé", "x9"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", ".\n"]) for _ in range(n))
    items = [(i, text(rng.randint(12, 40))) for i in range(12)] + [(50, "w1 W2"), (51, "rare"), (52, "..."), (53, None),
                                                                    (54, ""), (None, "w3"), (3, text(15))]
    docs = [(i, text(rng.randint(0, 200))) for i in range(60)]
    docs += [(100 + i, text(30) + items[i % 12][1].upper() + text(20) + items[(i + 1) % 12][1]) for i in range(40)]
    docs += [(200, None), (201, ""), (202, "!?"), (None, items[0][1]), (7, items[0][1]), (203, "Rare")]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(None, None), (64, None), (None, 300)])
def test_same_as_lookup(spark, monkeypatch, shard, block):
    docs, items = _case()
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    got = find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = brute.passages(docs, [i for i in items if i[0] is not None])
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.hit_words), r.item_ids) for r in got), key=key) \
        == sorted(want, key=key)
    if shard:  # pieces smaller than a text
        monkeypatch.setattr(decontaminate, "MAX_SYMBOLS", shard)
        phrases = decontaminate.Phrases(spark.createDataFrame([i for i in items if i[1]][:13], ITEMS).toArrow(), 10)
        texts = [np.tile(phrases.groups[0][0].ravel(), 3)]
        found, _ = decontaminate.occurrences(texts, phrases)
        monkeypatch.undo()
        assert np.array_equal(found, decontaminate.occurrences(texts, phrases)[0]) and len(found)


def test_removal(spark):
    item = " ".join(f"b{i}" for i in range(12))
    docs = [(1, f"Start, {item}. End", "a"), (2, "clean text", "b"), (3, None, None), (4, item, "c"),
            (5, " ".join(f"b{i}" for i in range(6)) + " " + item + " " + " ".join(f"b{i}" for i in range(6, 12)), "d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    out = remove_passages(frame, spark.createDataFrame([(1, item)], ITEMS))
    assert out.columns == frame.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Start, . End", 2: "clean text", 3: None, 4: "", 5: ""}
    assert find_passages(frame.where("false"), spark.createDataFrame([], ITEMS)).count() == 0
    assert [r.n_words for r in find_passages(frame, spark.createDataFrame([], ITEMS)).orderBy("doc_id").collect()][1] == 2
