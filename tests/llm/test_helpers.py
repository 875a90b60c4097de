import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retrievo.llm import blobs, words
from retrievo.llm.components import components


def _batch(texts):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.sampled_from([3, 1 << 20]))
def test_words(texts, limit):
    for table, plain in ((words.SPACED, brute.spaced_words), (words.LETTERS, brute.letter_words)):
        data, borders = words.column_bytes(_batch(texts).column(0))
        starts, ends, rows = words.spans(data, borders, table)
        lowered = bytes(words.LOWER[data])
        got = [(r, lowered[a:b]) for a, b, r in zip(starts, ends, rows)]
        assert got == [(i, w) for i, t in enumerate(texts) for w in plain(t)]
        hashed = words.hashes(data, starts, ends, limit)
        assert np.array_equal(hashed, words.hashes(data, starts, ends))
        seen = {}
        for (_, w), h in zip(got, hashed):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_slices():
    batch = _batch(["a" * 10, None, "b" * 30, "", "c" * 5])
    assert [p.column(0).to_pylist() for p in words.slices(batch, "text", 12)] == [["a" * 10, None], ["b" * 30], ["", "c" * 5]]
    assert sum(p.num_rows for p in words.slices(batch, "text", 12)) == 5


@pytest.mark.parametrize("dtype", ["uint32", "float64"])
def test_tables_add_up(spark, dtype):
    length = 3 * blobs.BLOCK - 100

    def part(batches):
        table = np.zeros(length, dtype)
        for b in batches:
            for i in b.column(0).to_pylist():
                np.add.at(table, np.arange(i, length, 1 + i % 997), 1 if i % 2 else 300)
        yield from blobs.blocks_of(table)

    got = blobs.gather(spark.range(0, 40, 1, 5).mapInArrow(part, blobs.SCHEMA), length, dtype)
    want = np.zeros(length, dtype)
    for i in range(40):
        want[np.arange(i, length, 1 + i % 997)] += 1 if i % 2 else 300
    assert np.array_equal(got, want)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)] \
        + [(5000, i) for i in range(4000, 4100)] + [(7, 7), (None, 3), (-5, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == brute.roots({n for link in real for n in link}, real)
