"""Recursive splitting, the model contract and the embedding cache."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retrievo.functions.recursive_split import last_sentences, recursive_chunks
from retrievo.operators.documents import chunk_recursive
from retrievo.operators.embedding import model_embedding
from retrievo.sources.embedding_cache import cached_embedding, compact_cache, read_cache

LEVELS = [(r"\s*\n\s*\n\s*", "\n\n"), (r"\s*\n\s*", "\n"), (r"(?<=[.!?])\s+|(?<=[。！？])\s*", " "), (r"\s+", " "), (None, "")]


def plain_chunks(text, size, overlap):
    """The same by string concatenation: (chunks, rest, whether the rest holds more than overlap)."""
    def tail(chunk):
        whole = [s for s in re.split(LEVELS[2][0], chunk)]
        for k in range(len(whole) + 1):
            at = chunk.rfind(whole[k]) if k < len(whole) else len(chunk)
            rest = chunk
            for s in whole[:k]:
                rest = rest[len(s):].lstrip()
            if len(rest) <= overlap and at >= 0:
                return rest
        return ""

    def pack(text, level, chunks, rest, fresh):
        pattern, joiner = LEVELS[level]
        parts = re.split(pattern, text) if pattern else [text[i:i + size] for i in range(0, len(text), size)]
        if pattern is None:
            if fresh:
                chunks.append(rest)
            rest, fresh = "", False
        for part in parts:
            if not part:
                continue
            if pattern is None:
                if fresh:
                    chunks.append(rest)
                rest, fresh = part, True
                continue
            both = rest + joiner + part if rest else part
            if len(both) > size and fresh:
                chunks.append(rest)
                rest, fresh = tail(rest), False
                both = rest + joiner + part if rest else part
            if len(both) <= size:
                rest, fresh = both, True
            elif len(part) <= size:
                rest, fresh = part, True
            else:
                rest, fresh = pack(part, level + 1, chunks, rest, fresh)
        return rest, fresh

    chunks = []
    rest, fresh = pack((text or "").strip(), 0, chunks, "", False)
    return chunks + ([rest] if fresh else [])


def _made(rng):
    words = lambda n: " ".join("x" * rng.randint(1, 12) for _ in range(n))
    sentence = lambda: words(rng.randint(1, 9)) + rng.choice([".", "!", "?", "。", ""])
    line = lambda: rng.choice([" ", "  ", ""]).join(sentence() for _ in range(rng.randint(1, 5)))
    return rng.choice(["\n\n", " \n \n\n", "\n"]).join("\n".join(line() for _ in range(rng.randint(1, 4)))
                                                      for _ in range(rng.randint(1, 5)))


def test_against_plain_version():
    rng = random.Random(1)
    for _ in range(400):
        text, size = _made(rng), rng.randint(5, 120)
        overlap = rng.randint(0, size - 1)
        got = recursive_chunks(text, size, overlap)
        assert got == plain_chunks(text, size, overlap)
        assert all(0 < len(c) <= size for c in got)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n。", max_size=200), st.integers(1, 30))
def test_nothing_is_lost(text, size):
    got = recursive_chunks(text, size, 0)
    assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)
    assert all(len(c) <= size for c in got)


def test_largest_parts_first():
    text = "First one. Second one.\n\nThird paragraph here.\nIts next line."
    assert recursive_chunks(text, 200, 0) == ["First one. Second one.\n\nThird paragraph here.\nIts next line."]
    assert recursive_chunks(text, 40, 0) == ["First one. Second one.", "Third paragraph here.\nIts next line."]
    assert recursive_chunks(text, 24, 11) == ["First one. Second one.", "Third paragraph here.", "Its next line."]
    assert recursive_chunks("One two. Three four. Five six.", 21, 12) == ["One two. Three four.", "Three four. Five six."[:21]]
    assert last_sentences("One two. Three four.", 12) == "Three four." and last_sentences("abc", 0) == ""
    for bad in ((5, 5), (5, -1)):
        with pytest.raises(ValueError):
            recursive_chunks("x", *bad)


def test_long_lines():
    start = time.time()
    for text in ("y" * 10_000_000, "word " * 2_000_000, "A b. " * 2_000_000):
        got = recursive_chunks(text, 2000, 200)
        assert max(map(len, got)) <= 2000 and sum(map(len, got)) >= len(text.strip()) - len(got)
    assert time.time() - start < 60


def test_rows_of_chunks(spark):
    rows = [(1, "One two. Three four.\n\nFive.", "k"), (2, None, "k"), (3, "  ", "k"), (None, "z" * 50, "k"), (1, "a", "k")]
    got = chunk_recursive(spark.createDataFrame(rows, "doc_id long, text string, kind string"), 6, 3, chars_per_token=2)
    assert got.columns == ["doc_id", "kind", "total_chunks", "chunk_index", "content", "char_count"]
    by = sorted((r.doc_id or -1, r.total_chunks, r.chunk_index, r.content, r.char_count) for r in got.collect())
    want = [(d or -1, len(c), i, x, len(x)) for d, t, _ in rows for c in [recursive_chunks(t, 12, 6)] for i, x in enumerate(c)]
    assert by == sorted(want) and {r[0] for r in by} == {-1, 1}


def test_one_text_costs_its_own_vector(spark):
    def stub():
        """A model that fails for a batch with a bad text, has no vector for another and a useless one for a third."""
        def model(texts):
            if any("bad" in t for t in texts):
                raise ConnectionError("refused " + "y" * 500)
            if any("short" in t for t in texts) and len(texts) > 1:
                return [[1.0]]
            return [None if "none" in t else [float("nan")] if "nan" in t else [float(len(t)), 1.0] for t in texts]
        return model

    texts = [f"text {i}" for i in range(200)]
    for i, word in ((3, "bad"), (77, "bad"), (78, "none"), (120, "nan"), (150, "short")):
        texts[i] += " " + word
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(200, None, 0), (201, "  ", 0), (None, "text 1", 0)]
    df = spark.createDataFrame(rows, "id long, text string, embedding int").coalesce(1)
    for size in (1, 7, 64):
        out = model_embedding(df, stub, batch_size=size).collect()
        assert len(out) == len(rows)
        by = {r.id: r for r in out}
        assert {i for i, r in by.items() if r.embedding is None} == {3, 77, 78, 120, 200, 201}
        assert by[3].embed_error.startswith("ConnectionError: refused") and len(by[3].embed_error) == 200
        assert (by[78].embed_error, by[120].embed_error) == ("no vector", "unusable vector")
        assert by[200].embed_error == by[201].embed_error == "text is blank"
        assert by[150].embedding == [float(len(texts[150])), 1.0] and by[150].embed_error is None
        assert by[None].embedding == by[1].embedding
    assert model_embedding(df.where("false"), stub).count() == 0


def test_a_text_is_tried_again(spark):
    def flaky():
        seen = set()

        def model(texts):
            if len(texts) > 1 or texts[0] not in seen:
                seen.update(texts if len(texts) == 1 else [])
                raise TimeoutError("busy")
            return [[1.0]]
        return model

    df = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "id long, text string").coalesce(1)
    assert model_embedding(df, flaky, attempts=2).filter("embedding IS NULL").count() == 0
    assert model_embedding(df, flaky, attempts=1).filter("embed_error = 'TimeoutError: busy'").count() == 9


def test_cache_over_runs(spark, tmp_path):
    path = f"{tmp_path}/cache"
    asked = []

    def embed(df, text, out):
        asked.append(sorted(r[0] for r in df.select(text).collect()))
        return df.withColumn(out, F.when(F.col(text) != "fails", F.array(F.length(text).cast("float"))))

    def run(texts, now, **more):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        found = cached_embedding(df, path, now, embed, **more)
        return {r.id: r.embedding for r in found.rows.collect()}, found

    got, found = run(["a", "bb", "a", None, "fails", ""], "2024-01-01 00:00:00")
    assert got == {0: [1.0], 1: [2.0], 2: [1.0], 3: None, 4: None, 5: [0.0]}
    assert asked[-1] == ["", "a", "bb", "fails"] and (found.distinct, found.embedded) == (4, 4)
    got, found = run(["a", "ccc", "fails"], "2024-01-01 23:00:00")  # what failed is asked again
    assert got == {0: [1.0], 1: [3.0], 2: None} and asked[-1] == ["ccc", "fails"] and found.embedded == 2
    got, _ = run(["a", "ccc"], "2024-01-02 00:00:00")  # the first run's entries end at this moment
    assert got == {0: [1.0], 1: [3.0]} and asked[-1] == ["a"]
    assert read_cache(spark, path).count() == 5
    assert compact_cache(spark, path, "2024-01-02 00:00:01") == 2
    assert read_cache(spark, path).count() == 2
    got, found = run(["a", "ccc", "bb"], "2024-01-02 00:00:02")
    assert got == {0: [1.0], 1: [3.0], 2: [2.0]} and asked[-1] == ["bb"]
    assert compact_cache(spark, path, "2025-01-01 00:00:00") == 0
    got, _ = run([], "2025-01-01 00:00:00")
    assert got == {} and asked[-1] == []
    # a run that did not finish its folder is not read
    spark.createDataFrame([], "key string").write.parquet(f"{path}/added-9-x")
    (tmp_path / "cache" / "added-9-x" / "_SUCCESS").unlink()
    assert read_cache(spark, path).count() == 0
