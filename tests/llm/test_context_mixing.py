import math
import random
import zlib
from collections import Counter

import brute
import numpy as np

from retrievo.llm.context_mixing import Code, Lexicon, Model, Spelled, score_texts


def test_code_is_a_code():
    code = Code(np.arange(258))
    words = {tuple(code.bits[s:s + n]) for s, n in zip(code.starts, code.lengths)}
    assert len(words) == 258 and math.isclose(sum(2.0 ** -len(w) for w in words), 1)


def test_words_are_told_apart():
    """Untrained, the probabilities of all words up to a length and of the end sum to no more than one."""
    code = Code(np.where(np.isin(np.arange(258), [97, 98, 256, 257]), 1_000_000, 0))
    words = [b""] + [bytes(w) for n in (1, 2, 3) for w in np.array(np.meshgrid(*[[97, 98]] * n)).T.reshape(-1, n).tolist()]
    lexicon = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    none = np.zeros(len(words), np.int64)
    bits = Model(code, np.zeros((6, 1 << 20, 2), np.uint32)).bits(Spelled(words, none, none, lexicon, code), len(words))
    assert 0.3 < sum(2.0 ** -bits) <= 1


def _docs():
    rng = random.Random(4)
    parts = ["tion", "er", "an", "the", "re", "ing", "on", "st"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(900)]
    text = lambda: " ".join(rng.choice(words[:40] if rng.random() < 0.6 else words) for _ in range(rng.randint(20, 120)))
    return [(i, text()) for i in range(600)] + [(700, None), (701, ""), (None, "The\tend"), (3, "x" * 5000), (3, "x" * 5000)]


def test_scores(spark):
    rows = _docs()
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_tokens string").repartition(3)
    got = score_texts(frame).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not out(i) for w in [*brute.spaced_words(t), None])
    n, v = sum(count.values()), len(count)
    base = {}
    for i, t in rows:
        tokens = [*brute.spaced_words(t), None]
        base.setdefault(i, []).append((out(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(
            sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) in base[r.doc_id]
        assert r.score < 0 < r.bits_per_byte
    held = [r for r in got if r.held_out and r.doc_id != 3]
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)  # both are negative
    assert score_texts(frame.where("false")).count() == 0
    assert score_texts(frame.where("doc_id = 0")).first().n_tokens > 1


def test_word_order_counts(spark):
    """A phrase of the training texts is likelier than its words shuffled, of listed words and of spelled ones."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("kal", "mor", "tis", "ven", "dru") for b in ("ba", "do", "gi", "lu", "ne", "po", "ra", "su")]
    phrase, often = words[:12], [f"often{i}" for i in range(40)]  # the most frequent words are none of the phrase
    texts = [" ".join([*rng.choices(often, k=90), *rng.sample(words, 12), *phrase]) for _ in range(400)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [*enumerate(texts), (held[0], " ".join(phrase)), (held[1], " ".join([*phrase[1::2], *phrase[::2]]))]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > 0.8 * got[held[1]]
    assert score_texts(spark.createDataFrame([(0, None), (1, " \t")], "doc_id long, text string")).count() == 2


def test_contexts_reach_across_the_space():
    """Spelled words take other slots after another word, at their first byte and within."""
    from retrievo.llm.context_mixing import Before

    code, lexicon = Code(np.ones(258)), Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    none = np.zeros(2, np.int64)
    tail = np.array([[ord(c) for c in t] for t in ("cba", "zba")])
    before = Before(np.array([5, 9], np.uint64), np.array([6, 9], np.uint64), tail)
    s = Spelled([b"word"] * 2, none, none, lexicon, code, before)
    a, b = (np.flatnonzero(s.word == w) for w in (0, 1))
    same = [(s.slots[i][a] == s.slots[i][b]) for i in range(6)]
    assert same[0].all() and same[4].all() and not same[5][1:].any()
    assert not same[1][:2].all() and not same[3][0]


def test_bits_are_the_mixed_ones():
    """Listed words have fewer predictors; what the model says is what its counts and weights make, one bit at a time."""
    rng = np.random.default_rng(3)
    token = np.sort(rng.integers(1, 1 << 62, 50).astype(np.uint64))
    lexicon, code = Lexicon(token, np.full(50, 9), 5), Code(rng.integers(0, 99, 258))
    asked = np.append(token[::3], rng.integers(1, 1 << 62, 200).astype(np.uint64))
    plain = [int(np.flatnonzero(token == t)[0]) if t in token else -1 for t in asked]
    assert lexicon.find(asked).tolist() == plain
    words = [b"", b"nul\0", b"nul", b"listed", b"also"]
    s = Spelled(words, np.array([0, 1, 2, 3, 0]), np.array([50, 50, 50, 7, 8]), lexicon, code)
    assert [len(p.at) for p in s.parts] == [4, 6] and s.count == len(s.word) == sum(len(p.bit) for p in s.parts)
    model = Model(code, rng.integers(0, 3000, (6, 1 << 20, 2)).astype(np.uint32))
    want = np.zeros(len(words))
    for part in s.parts:
        for j, word in enumerate(np.repeat(part.words, part.length)):
            total = 0
            for i, at in enumerate(part.at):
                assert at[j] & 1 == part.bit[j]
                zeros, ones = model.counts[i, at[j] >> 1].astype(float)
                step = min(int(math.log2(zeros + ones + 1)), 11)
                total += model.weights[i, part.gate[j], step] * math.log((ones + 0.4) / (zeros + 0.4))
            want[word] += math.log2(1 + math.exp(-total if part.bit[j] else total))
    assert np.allclose(model.bits(s, len(words)), want, rtol=0.01)
    both = Model(code, np.zeros((6, 1 << 20, 2), np.uint32)).bits(s, len(words))
    assert np.allclose(both, np.bincount(s.word, minlength=len(words)))
