"""Quality classifier by co-training two views of a document.

The text view sees which words a document holds and how they begin; the page-metadata view sees its language, source,
length and the shape of its text: shares of capitals, symbols, digits, repeated and distinct words. Each is a logistic
model for each of two questions: is the document of low quality, is it toxic. Both learn from labelled documents and
then, over rounds, from documents of an unlabelled pool that the other view is sure of. On labelled documents that were
not learned from, the two views' scores are calibrated and combined. All documents are scored in one pass without a
shuffle.

Fitting uses a bounded sample of labelled documents and of the pool, both by hash of the id; scoring is for every row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from retrievo.llm.blobs import giving_back
from retrievo.llm.words import LETTERS, SPACED, column_bytes, hashes, mix, slices, spans
from retrievo.staging import stage

LABELLED, POOL = 6000, 3000  # documents that are learned from
ROUNDS, SURE, ADDED = 3, 0.98, 300  # a round adds so many documents of the pool for each answer, if a view is so sure
FEATURES, LEAST_DOCS = 800, 4      # text features of each question, and in how many labelled documents one must be
STEPS, DECAY = 80, 1e-3
REJECT = 0.5
QUESTIONS = ("low_quality", "toxic")
META = ("lang", "source")
_U = np.uint64
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _name(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _text_view(data, borders):
    """Row and hash of each word and of each word's first five bytes, distinct in a row."""
    starts, ends, rows = spans(data, borders, LETTERS)
    whole, begun = hashes(data, starts, ends), hashes(data, starts, np.minimum(ends, starts + 5)) ^ _U(0x5BD1E995)
    return np.append(rows, rows), np.append(whole, begun)


def _meta_view(part: pa.RecordBatch, data, borders, columns):
    """Row and hash of each metadata value and of each shape measure's step."""
    n = part.num_rows
    upto = lambda mask: np.append(0, np.cumsum(mask))[borders]
    size = np.diff(borders)
    share = lambda mask: np.diff(upto(mask)) / np.maximum(size, 1)
    starts, ends, rows = spans(data, borders, SPACED)
    hashed = hashes(data, starts, ends)
    words = np.bincount(rows, minlength=n)
    again = np.bincount(rows[1:], (rows[1:] == rows[:-1]) & (hashed[1:] == hashed[:-1]), n) if len(rows) > 1 else np.zeros(n)
    _, first = np.unique(hashed ^ mix(rows.astype(_U) + _U(1)), return_index=True)
    distinct = np.bincount(rows[first], minlength=n)
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122))
    measures = [np.log2(size + 1) * 2, np.log2(words + 1) * 2, share(upper) / np.maximum(share(letters), 1e-9) * 12,
                np.sqrt(share(_SYMBOLS[data])) * 25, np.sqrt(share((data >= 48) & (data <= 57))) * 12,
                np.sqrt(again / np.maximum(words, 1)) * 12, distinct / np.maximum(words, 1) * 12,
                np.log2(np.diff(upto(data == 10)) + 1) * 2, size / np.maximum(words, 1)]
    out_rows, out = [], []
    for i, m in enumerate(measures):
        step = np.minimum(m, 60).astype(np.int64)
        for wide in (1, 3):  # coarser steps carry over to neighbours
            out_rows.append(np.arange(n))
            out.append(mix((step // wide).astype(_U) + _U(1000 * (i + 1) + 100 * wide)))
    for c in columns:
        names = {v: _name(f"{c}={v}") for v in set(part.column(c).to_pylist())}
        out_rows.append(np.arange(n))
        out.append(np.array([names[v] for v in part.column(c).to_pylist()], _U))
    return np.concatenate(out_rows), np.concatenate(out)


def _views(part: pa.RecordBatch, columns):
    data, borders = column_bytes(part.column("text"))
    return _text_view(data, borders), _meta_view(part, data, borders, columns)


def _lists(rows, hashed, n):
    """Each row's distinct hashes."""
    pairs = np.unique(np.stack([rows.astype(_U), hashed], 1), axis=0)
    cut = np.searchsorted(pairs[:, 0], np.arange(n + 1).astype(_U))
    return [pairs[a:b, 1].view(np.int64) for a, b in zip(cut, cut[1:])]


@dataclass
class Linear:
    """A logistic model over features named by hash."""
    names: np.ndarray
    weights: np.ndarray
    bias: float

    def total(self, rows: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
        if not len(self.names):
            return np.full(n, self.bias)
        at = np.searchsorted(self.names, hashed)
        at[at == len(self.names)] = 0
        hit = np.flatnonzero(self.names[at] == hashed)
        pairs = np.unique(rows[hit].astype(np.int64) * len(self.names) + at[hit])  # a feature counts once in a row
        return self.bias + np.bincount(pairs // len(self.names), self.weights[pairs % len(self.names)], n)


def _ascend(rows, columns, width, n, y, strength):
    """Weights of a logistic model by gradient ascent with steps scaled by each weight's past slopes."""
    w, bias, past, past_bias = np.zeros(width), 0.0, np.full(width, 1e-6), 1e-6
    for _ in range(STEPS):
        error = (y - 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], n) + bias, -30, 30)))) * strength
        g = np.bincount(columns, error[rows], width) - DECAY * n * w / max(1, n) ** 0.5
        past += g * g
        past_bias += error.sum() ** 2
        w += 0.5 * g / np.sqrt(past)
        bias += 0.5 * error.sum() / np.sqrt(past_bias)
    return w, bias


class View:
    """One view's features of the sample, and models fitted to some of its documents."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.array([len(x) for x in lists], np.int64)
        self.n = len(lists)
        self.rows = np.repeat(np.arange(self.n), sizes)
        flat = np.concatenate(lists).view(_U) if len(lists) else np.zeros(0, _U)
        self.names, self.columns = np.unique(flat, return_inverse=True)

    def fit(self, use: np.ndarray, y: np.ndarray) -> Linear:
        own = use[self.rows]
        seen = np.bincount(self.columns[own], minlength=len(self.names))
        yes = np.bincount(self.columns[own], y[self.rows[own]], len(self.names))
        n, p = max(1, use.sum()), max(1.0, y[use].sum())
        apart = (yes - seen * p / n) ** 2 / (seen * p / n + 1)  # against what the share of yes lets expect
        apart[seen < LEAST_DOCS] = 0
        chosen = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
        chosen = chosen[apart[chosen] > 0]
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        kept = own & (place[self.columns] >= 0)
        strength = np.where(use, np.where(y > 0, n / (2 * p), n / (2 * max(1, n - p))), 0.0)  # both answers weigh the same
        w, bias = _ascend(self.rows[kept], place[self.columns[kept]], len(chosen), self.n, y, strength)
        return Linear(self.names[chosen], w, bias)

    def totals(self, model: Linear) -> np.ndarray:
        return model.total(self.rows, self.names[self.columns], self.n)


def _cotrain(views: tuple[View, View], y: np.ndarray, known: np.ndarray, pool: np.ndarray) -> tuple[Linear, Linear]:
    """Both views' models after all rounds; each learns the sure answers of the other on the pool."""
    use, answer = [known.copy(), known.copy()], [y.astype(float).copy(), y.astype(float).copy()]
    for round_ in range(ROUNDS + 1):
        models = [v.fit(u, a) for v, u, a in zip(views, use, answer)]
        if round_ == ROUNDS or not pool.any():
            return models[0], models[1]
        for i in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(views[i].totals(models[i]), -30, 30)))
            other = 1 - i
            free = pool & ~use[other]
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.flatnonzero(free & (sure >= SURE))
                best = best[np.argsort(-sure[best], kind="stable")][:ADDED]
                use[other][best], answer[other][best] = True, value


@dataclass
class Classifier:
    """For each question the two views' models and how their scores combine."""
    parts: dict[str, tuple[Linear, Linear, np.ndarray]]
    columns: tuple[str, ...]

    def probability(self, question: str, text, meta, n: int) -> np.ndarray:
        if question not in self.parts:
            return np.zeros(n)
        a, b, w = self.parts[question]
        z = w[0] * a.total(*text, n) + w[1] * b.total(*meta, n) + w[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _combine(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the two scores and a constant: a logistic fit on documents that were not learned from."""
    scaled = np.maximum(np.abs(scores).mean(0), 1e-9)
    x = np.column_stack([scores / scaled, np.ones(len(y))])
    w = np.zeros(3)
    for _ in range(30):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), slope)
        w = np.clip(w, -50, 50)
    return w / np.append(scaled, 1)


def fit(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = META) -> Classifier:
    """The classifier from at most ``LABELLED`` labelled documents and a pool of ``POOL`` others, the same at every run.

    Labels are ``doc_id``, ``quality`` (0 is low) and ``toxic``; a null label answers nothing, and of several rows for a
    document the worst counts. A question without both answers in the sample is not asked.
    """
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"),
                                                                   F.max("toxic").alias("toxic"))
    there = docs.where("doc_id is not null").select("doc_id").distinct().join(own, "doc_id", "left")
    by_hash = F.xxhash64("doc_id")
    some = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    known = there.where(some).orderBy(by_hash, "doc_id").limit(LABELLED)
    pool = there.where(~some).orderBy(by_hash, "doc_id").limit(POOL)
    chosen = stage(known.union(pool), "sample-ids")
    sample = docs.select("doc_id", "text", *columns).join(F.broadcast(chosen), "doc_id")  # docs may have such columns too

    @giving_back
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                text, meta = (_lists(*view, part.num_rows) for view in _views(part, columns))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality"), part.column("toxic"),
                     pa.array(text, pa.list_(pa.int64())), pa.array(meta, pa.list_(pa.int64()))],
                    names=["doc_id", "quality", "toxic", "text_view", "meta_view"])

    kinds = dict(sample.dtypes)
    held = stage(sample.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, toxic {kinds['toxic']}, "
                                        "text_view array<long>, meta_view array<long>"), "sample").toArrow()
    lists = lambda c: [x.values.to_numpy() for x in held.column(c)]
    views = View(lists("text_view")), View(lists("meta_view"))
    ids = held.column("doc_id").to_numpy().astype(np.int64)
    aside = mix(ids.astype(_U) + _U(77)) % _U(4) == 0  # a quarter of the labelled documents is for calibration
    parts = {}
    for question, column, bad in (("low_quality", "quality", lambda v: v == 0), ("toxic", "toxic", lambda v: v > 0)):
        given = held.column(column).to_pandas()
        known, y = given.notna().to_numpy(), bad(given.fillna(-1)).to_numpy().astype(float)
        learn, check = known & ~aside, known & aside
        if len(set(y[learn])) == 2 and len(set(y[check])) == 2:
            a, b = _cotrain(views, y, learn, ~known)
            scores = np.column_stack([views[0].totals(a), views[1].totals(b)])
            parts[question] = (a, b, _combine(scores[check], y[check]))
    return Classifier(parts, tuple(columns))


def classify(docs: DataFrame, model: Classifier, reject: float = REJECT) -> DataFrame:
    """Every row with the probabilities ``p_low_quality`` and ``p_toxic`` and ``keep``: both are at most ``reject``.

    A null or empty text and null metadata are classified by what there is. Rows may repeat and ids be null. A question
    that could not be learned has probability 0. Columns named like a result are replaced, all others kept.
    """
    results = [*(StructField(f"p_{q}", DoubleType()) for q in QUESTIONS), StructField("keep", BooleanType())]
    docs = docs.drop(*[r.name for r in results])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @giving_back
    def run(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                views = _views(part, own.columns)
                p = [own.probability(q, *views, part.num_rows) for q in QUESTIONS]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *map(pa.array, p), pa.array((p[0] <= reject) & (p[1] <= reject))],
                    names=[*part.schema.names, *[r.name for r in results]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *results]))
