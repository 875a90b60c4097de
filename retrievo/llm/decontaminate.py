"""Benchmark decontamination with one FM-index per training shard.

A task gathers documents into shards of a bounded number of symbols, indexes each and searches it backward for every
test phrase at once. Words that no phrase holds are one symbol, and a run of them is a single one: a phrase cannot
cross it. Occurrences are found from sampled suffix positions and merged to spans of words. Documents never leave their
task, so nothing is shuffled, and a document longer than a shard is indexed in overlapping pieces.

Phrases come in blocks of bounded size, each broadcast to one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from retrievo.llm.blobs import giving_back
from retrievo.llm.fm_index import MAX_SYMBOLS, FMIndex
from retrievo.llm.words import LETTERS, column_bytes, hashes, slices, spans, words_of
from retrievo.staging import stage

WINDOW = 10              # words of a test phrase
BLOCK_BYTES = 16 << 20   # benchmark text in one broadcast; a single longer item is a block of its own
BREAK = 1                # the symbol of words outside all phrases and of text borders
_RESULTS = [StructField("n_words", LongType()), StructField("hit_words", ArrayType(ArrayType(LongType()))),
            StructField("item_ids", ArrayType(LongType()))]


class Phrases:
    """The distinct windows of some items, as symbols, with the items that hold each."""

    def __init__(self, items: pa.Table, window: int):
        batch = items.combine_chunks().to_batches()[0] if items.num_rows else \
            pa.RecordBatch.from_pylist([], schema=items.schema)
        hashed, _, first = words_of(batch, "text", LETTERS)
        self.vocabulary, symbol = np.unique(hashed, return_inverse=True)
        symbol = symbol.astype(np.int64) + 2
        self.alphabet, self.longest = len(self.vocabulary) + 2, window
        self.passes = np.zeros(1 << 16, bool)
        self.passes[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        by_length: dict[int, tuple[list, list]] = {}
        for i, item in enumerate(batch.column("item_id").to_pylist()):
            own = symbol[first[i]:first[i + 1]]
            if len(own):
                runs = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own)))
                held = by_length.setdefault(runs.shape[1], ([], []))
                held[0].append(runs)
                held[1].append(np.full(len(runs), item))
        self.groups = []  # phrases of one length; borders into the items of each
        for runs, owners in by_length.values():
            distinct, which = np.unique(np.concatenate(runs), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], 1), axis=0)
            self.groups.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        out = np.full(len(hashed), BREAK, np.int64)
        maybe = np.flatnonzero(self.passes[(hashed >> np.uint64(48)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, hashed[maybe])
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == hashed[maybe]
        out[maybe[known]] = place[known] + 2
        return out


def _shards(texts: list[np.ndarray], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of a shard with the text and the word of each; runs of breaks are one."""
    held, size = [], 0
    for i, symbols in enumerate(texts):
        word = np.flatnonzero((symbols != BREAK) | (np.append(BREAK + 1, symbols[:-1]) != BREAK))
        step = MAX_SYMBOLS - 1 - overlap
        for at in range(0, max(1, len(word)), step):
            own = word[at:at + step + overlap]
            if size + len(own) + 1 > MAX_SYMBOLS and held:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
            held.append((np.append(symbols[own], BREAK), np.full(len(own) + 1, i), np.append(own, -1)))
            size += len(own) + 1
            if at + step + overlap >= len(word):
                break
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def occurrences(texts: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word, end) of every occurrence and (text, item) of what occurs, each distinct and sorted."""
    spans_, items = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)]
    for symbols, text, word in _shards(texts, phrases.longest - 1) if phrases.groups else ():
        index = FMIndex(symbols, phrases.alphabet)
        for runs, borders, owners in phrases.groups:
            low, high = index.search(runs)
            count = high - low
            phrase = np.repeat(np.arange(len(runs)), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            at = index.locate(rows)
            spans_.append(np.stack([text[at], word[at], word[at] + runs.shape[1]], 1))
            met = np.unique(np.stack([text[at], phrase], 1), axis=0)
            many = np.diff(borders)[met[:, 1]]
            own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(borders[met[:, 1]], many)
            items.append(np.stack([np.repeat(met[:, 0], many), owners[own]], 1))
    return np.unique(np.concatenate(spans_), axis=0), np.unique(np.concatenate(items), axis=0)


def merged(found: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of each text as one; input sorted by text and start."""
    if not len(found):
        return found
    reach = np.maximum.accumulate(found[:, 2] + found[:, 0] * (1 << 40))
    new = np.ones(len(found), bool)
    new[1:] = found[1:, 1] + found[1:, 0] * (1 << 40) > reach[:-1]
    head = np.flatnonzero(new)
    return np.stack([found[head, 0], found[head, 1], reach[np.append(head[1:], len(found)) - 1]
                     - found[head, 0] * (1 << 40)], 1)


def _blocks(benchmark: DataFrame, window: int) -> list[Phrases]:
    """The benchmark in blocks of bounded text; ids that are null name no item."""
    items = stage(benchmark.where("item_id is not null and text is not null").select("item_id", "text"), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    own = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [Phrases(own.where(F.col("block") == i).select("item_id", "text").toArrow(), window) for i in range(n)]


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``hit_words`` (merged [first, end) word spans) and ``item_ids``.

    Words are runs of letters, digits and non-ASCII bytes with A-Z lower-cased. An item's phrases are its runs of
    ``window`` words, or all its words if fewer. Null and wordless texts have no words and no hits; items without words
    or id match nothing; items or rows that repeat an id are searched like any other and each id is listed once.
    ``doc_id`` may be null or repeat. Columns of ``docs`` named like a result are replaced.
    """
    docs = docs.drop(*[f.name for f in _RESULTS])
    out = docs
    for i, block in enumerate(_blocks(benchmark, window)):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_search(sent, i > 0), StructType([*docs.schema.fields, *_RESULTS]))
    return out


def _search(sent, again: bool):
    @giving_back
    def run(batches):
        phrases, held, texts, size = sent.value, [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, _, first = words_of(part, "text", LETTERS)
                symbols = phrases.symbols(hashed)
                texts += [symbols[first[i]:first[i + 1]] for i in range(part.num_rows)]
                held.append(part)
                size += len(symbols)
                if size > MAX_SYMBOLS // 2:
                    yield from _with_hits(held, texts, phrases, again)
                    held, texts, size = [], [], 0
        yield from _with_hits(held, texts, phrases, again)
    return run


def _with_hits(held, texts, phrases, again):
    found, items = occurrences(texts, phrases)
    found = merged(found)
    at = 0
    for part in held:
        n = part.num_rows
        text = np.arange(at, at + n + 1)
        s, i = np.searchsorted(found[:, 0], text), np.searchsorted(items[:, 0], text)
        spans_ = [found[s[k]:s[k + 1], 1:].tolist() for k in range(n)]
        ids = [items[i[k]:i[k + 1], 1].tolist() for k in range(n)]
        if again:  # hits of earlier blocks
            for k, (old, known) in enumerate(zip(part.column("hit_words").to_pylist(),
                                                 part.column("item_ids").to_pylist())):
                both = np.array(sorted([0, *x] for x in [*old, *spans_[k]]), np.int64).reshape(-1, 3)
                spans_[k], ids[k] = merged(both)[:, 1:].tolist(), sorted({*known, *ids[k]})
        columns = {f.name: part.column(f.name) for f in part.schema if f.name not in {r.name for r in _RESULTS}}
        yield pa.RecordBatch.from_pydict(columns | {
            "n_words": pa.array([len(t) for t in texts[at:at + n]], pa.int64()),
            "hit_words": pa.array(spans_, pa.list_(pa.list_(pa.int64()))),
            "item_ids": pa.array(ids, pa.list_(pa.int64()))})
        at += n


@giving_back
def _cut(batches):
    """Texts without their spans; what is left is not joined into new words."""
    for batch in batches:
        texts, where = batch.column("text").to_pylist(), batch.column("hit_words").to_pylist()
        for i, own in enumerate(where):
            if own:
                data, borders = column_bytes(batch.column("text").slice(i, 1))
                starts, ends, _ = spans(data, borders, LETTERS)
                raw, at, kept = data.tobytes(), 0, []
                for a, b in own:
                    kept.append(raw[at:starts[a]])
                    at = ends[b - 1]
                texts[i] = b"".join([*kept, raw[at:]]).decode()
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every benchmark passage cut out of ``text``; other rows and columns stay as they are.

    What stood around a cut may make a phrase anew, so texts that were cut are searched again until none has one; each
    round takes words away. Cases are defined as in ``find_passages``.
    """
    names = docs.columns
    searched = stage(find_passages(docs, benchmark, window), "searched")
    clean = searched.where("size(hit_words) = 0").select(names)
    hit = searched.where("size(hit_words) > 0")
    while not hit.isEmpty():
        again = stage(find_passages(hit.mapInArrow(_cut, searched.schema).select(names), benchmark, window), "searched")
        clean = clean.unionByName(again.where("size(hit_words) = 0").select(names))
        hit = again.where("size(hit_words) > 0")
    return clean
