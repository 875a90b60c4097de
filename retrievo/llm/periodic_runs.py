"""Runs: stretches of words that repeat with a period, found as maximal pairs of each text's own suffixes.

A pair of places is maximal if the words before them differ and so do the words after what they share. Where the places
are ``q`` apart and share ``l`` words, the stretch of ``q + l`` words has period ``q`` and no neighbour extends it; so the
pairs that are close enough for what they share are the runs, and nothing needs to be extended. A run of period ``q`` is
also found at multiples of it; the smallest is kept.

Suffixes of all texts of a batch are sorted by doubling, each text apart; a suffix that is unique drops out. The tree of
their common prefixes is walked bottom-up. A node holds its places in order, and also by the word before them. Of two
children the smaller one's places look up the larger one's within reach, passing over stretches of places that have the
same word before them. Each place is looked up a logarithmic number of times and each run gives as many pairs as it has
periods, of which a text has in all some multiple of its words.

Texts are rows of their own, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from retrievo.llm.words import SPACED, column_bytes, slices, spans

LEAST_LENGTH = 6   # words of a run
LEAST_PERIODS = 4  # a run is at least so many times as long as its period


def words_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of a string column in order, and the number of words before each row."""
    data, borders = column_bytes(column)
    starts, ends, rows = spans(data, borders, SPACED)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = np.ascontiguousarray(data[SPACED[data]]) if len(data) else data
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.searchsorted(rows, np.arange(len(column) + 1))


def suffix_order(codes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that share at least ``least`` words with another of their row, in the order of their suffixes, and how
    many words each shares with the one before it (0 where that is fewer than ``least``).

    ``codes`` numbers equal words alike; ``first`` holds the number of words before each row.
    """
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[row + 1]
    key = row * (int(codes.max()) + 1) + codes
    active, rank, levels, width = np.arange(n), np.zeros(n, np.int64), [], 1
    while True:
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.flatnonzero(fresh)
        size = np.diff(np.append(group, len(active)))
        before = rank[active]                       # ranks so far: the first place of the group in the whole order
        older = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        inside = np.repeat(group, size) - np.repeat(older, np.diff(np.append(older, len(active))))
        rank[active] = before + inside
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        active = active[np.repeat(size > 1, size)]
        if width <= least < 2 * width:
            kept = active
        if len(active) == 0:
            break
        beyond = active + width
        key = rank[active] * (n + 1) + np.where(beyond < end[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        width *= 2
    if width <= least:
        return none, none
    kept = kept[np.argsort(rank[kept], kind="stable")]
    a, b, shared = kept[:-1].copy(), kept[1:].copy(), np.zeros(max(len(kept) - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        same = (a < end[kept[:-1]]) & (b < end[kept[1:]]) & (row[kept[:-1]] == row[kept[1:]])
        same &= ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]
        step = same * (1 << level)
        a, b, shared = a + step, b + step, shared + step
    shared[shared < least] = 0
    return kept, np.concatenate([[0], shared])


def _others(places: list[int], own: list[int], low: int, high: int) -> list[int]:
    """``places[low:high]`` that are not in ``own``, which holds some of ``places`` in order: equal parts are skipped."""
    out, parts = [], [(low, high)]
    while parts:
        low, high = parts.pop()
        if low >= high or bisect_right(own, places[high - 1]) - bisect_left(own, places[low]) == high - low:
            continue
        if high - low == 1:
            out.append(places[low])
        else:
            mid = (low + high) // 2
            parts += [(low, mid), (mid, high)]
    return out


class _Node:
    """Places below a node of the tree, in order, and the same by the word before them."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}

    def join(self, other: _Node, shared: int, periods: int, found: list) -> _Node:
        """Both nodes as one; pairs across them that are a run are added to ``found``."""
        large, small = (self, other) if len(self.places) >= len(other.places) else (other, self)
        reach = shared // (periods - 1)
        places, classes = large.places, large.classes
        for left, members in small.classes.items():
            own = classes.get(left)
            for x in members:
                low, high = bisect_left(places, x - reach), bisect_right(places, x + reach)
                if low < high:
                    for y in places[low:high] if own is None else _others(places, own, low, high):
                        found.append((min(x, y), abs(x - y) + shared, abs(x - y)))
        if len(small.places) == 1:
            insort(places, small.places[0])
        else:
            places += small.places
            places.sort()  # two ordered stretches, which the sort merges
        for left, members in small.classes.items():
            own = classes.get(left)
            if own is None:
                classes[left] = members
            elif len(members) == 1:
                insort(own, members[0])
            else:
                own += members
                own.sort()
        return large


def maximal_pairs(order: list[int], shared: list[int], left: list[int], periods: int) -> list[tuple[int, int, int]]:
    """(start, length, distance) of all maximal pairs whose length is at least ``periods`` distances.

    ``left`` numbers the word before each of ``order``'s places; a row's first place has a number of its own.
    """
    found: list[tuple[int, int, int]] = []
    depths, nodes, node = [], [], None
    for place, common, before in zip(order, shared, left):
        while depths and depths[-1] > common:
            node = nodes.pop().join(node, depths.pop(), periods, found)
        if common:
            if depths and depths[-1] == common:
                nodes[-1] = nodes[-1].join(node, common, periods, found)
            else:
                depths.append(common)
                nodes.append(node)
        node = _Node(place, before)
    while depths:
        node = nodes.pop().join(node, depths.pop(), periods, found)
    return found


def runs_of(codes: np.ndarray, first: np.ndarray, least: int = LEAST_LENGTH,
            periods: int = LEAST_PERIODS) -> np.ndarray:
    """Start, length and smallest period of every run, by start, then period; starts count all rows' words on.

    A run is at least ``least`` words and at least ``periods`` (2 or more) periods long.
    """
    # a pair at distance q shares max(least - q, (periods - 1) * q) words or more; the least of it over all q
    share = min(max(least - q, (periods - 1) * q) for q in range(1, max(2, least) + 1))
    order, shared = suffix_order(codes, first, max(share, 1))
    if len(order) == 0:
        return np.zeros((0, 3), np.int64)
    left = np.where(order > 0, codes[order - 1], -1).astype(np.int64)
    left[np.isin(order, first)] = -1
    pairs = maximal_pairs(order.tolist(), shared.tolist(), left.tolist(), periods)
    out = np.array(pairs, np.int64).reshape(-1, 3)
    out = out[out[:, 1] >= least]
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    if len(out):
        out = out[np.concatenate([[True], (out[1:, :2] != out[:-1, :2]).any(1)])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeated_words(count: int, found: np.ndarray) -> np.ndarray:
    """Whether each of ``count`` words lies in a run, after that run's first period."""
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:-1] > 0


_RUN = StructType().add("start", LongType(), False).add("length", LongType(), False).add("period", LongType(), False)
RESULTS = [StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN, False)),
           StructField("collapsed", StringType())]
_ARROW_RUN = pa.struct([pa.field("start", pa.int64(), False), pa.field("length", pa.int64(), False),
                        pa.field("period", pa.int64(), False)])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH,
              periods: int = LEAST_PERIODS) -> DataFrame:
    """Every row with ``n_words``, its ``runs`` (start, length, period) and ``collapsed``.

    Words are numbered from 0 and compared as they are. A run is a stretch with smallest period ``period`` that no
    neighbouring word extends, at least ``least`` words and ``periods`` periods long; ``runs`` are ordered by start, then
    period. ``collapsed`` joins by one space the words that no run holds after its first period. A null or empty text,
    or one of white space only, has no words, no runs and an empty ``collapsed``. Columns named like a result are
    replaced, all others kept; rows may repeat, ids be null and the table be empty. A very long text is handled alone:
    its memory is at most some hundreds of bytes a word, its time grows with the words times their logarithm.
    """
    docs = docs.drop(*[f.name for f in RESULTS])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                words, first = words_column(part.column(text))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found = runs_of(codes, first, least, periods)
                row = np.searchsorted(first, found[:, 0], side="right") - 1
                kept = ~repeated_words(len(codes), found)
                borders = np.concatenate([[0], np.cumsum(kept)])[first]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()),
                                                                words.filter(pa.array(kept))),
                                       pa.scalar(" ", pa.large_string()))
                local = [pa.array(x) for x in (found[:, 0] - first[row], found[:, 1], found[:, 2])]
                listed = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32()),
                    pa.StructArray.from_arrays(local, fields=list(_ARROW_RUN)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(first), pa.int64()), listed, texts.cast(pa.string())],
                    names=[*part.schema.names, *[f.name for f in RESULTS]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *RESULTS]))
