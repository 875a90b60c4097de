"""Words of whole Arrow string columns as arrays: borders and 64-bit hashes, without a Python step per word.

Used inside ``mapInArrow``. Memory follows ``SLICE_BYTES`` or the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _multipliers(first: int, count: int) -> np.ndarray:
    return mix(np.arange(first + 1, first + count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


_TABLE = _multipliers(0, 1 << 12)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the rows' borders in them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    if len(borders) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[borders[0]:borders[-1]], borders - borders[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` text bytes, or of one row."""
    _, borders = column_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, borders: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = is_word[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    cuts = borders[(borders > 0) & (borders < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(borders, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z: a sum of bytes times position multipliers, mixed with the length."""
    out = np.zeros(len(starts), _U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + limit, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        if to == at + 1 and last - first > limit:  # one very long word, in pieces
            for x in range(first, last, limit):
                y = min(x + limit, last)
                part = (LOWER[data[x:y]].astype(_U) + _U(1)) * _multipliers(x - first, y - x)
                out[at:to] += part.sum(dtype=_U)
        else:
            own = starts[at:to] - first
            widths = np.diff(own, append=last - first)
            place = np.arange(last - first) - np.repeat(own, widths)
            longest = int((ends[at:to] - starts[at:to]).max())
            table = _TABLE if longest <= len(_TABLE) else _multipliers(0, longest)
            np.minimum(place, len(table) - 1, out=place)  # separators after a word may lie beyond the table
            part = (LOWER[data[first:last]].astype(_U) + _U(1)) * table[place]
            part[place >= np.repeat(ends[at:to] - starts[at:to], widths)] = 0
            out[at:to] = np.add.reduceat(part, own)
        at = to
    return mix(out ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


def words_of(batch: pa.RecordBatch, text: str, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every word, and the number of words before each row."""
    data, borders = column_bytes(batch.column(text))
    starts, ends, rows = spans(data, borders, is_word)
    return hashes(data, starts, ends), rows, np.searchsorted(rows, np.arange(batch.num_rows + 1))


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of one text's runs of ``width`` words, ascending; of all words as one if there are fewer."""
    n = len(hashed)
    if n == 0:
        return hashed
    take = min(width, n)
    out = np.full(n - take + 1, take, _U)
    for i in range(take):
        out = out * _U(0x9E3779B97F4A7C15) + hashed[i:n - take + 1 + i]
    return np.unique(mix(out))
