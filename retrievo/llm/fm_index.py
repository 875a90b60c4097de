"""FM-index over one shard's symbols: suffix order, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

MAX_SYMBOLS = (1 << 21) - 2  # three fields of 21 bits fit one sort key
SAMPLE = 16                  # every so many text positions one suffix position is kept


def suffix_order(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Start of every suffix in sorted order, by doubling the compared length. The last symbol is unique and smallest."""
    n, width = len(text), max(1, int(alphabet - 1).bit_length())
    taken = max(1, 42 // width)
    key = np.zeros(n, np.int64)
    for i in range(taken):
        key <<= width
        key[:max(0, n - i)] |= text[i:]
    packed = np.sort(key << 21 | np.arange(n))
    order, key = packed & (1 << 21) - 1, packed >> 21
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    alone = new & np.append(new[1:], True)
    open_, length = order[~alone], taken
    while len(open_):
        ahead = np.minimum(open_ + length, n - 1)
        packed = np.sort(rank[open_] << 42 | rank[ahead] << 21 | open_)
        open_, pair = packed & (1 << 21) - 1, packed >> 21
        first = pair >> 21
        new = np.ones(len(open_), bool)
        new[1:] = pair[1:] != pair[:-1]
        place = np.arange(len(open_))
        group = np.ones(len(open_), bool)
        group[1:] = first[1:] != first[:-1]
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank[open_] = first + np.maximum.accumulate(np.where(new, place, 0)) - start
        open_ = open_[~(new & np.append(new[1:], True))]
        length *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class _Bits:
    """A bit row with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8))
        self.words = packed.view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class _Wavelet:
    """Symbol ranks from one bit row for each bit of a symbol, the highest first."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        for bit in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, _Bits(ones), int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``i``."""
        first, i = np.zeros_like(i), i.copy()
        for bit, row, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = row.rank(first), row.rank(i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
        return i - first

    def symbol_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how often it stands before."""
        symbol, first, i = np.zeros_like(i), np.zeros_like(i), i.copy()
        for bit, row, zeros in self.levels:
            one = row.get(i)
            symbol |= one.astype(np.int64) << bit
            a, b = row.rank(first), row.rank(i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
        return symbol, i - first


class FMIndex:
    """Symbols are 1 to ``alphabet - 1``; 0 is appended as the end."""

    def __init__(self, text: np.ndarray, alphabet: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_order(text, alphabet)
        turned = text[order - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=alphabet)))
        self.wavelet = _Wavelet(turned, alphabet)
        kept = order % SAMPLE == 0
        self.marks, self.places = _Bits(kept), order[kept]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase, all of one length, by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            own = symbol[live]
            low[live] = self.first[own] + self.wavelet.rank(own, low[live])
            high[live] = self.first[own] + self.wavelet.rank(own, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a row whose position was kept."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            kept = self.marks.get(at[left])
            done = left[kept]
            out[done] = self.places[self.marks.rank(at[done])] + steps[done]
            left = left[~kept]
            symbol, before = self.wavelet.symbol_rank(at[left])
            at[left] = self.first[symbol] + before
            steps[left] += 1
        return out
