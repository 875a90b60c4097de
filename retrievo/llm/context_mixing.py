"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words and one end. A word of the list of frequent ones is coded as bits along a fixed tree over that list;
any other as the list's escape and then its bytes and a stop, along a tree over bytes. Several predictors each give the
next bit from a hashed context of the running text: the place in the tree together with the last frequent word before,
the word before or the two words before; among bytes with the last one, two, three or four bytes, which reach across the
space into the word before, with all of the word so far, or with that and the word before. Contexts end where the text
starts. What a predictor knows are counts of zeros and ones in a table of fixed size. Its stretched probability is weighted by how often it has seen the context, weights being gated by that
count and by the place in the code; the sum is squashed to a probability. Weights are learned online, in small batches,
and averaged over tasks. At last an adaptive map, kept by place and probability, corrects the result. A text's score is
the sum over its bits.

Learning takes two passes over the training texts, one that adds up the counts and one that fits weights and map to
counts from which one occurrence was taken off. Equal words after the same two words and the same frequent word have
equal probabilities, so each task works on its distinct ones.

The base score needs exact counts of all tokens. Those of the most frequent ones are broadcast, as many as a parameter
says; tokens of texts that are not among them meet their counts in a join.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievo.llm import blobs
from retrievo.llm.words import LOWER, SPACED, column_bytes, hashes, slices, spans
from retrievo.staging import stage

TABLE_BITS = 20          # slots of a predictor's table: two counts each, whatever the corpus
FREQUENT = 1 << 18       # tokens whose counts are broadcast: 16 bytes each
LISTED_FROM = 3          # of these, tokens seen as often at least are coded as a whole
KINDS = 32               # frequent words that are a context for what follows
SLICE = 8 << 20          # text bytes that are taken together
RATE, BATCH = 0.02, 1 << 14
STOP, END = 256, 257     # symbols beside the bytes
START, TAIL = 300, 3     # what stands before a text; bytes of the word before that are contexts
_END_HASH = np.uint64(0x9FB21C651E98DF25)  # the end's token, told apart from words by its own hash
_PREDICTORS = 6
_GATES, _CONFIDENCE = 32, 12
_MAP, _PLACES = 33, 258 + 32  # probability steps and places of the adaptive map
_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_LEAD = 20               # bits of a hash by which the list is entered
_LAST = (2 << TABLE_BITS) - 1
_STEP_BITS = np.uint16(15)  # the last bits of an input hold its step
_SCALE = 160             # steps of an input in a unit; 65535 against none is below 12.1


class Code:
    """A code tree over the symbols from their counts: frequent symbols take few bits. Every symbol has a leaf."""

    def __init__(self, counts: np.ndarray):
        import heapq

        n = len(counts)
        parent, side = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int8)
        heap = [(max(int(c), 1), s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        for name in range(n, 2 * n - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = name
            side[b[1]] = 1
            heapq.heappush(heap, (a[0] + b[0], name))
        depth = [0] * (2 * n - 1)
        for at, up in reversed(list(enumerate(parent.tolist()))):  # parents have larger names
            if up >= 0:
                depth[at] = depth[up] + 1
        self.lengths = np.array(depth[:n])
        self.starts = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        self.nodes, self.bits = np.zeros(total, np.int32), np.zeros(total, np.int8)
        leaf, at, level = np.arange(n), np.arange(n), np.array(depth)
        while len(leaf := leaf[parent[at] >= 0]):
            at = at[parent[at] >= 0]
            step = level[at] - 1
            place = self.starts[leaf] + step
            self.nodes[place], self.bits[place] = parent[at] - n, side[at]
            at = parent[at]
        self.ways = self.nodes * 2 + self.bits

    def along(self, symbols: np.ndarray):
        """The ways to symbols, one after another: their lengths, and each bit's step, node and bit."""
        length = self.lengths[symbols]
        step = np.arange(int(length.sum()))
        begin = np.cumsum(length) - length
        way = self.ways.take(step + np.repeat(self.starts[symbols] - begin, length)).astype(np.int64)
        step -= np.repeat(begin, length)
        return length, step, way


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MULTIPLIER
    x ^= x >> _U(29)
    return x


class Lexicon:
    """The frequent tokens by hash: their counts, the tree over those that are listed, and the kinds."""

    def __init__(self, token: np.ndarray, often: np.ndarray, rest: int):
        """``token`` by falling count; ``rest`` is the number of occurrences of all other tokens."""
        kinds = token[:KINDS][token[:KINDS] != _END_HASH][:KINDS - 1]
        listed = int((often >= LISTED_FROM).sum())
        self.tree = Code(np.append(often[:listed], rest + often[listed:].sum()))
        order = np.argsort(token)
        self.token, self.often = token[order], often[order]
        self.first = np.searchsorted(self.token >> _U(64 - _LEAD), np.arange(1 << _LEAD, dtype=_U))
        np.minimum(self.first, max(len(token) - 1, 0), out=self.first)
        self.leaf = np.where(order < listed, order, listed)  # the last leaf is the escape
        self.kind = np.zeros(len(token), np.int64)
        self.kind[np.searchsorted(self.token, kinds)] = np.arange(1, len(kinds) + 1)
        self.escape = listed

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Places of the tokens, -1 for those not frequent. The leading bits of a hash say where to start."""
        if not len(self.token):
            return np.full(len(hashed), -1)
        place = self.first[(hashed >> _U(64 - _LEAD)).view(np.int64)]
        late = np.flatnonzero(self.token[place] < hashed)
        while len(late):
            late = late[place[late] < len(self.token) - 1]
            place[late] += 1
            late = late[self.token[place[late]] < hashed[late]]
        place[self.token[place] != hashed] = -1
        return place


class Before:
    """What stands before each word in the running text: hashes of the last and the last two words, and the last
    ``TAIL`` symbols of the last one, nearest first; 0 and ``START`` where the text starts."""

    def __init__(self, one: np.ndarray, two: np.ndarray, tail: np.ndarray):
        self.one, self.two, self.tail = one, two, tail

    @staticmethod
    def nothing(n: int) -> Before:
        return Before(np.zeros(n, _U), np.zeros(n, _U), np.full((n, TAIL), START))

    def __getitem__(self, pick) -> Before:
        return Before(self.one[pick], self.two[pick], self.tail[pick])


class Bits:
    """Bits of words one after another: ``length`` bits of each of ``words``; ``at`` is twice a predictor's slot, plus the
    bit."""

    def __init__(self, words, length, bit, place, gate, at):
        self.words, self.length, self.bit, self.place, self.gate, self.at = words, length, bit, place, gate, at

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Each bit's value, of one for every word of the whole."""
        return np.repeat(values[self.words], self.length)


class Spelled:
    """Bits of distinct words by what stands before; the end is the word of no bytes. ``leaf`` is a word's in the list,
    ``kinds`` the last frequent word before; the bytes of listed words are not read. ``parts`` are the bits in the list,
    which have fewer predictors, and those of bytes."""

    def __init__(self, words: list[bytes], kinds: np.ndarray, leaf: np.ndarray, lexicon: Lexicon, code: Code,
                 before: Before | None = None):
        before = before or Before.nothing(len(words))
        own = np.flatnonzero(leaf == lexicon.escape)
        self.parts = [self._listed(leaf, kinds, before, lexicon.tree),
                      self._bytes([words[i] for i in own], own, before[own], code)]
        self.count = sum(len(p.bit) for p in self.parts)

    @property
    def word(self) -> np.ndarray:
        return np.concatenate([np.repeat(p.words, p.length) for p in self.parts])

    @property
    def slots(self) -> list[np.ndarray]:
        """Slots of all bits by predictor, 0 where it has none."""
        none = np.zeros(len(self.parts[0].bit), np.int64)
        return [np.concatenate([p.at[i] >> 1 if i < len(p.at) else none for p in self.parts]) for i in range(_PREDICTORS)]

    @staticmethod
    def _listed(leaf: np.ndarray, kinds: np.ndarray, before: Before, tree: Code) -> Bits:
        length, step, way = tree.along(leaf)
        contexts = [kinds.astype(_U) + _U(1), _mix(before.one) + _U(3), _mix(before.two) + _U(5)]
        depth = np.minimum(step, 31)
        return Bits(np.arange(len(leaf)), length, (way & 1).astype(np.int8), depth + 258, np.minimum(depth >> 1, 7) + 24,
                    [way & _LAST, *[_at(_mix(c) + _U(i), length, way) for i, c in enumerate(contexts, 1)]])

    @staticmethod
    def _bytes(words: list[bytes], own: np.ndarray, running: Before, code: Code) -> Bits:
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        symbols = np.full(lengths.sum(), STOP, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[starts + lengths - 1] = False
        symbols[inner] = LOWER[np.frombuffer(b"".join(words), np.uint8)]
        symbols[(starts + lengths - 1)[lengths == 1]] = END
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(symbols)) - starts[word]
        # the word before ends in a stop, and its last bytes come before that
        space = np.where(running.one > 0, STOP, START)
        ahead = np.column_stack([space, running.tail])
        before = []
        for k in range(1, TAIL + 2):
            last = symbols[np.maximum(np.arange(len(symbols)) - k, 0)]
            across = place < k
            last[across] = ahead[word[across], k - 1 - place[across]]
            before.append(last.astype(_U))
        context = [before[0]]
        for k in range(1, TAIL + 1):
            context.append(_mix(context[-1] + _U(7 * k)) + before[k])
        steps = _mix(symbols.astype(_U) + _U(1)) * (place.astype(_U) * _U(2) + _U(1))
        total = np.cumsum(steps, dtype=_U)
        prefix = total - steps - (total - steps)[starts][word] + place.astype(_U) if len(words) else total
        context += [prefix, _mix(prefix + _U(11)) + _mix(running.one)[word]]
        length, step, way = code.along(symbols)
        upto = np.append(0, np.cumsum(length))
        gate = np.repeat(np.minimum(place, 5) * 4, length)
        gate += np.minimum(step, 3)
        return Bits(own, upto[starts + lengths] - upto[starts], (way & 1).astype(np.int8), way >> 1, gate,
                    [_at(_mix(c + _U(97 * i)) + _U(i), length, way) for i, c in enumerate(context)])


def _at(context: np.ndarray, length: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Twice the slot of each bit, plus the bit. A context's hash says where its tree starts in the table; nodes follow
    in the order of the tree, so that the upper ones, which most ways pass, stand side by side."""
    start = context * _MULTIPLIER >> _U(64 - TABLE_BITS) << _U(1)
    out = np.repeat(start.view(np.int64), length)
    out += way
    out &= _LAST
    return out


def _inputs(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probability of a one, 0 where nothing has been seen, and the step of how much has."""
    n0, n1 = n0.astype(np.float32), n1.astype(np.float32)
    seen = n0 + n1
    x = np.where(seen > 0, np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), np.float32(0))
    return x, np.minimum(np.log2(seen + 1).astype(np.int64), _CONFIDENCE - 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _map_place(place: np.ndarray, x: np.ndarray) -> np.ndarray:
    return place * _MAP + np.clip(np.rint(x * 2) + _MAP // 2, 0, _MAP - 1).astype(np.int64)


def new_table() -> np.ndarray:
    """Counts by predictor, slot and bit, one after another."""
    return np.zeros(_PREDICTORS << TABLE_BITS + 1, np.uint32)


def count_into(table: np.ndarray, s: Spelled, often: np.ndarray) -> None:
    """Add the bits of words that stand ``often``."""
    by = table.reshape(_PREDICTORS, -1)
    often = often.astype(np.uint32)
    for part in s.parts:
        times = part.spread(often)
        for i, at in enumerate(part.at):
            np.add.at(by[i], at, times)


class Model:
    """Counts, weights and map: everything that a text's score needs. Its size is fixed."""

    def __init__(self, code: Code, counts: np.ndarray):
        """``counts``: predictor, slot, bit; large ones are halved in pairs until 16 bits hold them."""
        self.code = code
        self.counts = np.zeros(counts.shape, np.uint16)
        for own, part in zip(self.counts, counts):
            np.minimum(part, 65535, out=own, casting="unsafe")
            large = np.flatnonzero(part.max(1) > 65535)
            scale = part[large].max(1, keepdims=True) / 65535
            own[large] = np.where(part[large] > 0, np.maximum(part[large] / scale, 1), 0)
        self.weights = np.full((_PREDICTORS, _GATES, _CONFIDENCE), 0.3)
        self.weights[0, 24:], self.weights[1, 24:] = 0.5, np.linspace(0.1, 0.9, _CONFIDENCE)
        self.map = np.zeros((_PLACES * _MAP, 3))  # zeros, ones, and the sum of what was predicted
        self._ready = None

    def _tables(self, without: bool) -> list:
        """Input of every slot in 12 bits, its step in the last four; ``without``: of every slot and bit, less one occurrence of that
        bit."""
        if self._ready is None or self._ready[0] != without:
            made = []
            for n in self.counts:
                zeros, ones = n[:, 0].astype(np.int32), n[:, 1].astype(np.int32)
                if without:
                    zeros, ones = (np.column_stack([np.maximum(zeros - 1, 0), zeros]).ravel(),
                                   np.column_stack([ones, np.maximum(ones - 1, 0)]).ravel())
                x, step = _inputs(zeros, ones)
                made.append((np.rint(x * _SCALE) + 2048).astype(np.uint16) << 4 | step.astype(np.uint16))
            self._ready = (without, made)
        return self._ready[1]

    @staticmethod
    def _weighed(ready: list, at: list, gate: np.ndarray, weights: np.ndarray):
        """What the predictors say, where their weights are, and the weighted sum."""
        inputs, where, total = [], [], np.zeros(len(gate), np.float32)
        gate = gate * _CONFIDENCE
        for table, own, weight in zip(ready, at, weights):
            x = table.take(own)
            place = (x & _STEP_BITS) + gate
            x = (x >> np.uint16(4)).astype(np.float32)
            x -= np.float32(2048)
            x *= np.float32(1 / _SCALE)
            total += weight.take(place) * x
            inputs.append(x)
            where.append(place)
        return inputs, where, total

    def learn(self, s: Spelled, often: np.ndarray, weights: np.ndarray, tally: np.ndarray) -> None:
        """One online pass over the bits; a word that stands often counts by the root of how often, at most tenfold.

        Words come in the order of their hashes, which is as good as a random one.
        """
        times_of = np.minimum(np.sqrt(often), 10).astype(np.float32)
        size, ready = _GATES * _CONFIDENCE, self._tables(True)
        for part in s.parts:
            times_all, sums = part.spread(times_of), np.zeros(len(part.bit), np.float32)
            for at in range(0, len(part.bit), BATCH):
                pick = slice(at, at + BATCH)
                bit, times = part.bit[pick], times_all[pick]
                now = weights.astype(np.float32).reshape(_PREDICTORS, size)
                inputs, where, total = self._weighed(ready, [a[pick] for a in part.at], part.gate[pick], now)
                error = (bit - _squash(total)) * times
                for weight, x, place in zip(weights, inputs, where):
                    slope = np.bincount(place, error * x, size) / np.sqrt(np.bincount(place, minlength=size) + 100)
                    weight += RATE * slope.reshape(_GATES, _CONFIDENCE)
                sums[pick] = total
            where = _map_place(part.place, sums)
            tally[:, :2] += np.bincount(where * 2 + part.bit, times_all, 2 * len(tally)).reshape(-1, 2)
            tally[:, 2] += np.bincount(where, times_all * _squash(sums), len(tally))

    def bits(self, s: Spelled, words: int) -> np.ndarray:
        """Bits that each distinct word takes."""
        out = np.zeros(words)
        n = self.map
        seen = n[:, 0] + n[:, 1]
        shift = np.log((n[:, 1] + 5) / (n[:, 0] + 5)) - np.log((n[:, 2] + 5) / (seen - n[:, 2] + 5))
        shift = (shift * seen / (seen + 200)).astype(np.float32)
        ready, weights = self._tables(False), self.weights.astype(np.float32).reshape(_PREDICTORS, -1)
        for part in s.parts:
            if not len(part.bit):
                continue
            cost = np.empty(len(part.bit))
            for at in range(0, len(part.bit), BATCH):
                pick = slice(at, at + BATCH)
                total = self._weighed(ready, [a[pick] >> 1 for a in part.at], part.gate[pick], weights)[2]
                total += shift.take(_map_place(part.place[pick], total))
                total *= 1 - 2 * part.bit[pick]  # the stretched probability of the other bit
                cost[pick] = np.maximum(total, 0) + np.log(1 + np.exp(-np.abs(total)))
            out[part.words] += np.add.reduceat(cost, np.cumsum(part.length) - part.length)  # all have bits
        return out / np.log(2)


def is_training(doc_id: Column) -> Column:
    """Whether a document is one to learn from; a null id reads as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


class _Slice:
    """Tokens of some rows, ends after the words, and the distinct words after each kind."""

    def __init__(self, part: pa.RecordBatch):
        self.data, borders = column_bytes(part.column("text"))
        self.starts, self.ends, rows = spans(self.data, borders, SPACED)
        self.n, self.words = part.num_rows, len(rows)
        self.rows = np.append(rows, np.arange(self.n))

    @cached_property
    def hashed(self) -> np.ndarray:
        return np.append(hashes(self.data, self.starts, self.ends), np.full(self.n, _END_HASH))

    def distinct(self, lexicon: Lexicon):
        """Each token's place in the lexicon, and which of the words that differ by themselves or by what stands before
        it is; of these the bytes where they are spelled, the last frequent word before, the leaf and what is before."""
        place = lexicon.find(self.hashed)
        kind = np.where(place >= 0, lexicon.kind[place], 0)[:self.words] if len(lexicon.kind) else np.zeros(self.words, int)
        last = np.maximum.accumulate(np.where(kind > 0, np.arange(1, self.words + 1), 0))
        first = np.searchsorted(self.rows[:self.words], np.arange(self.n + 1))
        upto = np.append(0, last)
        frequent = np.append(upto[:-1], upto[first[1:]])  # the last word with a kind before each word and each end
        frequent = np.where(frequent > first[self.rows], np.append(0, kind)[frequent], 0)
        at = np.append(np.arange(self.words), first[1:]) - 1  # the word before each word and each end
        hashed = np.append(self.hashed[:self.words], _U(0))
        one = np.where(at >= first[self.rows], hashed[at], _U(0))
        two = np.where(at > first[self.rows], _mix(hashed[np.maximum(at - 1, 0)]), _U(0)) + one
        key = _mix(self.hashed + _mix(one)) + _mix(two + _U(1)) * _U(0xA0761D6478BD642F) + frequent.astype(_U)
        _, pick, which = np.unique(key, return_index=True, return_inverse=True)
        leaf = np.append(lexicon.leaf, lexicon.escape)[place[pick]]
        raw, own = self.data.tobytes(), np.flatnonzero(leaf == lexicon.escape)
        a, b = (np.append(x, np.zeros(self.n, np.int64))[pick[own]].tolist() for x in (self.starts, self.ends))
        words, tails = np.full(len(pick), b"", object), np.full((len(pick), TAIL), START)
        words[own] = np.fromiter((raw[x:y] for x, y in zip(a, b)), object, len(own))
        tails[own] = self._tails(at[pick[own]], one[pick[own]] > 0)
        return place, which, words, frequent[pick], leaf, Before(one[pick], two[pick], tails)

    def _tails(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = np.full((len(at), TAIL), START)
        if self.words:
            last = self.ends[at][:, None] - 1 - np.arange(TAIL)
            inside = there[:, None] & (last >= self.starts[at][:, None])
            out[inside] = LOWER[self.data[last[inside]]]
        return out

    def spelled(self, lexicon: Lexicon, code: Code):
        """``place`` and ``which`` of ``distinct``, and its words in runs: their bits and first and last number."""
        place, which, words, kinds, leaf, before = self.distinct(lexicon)
        size, own = np.full(len(words), 8), np.flatnonzero(leaf == lexicon.escape)
        size[own] += np.fromiter(map(len, words[own]), np.int64, len(own))

        def runs():
            for a, b in _chunks(size):
                yield Spelled(words[a:b], kinds[a:b], leaf[a:b], lexicon, code, before[a:b]), a, b

        return place, which, len(words), runs()


def _slices(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield part, _Slice(part)


def _chunks(sizes: np.ndarray, size: int = 1 << 18):
    """Runs of words of a bounded number of bytes, or single ones."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + size, side="right")))
        yield at, to
        at = to


def _token_counts(train: DataFrame) -> DataFrame:
    """``token``, ``count`` of every distinct training token, ends included; counted in tasks before the shuffle."""
    kind = pa.schema([("token", pa.int64()), ("count", pa.int64())])

    def run(batches):
        for part, own in _slices(batches):
            token, count = np.unique(own.hashed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], schema=kind)

    return stage(train.mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count")),
                 "tokens")


def _symbol_counts(train: DataFrame) -> np.ndarray:
    def run(batches):
        counts = np.zeros(258, np.uint64)
        for part, own in _slices(batches):
            counts[:256] += np.bincount(LOWER[own.data], minlength=256).astype(_U)
            counts[STOP] += _U(own.words)
            counts[END] += _U(own.n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(258, dtype=np.int32)), pa.array(counts.astype(np.int64))],
                                         names=["symbol", "n"])

    out = np.zeros(258, np.int64)
    for r in train.mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r.symbol] = r.n
    return out


def fit(train: DataFrame, lexicon: Lexicon):
    """The broadcast model and lexicon of all texts in ``train``, and the weights and map that were learned."""
    spark = train.sparkSession
    code = Code(_symbol_counts(train))
    size = 1 << TABLE_BITS
    sent = spark.sparkContext.broadcast((code, lexicon))

    def spelled(own: _Slice, code: Code, lexicon: Lexicon):
        _, which, n, parts = own.spelled(lexicon, code)
        often = np.bincount(which, minlength=n).astype(np.float64)
        for s, a, b in parts:
            yield s, often[a:b]

    def count(batches):
        code, lexicon = sent.value
        table = new_table()
        for _, own in _slices(batches):
            for s, often in spelled(own, code, lexicon):
                count_into(table, s, often)
        yield from blobs.blocks_of(table)

    table = blobs.gather(train.mapInArrow(count, blobs.SCHEMA), _PREDICTORS * size * 2, "uint32",
                         lambda a, b: np.minimum(a.astype(_U) + b, 0xFFFFFFFF).astype(np.uint32))
    model = Model(code, table.reshape(_PREDICTORS, size, 2))
    sent_model = spark.sparkContext.broadcast(model)
    width = model.weights.size + model.map.size + 1

    def learn(batches):
        model, (_, lexicon) = sent_model.value, sent.value
        weights, tally, seen = model.weights.copy(), np.zeros_like(model.map), 0
        for _, own in _slices(batches):
            for s, often in spelled(own, model.code, lexicon):
                model.learn(s, often, weights, tally)
                seen += s.count
        if seen:  # weights go in by the number of bits that made them
            yield from blobs.blocks_of(np.concatenate([weights.ravel() * seen, tally.ravel(), [seen]]))

    total = blobs.gather(train.mapInArrow(learn, blobs.SCHEMA), width, "float64")
    learned = None
    if total[-1]:
        learned = ((total[:model.weights.size] / total[-1]).reshape(model.weights.shape),
                   total[model.weights.size:-1].reshape(model.map.shape))
    return sent_model, sent, learned


_SCORED = "doc_id long, held_out boolean, row long, n_tokens long, bits double, n_bytes long, known long, logs double, rare array<long>"
_SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()),
                           ("bits", pa.float64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()),
                           ("rare", pa.list_(pa.int64()))])


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Learns from rows for which ``is_training`` holds and scores all. Words are runs of non-space bytes with A-Z
    lower-cased; every text ends with one end, so a null or empty text has one token. ``bits_per_byte`` counts a byte
    for every token beside those of its words. Rows may repeat ids or texts, and ids be null; without training rows all
    predictors are even and ``base_score`` counts every token as unseen. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", ~is_training(F.col("doc_id")))
    train = docs.where("not held_out")
    counts = _token_counts(train)
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
    token, often = top["token"].to_numpy(np.int64).view(_U), top["count"].to_numpy(np.int64)
    lexicon = Lexicon(token, often, int(n - often.sum()))
    sent_model, sent, learned = fit(train, lexicon)
    scale = n + 0.5 * (v + 1)

    def run(batches):
        own_model, (_, lexicon) = sent_model.value, sent.value
        if learned is not None:
            own_model.weights, own_model.map = learned
        row = 0
        for part, own in _slices(batches):
            place, which, _, parts = own.spelled(lexicon, own_model.code)
            bits = np.concatenate([own_model.bits(s, b - a) for s, a, b in parts])
            rows, known = own.rows, place >= 0
            logs = np.where(known, np.log10((np.append(lexicon.often, 0)[place] + 0.5) / scale), 0)
            total = lambda x: np.bincount(rows, x, own.n)
            size = np.bincount(rows[:own.words], own.ends - own.starts, own.n).astype(np.int64)
            number = np.bincount(rows, minlength=own.n)
            missing = np.flatnonzero(~known)
            missing = missing[np.argsort(rows[missing], kind="stable")]
            cut = np.searchsorted(rows[missing], np.arange(own.n + 1))
            left = own.hashed[missing].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(np.arange(row, row + own.n)), pa.array(number),
                 pa.array(total(bits[which])), pa.array(size + number),
                 pa.array(total(known).astype(np.int64)), pa.array(total(logs)),
                 pa.array([left[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int64()))], schema=_SCORED_ARROW)
            row += own.n

    scored = docs.select("doc_id", "held_out", "text").mapInArrow(run, _SCORED) \
        .withColumn("row", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("row"))
    scored = stage(scored, "scored")
    rare = scored.select("row", F.explode("rare").alias("token"))
    log = F.log10((F.coalesce("count", F.lit(0)) + 0.5) / F.lit(scale))
    tail = rare.join(counts, "token", "left").groupBy("row").agg(
        F.count("count").alias("tail_known"),
        F.sum(log).alias("tail_logs"))
    zero = F.lit(0)
    return scored.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") + F.coalesce("tail_logs", zero)).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
