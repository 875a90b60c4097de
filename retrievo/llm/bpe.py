"""BPE encoding by a trie of distinct words, and decoding by token bytes.

A word's encoding is a chain of tokens in which every neighbouring pair is stable: merging the two tokens' own symbols
gives the same pair back. Therefore the encoding of a prefix is the encoding of a shorter prefix and one more token, and
the last token of each prefix tells the whole chain. Distinct words go into a trie that a task keeps; going down, each
new node finds its last token from those of its ancestors, so a prefix that many words share is encoded once. The tokens
that end at a node come from the vocabulary's suffix links, longest first. Documents are then put together from their
words' tokens. Nothing is shuffled.

No word crosses white space, so what stands between it is looked up as a whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from retrievo.llm.blobs import give_back
from retrievo.llm.words import slices

WORD_END = "</w>"
MEMORY_SPANS = 200_000  # distinct spans between white space in a generation; a task keeps two, so frequent ones stay
MEMORY_NODES = 1_000_000  # nodes of the trie that a task keeps before it starts a new one
MEMORY_PAIRS = 500_000
_ENDS = 256  # a byte that ends its word is another symbol


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and word pattern of a tokenizer file with word ends, and the state of the trie walk."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or model["dropout"]:
            raise ValueError("a BPE model with word ends and without dropout is needed")
        self.letters = _byte_letters()
        of_letter = {c: b for b, c in enumerate(self.letters)}
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.pattern = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self._stable: dict[int, bool] = {}
        self.keep()
        self._index_tokens(of_letter)
        size = max([*self.ids.values(), *self.special.values()]) + 1
        held = [b""] * size
        self.spaced = d.get("decoder") is None  # a file without a decoder puts spaces between tokens
        for t, i in self.ids.items():
            held[i] = t.encode() + b" " if self.spaced else bytes(of_letter[c] for c in t)
        for t, i in self.special.items():
            held[i] = t.encode() + b" " * self.spaced
        self.lengths = np.array([len(h) for h in held], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(held), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self._spans: dict[str, int] = {}
        self._flat, self._borders = array("I"), array("q", [0])
        self._old = ({}, self._flat, self._borders)
        self._words: dict[str, list[int]] = {}
        self._plant()

    def keep(self, share: float = 1.0) -> None:
        """Limits of what is kept, as a share of the full ones: less takes more time and gives the same ids."""
        self.spans_kept, self.nodes_kept, self.pairs_kept = (
            int(share * n) for n in (MEMORY_SPANS, MEMORY_NODES, MEMORY_PAIRS))

    def forget(self) -> None:
        """Give back what texts have taught, so that the worker's next tasks find its memory free."""
        self._reset()
        self._stable = {}
        give_back()

    def _plant(self) -> None:
        """An empty trie: children by (node, symbol), and for each node its automaton state and last token."""
        self._children: dict[int, int] = {}
        self._states, self._last = array("i", [0]), array("i", [-1])

    def _index_tokens(self, of_letter: dict[str, int]) -> None:
        """The automaton of all tokens over bytes: its steps, suffix links and the longest token that ends in a state; and
        for each token its parts, its length and the next shorter token that ends it."""
        self.tokens = {i: t for t, i in self.ids.items()}
        self.width = {i: len(self._symbols(t)) for t, i in self.ids.items()}
        self._steps: dict[int, int] = {}
        own, paths = array("i", [-1]), [()]
        for t, i in self.ids.items():
            *plain, end = self._symbols(t)
            path = [of_letter[c] for c in plain] + [of_letter[end.removesuffix(WORD_END) or end]
                                                    + _ENDS * (end.endswith(WORD_END) and end != WORD_END)]
            state = 0
            for symbol in path:
                key = state << 9 | symbol
                if key not in self._steps:
                    self._steps[key] = len(own)
                    own.append(-1)
                    paths.append((state, symbol))
                state = self._steps[key]
            own[state] = i
        # states come after the states of their prefixes, but links need those of all shorter ones
        depth = [0] * len(own)
        for state in range(1, len(own)):
            depth[state] = depth[paths[state][0]] + 1
        self._fail, self._ending, self.shorter = array("i", bytes(4 * len(own))), own[:], {}
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            parent, symbol = paths[state]
            self._fail[state] = self._step(self._fail[parent], symbol) if parent else 0
            below = self._ending[self._fail[state]]
            if own[state] >= 0:
                self.shorter[own[state]] = below
            else:
                self._ending[state] = below

    def _step(self, state: int, symbol: int) -> int:
        """The state of the longest suffix that some token begins with."""
        while (found := self._steps.get(state << 9 | symbol)) is None:
            if not state:
                return 0
            state = self._fail[state]
        return found

    @staticmethod
    def _symbols(token: str) -> list[str]:
        ended = token.endswith(WORD_END) and len(token) > len(WORD_END)
        letters = list(token[:-len(WORD_END)] if ended else token)
        if ended:
            letters[-1] += WORD_END
        return letters

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols merged pair by pair: lowest rank first, then leftmost."""
        parts, none = list(symbols), len(self.rank)
        ranks = [self.rank.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = self.rank.get((parts[i], parts[i + 1]), none)
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the symbols of two tokens together gives these two tokens; of one token, if ``left`` is -1."""
        key = left << 20 | right if left >= 0 else -1 - right
        if (known := self._stable.get(key)) is None:
            a, b = self._symbols(self.tokens[left]) if left >= 0 else [], self._symbols(self.tokens[right])
            joined = (["".join(a)] if a else []) + ["".join(b)]
            known = tuple(joined) not in self.rank and self.merged(a + b) == joined
            if len(self._stable) >= self.pairs_kept:
                self._stable.clear()
            self._stable[key] = known
        return known

    def learn(self, words: list[str]) -> None:
        """Ids of words, which come in order: down the trie from where the word leaves the one before it, with the last
        token of each prefix, and then backwards from the end."""
        if len(self._states) > self.nodes_kept:
            self._plant()
        children, states, lasts, width = self._children, self._states, self._last, self.width
        before, nodes, last = b"", [0], []  # the word before without its last symbol, its nodes, their last tokens
        for word in words:
            data = word.encode()
            end = len(data) - 1
            at, most = 0, min(end, len(before))
            while at < most and data[at] == before[at]:
                at += 1
            del nodes[at + 1:], last[at:]
            before = data[:end]
            node = nodes[at]
            while at <= end:
                symbol = data[at] + _ENDS if at == end else data[at]
                key = node << 9 | symbol
                child = children.get(key)
                if child is None:
                    state = self._step(states[node], symbol)
                    token = self._ending[state]
                    while token >= 0:
                        start = at + 1 - width[token]
                        if self.stable(last[start - 1] if start else -1, token):
                            break
                        token = self.shorter[token]
                    child = children[key] = len(states)
                    states.append(state)
                    lasts.append(token)
                node = child
                nodes.append(node)
                last.append(lasts[node])
                at += 1
            ids, at = [], end
            while at >= 0:
                ids.append(last[at])
                at -= width[last[at]]
            self._words[word] = ids[::-1]
            del nodes[end + 1:], last[end:]

    def _pieces(self, text: str) -> list[str]:
        """Special tokens of a text and what stands between white space elsewhere."""
        if self.split is None or not any(s in text for s in self.special):
            return _between_spaces(text)
        out = []
        for piece in self.split.split(text):
            out += [piece] if piece in self.special else _between_spaces(piece)
        return out

    def _learn_spans(self, fresh: list[str]) -> None:
        if len(self._words) > self.spans_kept:
            self._words = {}
        spans, flat, borders = self._old
        cut = {s: self.pattern.findall(_lower(s)) for s in fresh if s not in spans and s not in self.special}
        self.learn(sorted({w for words in cut.values() for w in words}.difference(self._words)))
        for span in fresh:
            if span in self.special:
                self._flat.append(self.special[span])
            elif (at := spans.get(span)) is not None:
                self._flat.extend(flat[borders[at]:borders[at + 1]])
            else:
                for word in cut[span]:
                    self._flat.extend(self._words[word])
            self._spans[span] = len(self._borders) - 1
            self._borders.append(len(self._flat))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._pieces(t) for t in texts]
        if len(self._spans) > self.spans_kept:
            self._old = (self._spans, self._flat, self._borders)
            self._spans, self._flat, self._borders = {}, array("I"), array("q", [0])
        fresh = set().union(*cut).difference(self._spans)
        if fresh:
            self._learn_spans(list(fresh))
        flat, borders = np.array(self._flat, np.uint32), np.array(self._borders, np.int64)
        out = []
        for spans in cut:
            which = np.fromiter(map(self._spans.__getitem__, spans), np.int64, len(spans))
            first, count = borders[which], borders[which + 1] - borders[which]
            at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            out.append(flat[at])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens in a row, as the file's decoder joins them; bytes that are no UTF-8 are replaced."""
        ids = ids.astype(np.int64)
        count = self.lengths[ids]
        at = np.arange(count.sum()) + np.repeat(self.starts[ids] - (np.cumsum(count) - count), count)
        out = self.bytes[at].tobytes()
        return (out[:-1] if self.spaced else out).decode("utf-8", "replace")


def _between_spaces(text: str) -> list[str]:
    """`str.split` also cuts at four separators that the pattern takes for symbols; such texts are cut by pattern."""
    return text.split() if _UNUSUAL.search(text) is None else regex.findall(r"\S+", text)


# Capitals of Unicode 16 and 17 and their small letters, which this Python's tables do not have yet.
_LATE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
         0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)} \
    | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
_HAS_LATE = regex.compile("[" + "".join(map(chr, _LATE)) + "]")


def _lower(text: str) -> str:
    """NFC and lower case letter by letter: a capital sigma is the same at the end of a word."""
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text.translate(_LATE) if not text.isascii() and _HAS_LATE.search(text) else text


_UNUSUAL = regex.compile("[\x1c-\x1f]")
_loaded: dict[str, Vocabulary] = {}


def vocabulary(definition: str) -> Vocabulary:
    """One vocabulary for each worker process and file, with the words that a task has met."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(definition)
    return _loaded[key]


DIGESTS = StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
_RESULTS = [StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())]


def tokenize(docs: DataFrame, definition: str, digests: bool = False, remember: float = 1.0) -> DataFrame:
    """Every row with ``token_ids`` and ``decoded``, or with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``definition`` is the text of a tokenizer file; it is broadcast, as its size is that of the vocabulary. Ids are
    those of the file's own library without added tokens, truncation and padding: its special strings in a text are
    their ids. ``decoded`` keeps special tokens and word ends. A null or empty text has no tokens and decodes to the
    empty text. Columns named like a result are replaced, all others kept; rows may repeat and ids be null. ``remember``
    is the share of a task's full memory for words met before, for jobs that need it for more than tokens.
    """
    fields = DIGESTS.fields if digests else _RESULTS
    docs = docs.drop(*[f.name for f in fields])
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        own = vocabulary(sent.value)
        own.keep(remember)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = own.encode([t or "" for t in part.column("text").to_pylist()])
                texts = [own.decode(i) for i in ids]
                columns = [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(texts)]
                if digests:
                    columns = [pa.array([len(i) for i in ids], pa.int64()),
                               pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
                               pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns],
                                                 names=[*part.schema.names, *[f.name for f in fields]])
        own.forget()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def default_path() -> str:
    """The installed vocabulary with word ends."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def read_definition(path: str) -> str:
    """A tokenizer file of the driver's machine."""
    with open(path, encoding="utf-8") as f:
        return f.read()
