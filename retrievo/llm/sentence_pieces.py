"""SentencePiece encoding by a table of last tokens of prefixes, and decoding.

The library joins neighbours, best score first and then leftmost, wherever the joined string is a piece. In its result
each two neighbouring tokens are compatible: encoded on their own they stay as they are; and a chain of compatible
tokens is the result, because the first join across a token's border would happen in the pair alone too. So every
prefix has one last token. An automaton over all pieces gives the tokens that end at each letter, longest first; the
first one that is compatible with the last token of the prefix before it is stored. The ids are then read off
backwards.

Two neighbouring letters that no piece holds side by side, such as a letter and the space after it, are never joined:
texts are cut there. Distinct stretches are encoded once and kept by the worker in two generations, so frequent ones
stay. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from retrievo.llm.piece_model import SPACE, read_model
from retrievo.llm.words import column_bytes, slices

SLICE = 4 << 20        # text bytes handled at once, or one text
KEPT = 250_000         # stretches in a generation
KEPT_PAIRS = 500_000   # pairs whose compatibility is remembered
_UNKNOWN = -1


class Encoder:
    """Pieces of a model file, and the state that a worker keeps between batches."""

    def __init__(self, model: bytes):
        self.model = read_model(model)
        ids = self.model.ids
        self.text = {i: t for t, i in ids.items()}
        self.width = {i: len(t) for t, i in ids.items()}
        self.size = len(self.model.surfaces)
        self.matches = ahocorasick.Automaton()
        for t, i in ids.items():
            self.matches.add_word(t, (i, len(t), self.joined(t) == [t]))
        self.matches.make_automaton()
        self.cuts = np.zeros((256, 256), bool)  # one-byte letters, spaces among them, that no piece holds in a row
        self.cuts[:128, :128] = True
        for t in ids:
            row = t.replace(SPACE, " ").encode()
            self.cuts[list(row[:-1]), list(row[1:])] = False
        self.lengths = np.array([len(s) for s in self.model.surfaces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.model.surfaces), np.uint8)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def joined(self, text: str) -> list[str]:
        """The text's letters joined pair by pair: best score first, then leftmost."""
        scores, parts = self.model.scores, list(text)
        worst = float("-inf")
        gain = [scores.get(a + b, worst) for a, b in zip(parts, parts[1:])]
        while gain and (best := max(gain)) > worst:
            i = gain.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = scores.get(parts[i - 1] + parts[i], worst)
            if i < len(gain):
                gain[i] = scores.get(parts[i] + parts[i + 1], worst)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their letters are encoded together."""
        key = left * self.size + right
        if (known := self.pairs.get(key)) is None:
            a, b = self.text[left], self.text[right]
            known = a + b not in self.model.ids and self.joined(a + b) == [a, b]
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix of a stretch; letters that no piece holds are unknown."""
        last: list[int] = []
        known, size = self.pairs, self.size
        for end, (token, width, whole) in self.matches.iter(text):
            at = len(last)
            if at > end:  # a longer token that ends here fits
                continue
            if at < end:
                last.extend([_UNKNOWN] * (end - at))
            before = last[end - width] if end >= width else _UNKNOWN
            if before == _UNKNOWN:
                fits = whole
            elif (fits := known.get(before * size + token)) is None:
                fits = self.compatible(before, token)
            if fits:
                last.append(token)
        last.extend([_UNKNOWN] * (len(text) - len(last)))
        return last

    def stretch(self, raw: bytes) -> bytes:
        """Ids of one stretch as 32-bit numbers, found backwards from its end."""
        text = raw.decode("utf-8", "replace").replace(" ", SPACE)
        last = self.last_tokens(text)
        out, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            if token == _UNKNOWN:
                out.extend(self.model.bytes_[b] for b in reversed(text[at].encode()))
                at -= 1
            else:
                out.append(token)
                at -= self.width[token]
        return np.array(out[::-1], np.uint32).tobytes()

    def _lookup(self, raw: bytes) -> bytes:
        found = self.young.get(raw)
        if found is None:
            found = self.old.get(raw)
            if found is None:
                found = self.stretch(raw)
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[raw] = found
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, begin and end ids included, and where each text's ids begin."""
        column = pc.replace_substring(column.cast(pa.large_string()), SPACE, " ")
        data, borders = column_bytes(column)
        sizes = np.diff(borders)
        filled = sizes > 0
        data = np.insert(data, borders[:-1][filled], 32)  # the dummy space before each text
        borders = np.concatenate([[0], np.cumsum(sizes + filled)])
        cut = np.zeros(len(data), bool)
        cut[1:] = self.cuts[data[:-1], data[1:]]
        cut[borders[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(data)).astype(np.int64)
        stretches = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                          [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = stretches.dictionary_encode()
        found = [self._lookup(raw) for raw in coded.dictionary.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        which = coded.indices.to_numpy(zero_copy_only=False)
        count = counts[which] if len(which) else np.zeros(0, np.int64)
        first = (np.cumsum(counts) - counts)[which] if len(which) else count
        total = np.concatenate([[0], np.cumsum(count)])
        own = total[np.searchsorted(starts, borders)]  # ids before each text, begin and end ids aside
        ids = flat[np.arange(total[-1]) + np.repeat(first - total[:-1], count)]
        heads = own + 2 * np.arange(len(own))
        out = np.full(len(ids) + 2 * len(column), self.model.end, np.uint32)
        out[heads[:-1]] = self.model.begin
        out[np.arange(len(ids)) + np.repeat(2 * np.arange(len(column)) + 1, np.diff(own))] = ids
        return out, heads

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of a text's ids: begin and end ids are nothing, and the dummy space goes."""
        ids = ids.astype(np.int64)
        count = self.lengths[ids]
        out = self.bytes[np.arange(count.sum()) + np.repeat(self.starts[ids] - (np.cumsum(count) - count), count)]
        return (out[1:] if len(out) and out[0] == 32 else out).tobytes()


_loaded: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder for each worker process and model, with what it has met."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(model)
    return _loaded[key]


DIGESTS = StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
_RESULTS = [StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())]


def encode_pieces(docs: DataFrame, model: bytes, digests: bool = False, text: str = "text") -> DataFrame:
    """Every row with ``token_ids`` and ``decoded``, or with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``model`` is a model file's content; it is broadcast, as its size is that of the vocabulary. Ids are those of the
    file's own library with begin and end ids and without sampling. A null or empty text has just these two ids and
    decodes to the empty text. Columns named like a result are replaced, all others kept; rows may repeat, ids be null
    and the table be empty. A very long text is handled alone: memory is some twenty times its bytes, time grows in
    proportion, also where it has no space.
    """
    fields = DIGESTS.fields if digests else _RESULTS
    docs = docs.drop(*[f.name for f in fields])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = encoder(sent.value)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, heads = own.encode(part.column(text))
                rows = [ids[a:b] for a, b in zip(heads[:-1], heads[1:])]
                texts = [own.decode(r) for r in rows]
                if digests:
                    columns = [pa.array(np.diff(heads), pa.int64()),
                               pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], pa.string()),
                               pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                else:
                    columns = [pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(ids.astype(np.int32))),
                               pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns],
                                                 names=[*part.schema.names, *[f.name for f in fields]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def default_path() -> str:
    """The installed model with byte fallback."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def read_file(path: str) -> bytes:
    """A model file of the driver's machine."""
    with open(path, "rb") as f:
        return f.read()
