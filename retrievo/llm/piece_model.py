"""A SentencePiece BPE model file: its pieces and settings, read from the file's own message format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

SPACE = "▁"  # stands for a space inside pieces

# Field numbers and piece kinds of the file format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, KIND = 1, 2, 3
MODEL_TYPE, BPE, BYTE_FALLBACK, WHITE_SPACE_AFTER = 3, 2, 35, 24
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a message; floats and nested messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _number(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    """Normal pieces with their ids and scores, and the ids of all others."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]     # id of each byte
    begin: int
    end: int
    surfaces: list[bytes]  # what each id decodes to


def read_model(data: bytes) -> PieceModel:
    """The model in a file's bytes; ValueError for one of another kind than this package encodes.

    Needed are: BPE with byte fallback, no character map, a dummy space before the text, all white space kept, only
    normal, unknown, control and byte pieces, and each letter of a piece a piece itself.
    """
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == PIECE:
            pieces.append(dict(fields(value)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
    if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or trainer.get(WHITE_SPACE_AFTER):
        raise ValueError("a BPE model with byte fallback and leading white space is needed")
    if normalizer.get(CHARACTER_MAP) or not normalizer.get(DUMMY_PREFIX, 1) or normalizer.get(REMOVE_EXTRA, 1) \
            or not normalizer.get(ESCAPE, 1):
        raise ValueError("a model that leaves letters and white space as they are is needed")
    ids, scores, bytes_, named, surfaces = {}, {}, [-1] * 256, {}, []
    for i, piece in enumerate(pieces):
        text, kind = piece[TEXT].decode(), piece.get(KIND, NORMAL)
        surfaces.append(b"")
        if kind == NORMAL:
            ids[text] = i
            scores[text] = struct.unpack("<f", piece.get(SCORE, bytes(4)))[0]
            surfaces[i] = text.replace(SPACE, " ").encode()
        elif kind == BYTE:
            bytes_[int(text[3:5], 16)] = i
            surfaces[i] = bytes([int(text[3:5], 16)])
        elif kind in (CONTROL, UNKNOWN):
            named[text] = i
        else:
            raise ValueError(f"pieces of kind {kind} are not supported")
    if min(bytes_) < 0 or not {c for t in ids for c in t} <= set(ids):
        raise ValueError("every byte and every letter must be a piece")
    return PieceModel(ids, scores, bytes_, named["<s>"], named["</s>"], surfaces)
