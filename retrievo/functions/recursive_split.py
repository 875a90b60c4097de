"""Recursive splitting of texts: paragraphs, lines, sentences, words, characters."""

from __future__ import annotations

import re

_LEVELS = [(re.compile(r"\s*\n\s*\n\s*"), "\n\n"), (re.compile(r"\s*\n\s*"), "\n"),
           (re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*"), " "), (re.compile(r"\s+"), " ")]
_SENTENCE = _LEVELS[2][0]


class _Packer:
    """Chunks so far, and the pieces of the one being filled."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.chunks: list[str] = []
        self.pieces: list[str] = []
        self.length = 0
        self.fresh = False  # whether the pieces hold more than the overlap with the chunk before

    def fits(self, part: str, joiner: str) -> bool:
        return self.length + (len(joiner) if self.length else 0) + len(part) <= self.size

    def add(self, part: str, joiner: str) -> None:
        if self.length:
            self.pieces.append(joiner)
            self.length += len(joiner)
        self.pieces.append(part)
        self.length += len(part)
        self.fresh = True

    def flush(self) -> None:
        """Close the chunk; the next one begins with its last whole sentences, as many as the overlap holds."""
        chunk = "".join(self.pieces)
        self.chunks.append(chunk)
        self.start(last_sentences(chunk, self.overlap))

    def start(self, text: str) -> None:
        self.pieces, self.length, self.fresh = [text] if text else [], len(text), False


def last_sentences(chunk: str, most: int) -> str:
    """The longest run of whole sentences at the end of ``chunk`` with at most ``most`` characters."""
    if len(chunk) <= most:
        return chunk
    if most <= 0:
        return ""
    near = chunk[-(most + 64):]  # a border further away cannot be the one; white space between sentences is short
    for m in _SENTENCE.finditer(near):
        if m.end() > 0 and len(near) - m.end() <= most:
            return near[m.end():]
    return ""


def _pack(text: str, level: int, packer: _Packer) -> None:
    if level == len(_LEVELS):
        if packer.fresh:
            packer.flush()
        packer.start("")
        for at in range(0, len(text), packer.size):
            if packer.fresh:
                packer.flush()
                packer.start("")
            packer.add(text[at:at + packer.size], "")
        return
    pattern, joiner = _LEVELS[level]
    for part in pattern.split(text):
        if not part:
            continue
        if not packer.fits(part, joiner) and packer.fresh:
            packer.flush()
        if packer.fits(part, joiner):
            packer.add(part, joiner)
        elif len(part) <= packer.size:  # the part alone fits, so the overlap is given up
            packer.start("")
            packer.add(part, joiner)
        else:
            _pack(part, level + 1, packer)


def recursive_chunks(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters, filled greedily with the largest parts that fit.

    A text is cut into paragraphs; a part that is too long is cut into lines, these into sentences, words and at last
    characters. Neighbouring chunks share whole sentences of at most ``overlap`` characters where both fit. Time is
    linear in the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in 0..size-1")
    text = (text or "").strip()
    packer = _Packer(size, overlap)
    _pack(text, 0, packer)
    if packer.fresh:
        packer.chunks.append("".join(packer.pieces))
    return packer.chunks
