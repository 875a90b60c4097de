"""Helpers for numpy work inside tasks: fixed-size tables added up over all tasks, and runs of sorted rows.

Each task of a first pass sends its part of the table as blocks. Blocks are added as they stream in, so no task holds
more than the blocks dealt to it, however many tasks sent one. The size of the table is a parameter and not a property
of the data, which bounds what the driver receives and broadcasts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 16
SCHEMA = "block int, data binary"
_ARROW = pa.schema([("block", pa.int32()), ("data", pa.binary())])


def give_back() -> None:
    """Return what this worker has freed to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """A task's function that gives back its memory at the end: workers live on, and the next stage's come on top."""
    @wraps(run)
    def task(*args):
        yield from run(*args)
        give_back()

    return task


def _pack(part: np.ndarray) -> bytes:
    """The block in the narrowest numbers that hold it; of a sparse one the places and numbers that are not zero."""
    narrow = next((t for t in (np.uint8, np.uint16) if part.dtype.kind == "u" and part.max() <= np.iinfo(t).max),
                  part.dtype)
    at = np.flatnonzero(part)
    if len(at) * (2 + np.dtype(narrow).itemsize) < len(part) * np.dtype(narrow).itemsize:
        return b"s" + np.dtype(narrow).char.encode() + at.astype("<u2").tobytes() + part[at].astype(narrow).tobytes()
    return b"d" + np.dtype(narrow).char.encode() + part.astype(narrow).tobytes()


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(chr(data[1]))
    if data[:1] == b"d":
        return np.frombuffer(data, kind, offset=2).astype(dtype)
    n = (len(data) - 2) // (2 + kind.itemsize)
    out = np.zeros(BLOCK, dtype)
    out[np.frombuffer(data, "<u2", n, 2)] = np.frombuffer(data, kind, n, 2 + 2 * n)
    return out


def blocks_of(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's part of the table, without the blocks that are all zero."""
    for i in range(0, len(table), BLOCK):
        part = table[i:i + BLOCK]
        if part.any():
            part = np.pad(part, (0, BLOCK - len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([_pack(part)])],
                                             schema=_ARROW)


def gather(parts: DataFrame, length: int, dtype: str, add: Callable = np.add) -> np.ndarray:
    """The whole table from all tasks' blocks; ``add`` combines two blocks."""

    @giving_back
    def together(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = _unpack(data.as_py(), dtype)
                held[block] = add(held[block], part) if block in held else part
        for block, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(part)])],
                                             schema=_ARROW)

    tasks = max(1, min(-(-length // BLOCK), parts.sparkSession.sparkContext.defaultParallelism))
    out = np.zeros(length, dtype)
    for block, data in parts.repartition(tasks, "block").mapInArrow(together, SCHEMA).toLocalIterator():
        part = _unpack(bytes(data), dtype)
        out[block * BLOCK:(block + 1) * BLOCK] = part[:length - block * BLOCK]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Key values and rows of each run of equal keys; the input is sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(values)]):
            if last is not None and (values[a] != last).any():
                yield last, _one(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield last, _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
