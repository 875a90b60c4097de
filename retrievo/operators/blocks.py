"""Top-k bookkeeping inside one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCORE_DIGITS = 9
_MARGIN = 2 * 10.0 ** -SCORE_DIGITS  # scores further apart than this differ once rounded


def hits_ddl(queries: DataFrame, docs: DataFrame) -> str:
    """Columns of hits whose ids have the types that questions and documents have."""
    return f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score double"


def id_array(column) -> np.ndarray:
    """Ids as numbers, or as text that sorts by code point."""
    return column.to_numpy(zero_copy_only=False).astype(str) if pa.types.is_string(column.type) else np.asarray(column)


def arrow_type(spark_type: str) -> pa.DataType:
    return pa.string() if spark_type == "string" else {"int": pa.int32()}.get(spark_type, pa.int64())


class LocalTopK:
    """Best ``k`` rows per question over the score blocks that one task sees; equal scores are ordered by id.

    Holds at most ``k`` rows per question between blocks. A block adds only scores that reach the question's current
    ``k``-th best, or the block's own where most of a block would do so.
    """

    def __init__(self, n_queries: int, k: int, min_score: float):
        self.k = k
        self.floor = np.full(n_queries, min_score)
        self.query = np.empty(0, np.int64)
        self.ids: np.ndarray | None = None
        self.score = np.empty(0, np.float64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: one row per id, one column per question."""
        reach = self.floor - _MARGIN  # only scores that may reach the floor are rounded
        near = scores >= reach
        if len(ids) > self.k and np.count_nonzero(near) > 4 * self.k * len(reach):
            scores = np.where(np.isnan(scores), -np.inf, scores)
            near = scores >= np.maximum(reach, np.partition(scores, -self.k, axis=0)[-self.k] - _MARGIN)
        rows, cols = np.nonzero(near)
        value = np.round(scores[rows, cols], SCORE_DIGITS)
        keep = value >= self.floor[cols]
        rows, cols, value = rows[keep], cols[keep], value[keep]
        query = np.concatenate([self.query, cols])
        found = ids[rows] if self.ids is None else np.concatenate([self.ids, ids[rows]])
        score = np.concatenate([self.score, value])
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        starts = np.searchsorted(query, query, side="left")
        position = np.arange(len(query)) - starts
        keep = position < self.k
        last = position == self.k - 1
        self.floor[query[last]] = score[last]
        self.query, self.ids, self.score = query[keep], found[keep], score[keep]

    def hits(self, query_ids: np.ndarray, query_type: str = "bigint", doc_type: str = "bigint") -> pa.RecordBatch:
        ids = [] if self.ids is None else self.ids.tolist()
        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.query].tolist(), arrow_type(query_type)),
                                           pa.array(ids, arrow_type(doc_type)), pa.array(self.score)],
                                          names=["query_id", "doc_id", "score"])
