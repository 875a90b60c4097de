"""Top-k by cosine over a table of vectors.

Tables have an id column and an ``array<float>`` column. Work is cut into blocks of bounded size that one task
multiplies at a time; a block emits at most ``k`` rows per question, and the per-question ranking follows. Few
questions travel to every task as one bounded matrix; more than that are cut into blocks themselves and meet the vector
blocks in a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from retrievo.functions.vectors import relevance
from retrievo.operators.blocks import SCORE_DIGITS, LocalTopK, arrow_type, hits_ddl, id_array
from retrievo.operators.ordered import top_k
from retrievo.staging import stage
# scores one task holds at a time, and questions that they are for where blocks of questions meet blocks of vectors
SCORE_CELLS = 4_000_000
SLICE = 1024


def _matrix(ids: pa.ChunkedArray | pa.Array, vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of the vectors that have ``dim`` elements; others score 0 and are dropped."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    keep = lengths == dim
    if not keep.all():
        mask = pa.array(keep)
        ids, vectors = ids.filter(mask), vectors.filter(mask)
    rows = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(ids), dim)
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return id_array(ids), np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _block_hits(q_ids, q_rows, ids, rows, k: int, min_score: float, types: tuple[str, str]) -> pa.RecordBatch:
    """Best rows of a block, whose scores are made in parts of ``SCORE_CELLS``."""
    best = LocalTopK(len(q_ids), k, min_score)
    step = max(1, SCORE_CELLS // max(1, len(q_ids)))
    for start in range(0, len(ids), step):
        best.add(ids[start:start + step], rows[start:start + step] @ q_rows.T)
    return best.hits(q_ids, *types)


def vector_candidates(index: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0,
                      broadcast_bytes: int = 32 << 20, block_rows: int = 32_768) -> DataFrame:
    """Block-wise best rows; the best ``k`` per question are among them.

    ``index``: doc_id, embedding. ``queries``: query_id, embedding.
    """
    queries = stage(queries.select("query_id", "embedding"), "query_vectors")
    ddl, types = hits_ddl(queries, index), (dict(queries.dtypes)["query_id"], dict(index.dtypes)["doc_id"])
    dim_row = queries.agg(F.max(F.size("embedding")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    dim, n_queries = dim_row["d"] or 0, dim_row["n"]
    index = index.select("doc_id", "embedding").filter(F.size("embedding") == dim)
    if n_queries * dim * 8 <= broadcast_bytes:
        table = queries.toArrow()
        q_ids, q_rows = _matrix(table["query_id"], table["embedding"], dim)
        shared = index.sparkSession.sparkContext.broadcast((q_ids, q_rows))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_q, rows_q = shared.value
            best = LocalTopK(len(ids_q), k, min_score)
            step = max(1, SCORE_CELLS // max(1, len(ids_q)))
            for batch in batches:
                ids, rows = _matrix(batch.column(0), batch.column(1), dim)
                for start in range(0, len(ids), step):
                    best.add(ids[start:start + step], rows[start:start + step] @ rows_q.T)
            yield best.hits(ids_q, *types)

        return index.mapInArrow(scan, ddl)

    q_blocks = max(1, math.ceil(n_queries * dim * 8 / broadcast_bytes))
    d_blocks = max(1, math.ceil(index.count() / block_rows))
    left = (index.withColumn("_d", F.pmod(F.xxhash64("doc_id"), F.lit(d_blocks)))
            .withColumn("_q", F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)"))))
    right = (queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))
             .withColumn("_d", F.explode(F.expr(f"sequence(0L, {d_blocks - 1}L)"))))

    def cell(docs: pa.Table, asks: pa.Table) -> pa.Table:
        ids, rows = _matrix(docs["doc_id"], docs["embedding"], dim)
        q_ids, q_rows = _matrix(asks["query_id"], asks["embedding"], dim)
        return pa.Table.from_batches([
            _block_hits(q_ids[at:at + SLICE], q_rows[at:at + SLICE], ids, rows, k, min_score, types)
            for at in range(0, max(1, len(q_ids)), SLICE)])

    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(cell, ddl)


def vector_search(index: DataFrame, queries: DataFrame, k: int = 20, min_score: float = 0.7,
                  score: str = "cosine", **blocks) -> DataFrame:
    """Exact top ``k`` per question with score at least ``min_score``: query_id, doc_id, score, rank.

    ``score="relevance"`` reports and filters (1 + cosine) / 2.
    """
    raw_floor = min_score if score == "cosine" else 2 * min_score - 1
    hits = top_k(vector_candidates(index, queries, k, raw_floor, **blocks), ["query_id"],
                 [F.desc("score"), F.asc("doc_id")], k)
    return hits if score == "cosine" else hits.withColumn("score", relevance(F.col("score")))


def sampled_centroids(index: DataFrame, n_cells: int) -> DataFrame:
    """Cell centres taken from the data: the vectors whose id hashes lowest. cell, centre."""
    # n_cells rows in all, so one task may number them
    chosen = index.select("doc_id", "embedding", F.md5(F.col("doc_id").cast("string")).alias("_h")) \
        .orderBy("_h", "doc_id").limit(n_cells)
    return chosen.select((F.row_number().over(Window.orderBy("_h", "doc_id")) - 1).cast("long").alias("cell"),
                         F.col("embedding").alias("centre"))


def kmeans_centroids(index: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 10) -> DataFrame:
    """Cell centres from k-means on cosine distance. cell, centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = index.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return index.sparkSession.createDataFrame(rows, "cell long, centre array<float>")


def nearest_cells(vectors: DataFrame, centroids: DataFrame, n: int, id_col: str) -> DataFrame:
    """The ``n`` closest cells of each vector: the id column, embedding and ``cell``, best first in ``rank``."""
    table = centroids.toArrow()  # one row per cell
    dim = len(table["centre"][0])
    cells, centres = _matrix(table["cell"], table["centre"], dim)
    shared = vectors.sparkSession.sparkContext.broadcast((cells, centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points = shared.value
        for batch in batches:
            ids, rows = _matrix(batch.column(0), batch.column(1), dim)
            scores = np.round(rows @ points.T, SCORE_DIGITS)
            best = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :n]
            each = pa.array(np.repeat(np.arange(len(ids)), best.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), batch.column(1).take(each), pa.array(names[best].ravel()),
                 pa.array(np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(ids)))],
                names=[id_col, "embedding", "cell", "rank"])

    kind = dict(vectors.dtypes)[id_col]
    sized = vectors.select(id_col, F.col("embedding").cast("array<double>").alias("embedding"))
    return sized.filter(F.size("embedding") == dim).mapInArrow(
        assign, f"{id_col} {kind}, embedding array<double>, cell long, rank int")


def build_ivf(index: DataFrame, n_cells: int, method: str = "sampled") -> tuple[DataFrame, DataFrame]:
    """Cell centres and the vectors with their cell: (cell, centre) and (doc_id, embedding, cell)."""
    index = index.select("doc_id", "embedding")
    made = sampled_centroids(index, n_cells) if method == "sampled" else kmeans_centroids(index, n_cells)
    centroids = stage(made, "centroids")
    return centroids, stage(nearest_cells(index, centroids, 1, "doc_id"), "ivf").drop("rank")


def ivf_search(ivf: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, nprobe: int, min_score: float = -1.0,
               block_rows: int = 32_768) -> DataFrame:
    """Top ``k`` among the vectors of each question's ``nprobe`` closest cells.

    A cell larger than ``block_rows`` is cut into blocks, and only the questions that probe a cell meet its blocks.
    """
    centroids, members = ivf
    queries = stage(queries.select("query_id", "embedding"), "query_vectors")
    ddl, types = hits_ddl(queries, members), (dict(queries.dtypes)["query_id"], dict(members.dtypes)["doc_id"])
    schema = pa.schema([("query_id", arrow_type(types[0])), ("doc_id", arrow_type(types[1])), ("score", pa.float64())])
    blocks = stage(members.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks")), "cell_sizes")
    probed = stage(nearest_cells(queries, centroids, nprobe, "query_id").drop("rank"), "probes")
    wanted = members.join(probed.select("cell").distinct(), "cell", "left_semi")
    docs = wanted.join(blocks, "cell").select(
        "doc_id", "embedding", "cell", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).alias("_b"))
    probes = (probed.join(blocks, "cell")
              .withColumn("_b", F.explode(F.expr("sequence(0L, CAST(_blocks - 1 AS BIGINT))")))
              .select("query_id", "embedding", "cell", "_b"))

    def cell_block(found: pa.Table, asks: pa.Table) -> pa.Table:
        if len(found) == 0 or len(asks) == 0:
            return pa.Table.from_batches([], schema=schema)
        dim = len(asks["embedding"][0])
        ids, rows = _matrix(found["doc_id"], found["embedding"], dim)
        # questions go through in slices, so the score matrix stays bounded
        parts = []
        for start in range(0, len(asks), SLICE):
            piece = asks.slice(start, SLICE)
            q_ids, q_rows = _matrix(piece["query_id"], piece["embedding"], dim)
            parts.append(_block_hits(q_ids, q_rows, ids, rows, k, min_score, types))
        return pa.Table.from_batches(parts, schema=schema)

    hits = docs.groupBy("cell", "_b").cogroup(probes.groupBy("cell", "_b")).applyInArrow(cell_block, ddl)
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def recall_against(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per question: share of the true hits that were found."""
    return (truth.select("query_id", "doc_id")
            .join(found.select("query_id", "doc_id", F.lit(1).alias("_hit")), ["query_id", "doc_id"], "left")
            .groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n_true"), (F.count("_hit") / F.count(F.lit(1))).alias("recall")))
