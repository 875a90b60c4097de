"""Embedding whitening with distributed block matrices.

Vectors become exact whole numbers on a grid. The distinct ones are numbered, centred and cut into blocks of rows; the
block matrix times its own transpose is the scatter, whose eigenvectors are taken on the driver, as it has only the size
of the dimensions. All rows are then multiplied, block by block, by the whitening matrix.

The product of a transpose has few result blocks and one inner dimension as long as the table, so that dimension is
split: each split is multiplied in a task of its own and only products are added up. The driver holds the places of the
blocks, one for each ``block_rows`` rows, but no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievo.staging import stage

SCALE, SHIFT = 64, 1_000_000  # steps of the grid in one unit, and what makes its numbers positive
COMPONENTS = 16
BLOCK_ROWS = 4096
BLOCK_COLUMNS = 256
SPLIT_BLOCKS = 16  # blocks of rows that one task of the scatter adds up
TINY = 1e-12       # a component with less of the largest one's variance has none


def on_grid(vector: str) -> Column:
    """A vector's components as whole numbers."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither null nor a number that is not finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows, staged, with consecutive numbers ``index`` from 0: their places in a task, and the tasks' counts before.

    The counts are one row for each task that wrote the table; they are broadcast.
    """
    rows = stage(rows.withColumn("_place", F.monotonically_increasing_id()), name)
    task = F.shiftright("_place", 33)
    counts = sorted((r["task"], r["n"]) for r in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    known = rows.sparkSession.createDataFrame([(t, b) for (t, _), b in zip(counts, before)], "_task long, _before long")
    return rows.withColumn("_task", task).join(F.broadcast(known), "_task") \
        .withColumn("index", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_task", "_place", "_before")


def block_matrix(rows: DataFrame, vector: Column, block_rows: int) -> BlockMatrix:
    """Numbered rows as blocks; ``vector`` is an array of doubles."""
    rows = rows.select("index", array_to_vector(vector).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector")).toBlockMatrix(block_rows, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix; ``SPLIT_BLOCKS`` blocks of rows are multiplied in a task."""
    splits = max(1, -(-matrix.numRowBlocks // SPLIT_BLOCKS))
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    product = BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock)
    return product.toLocalMatrix().toArray()


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """``index`` and ``values`` of every row."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select("index", vector_to_array("vector").alias("values"))


def local_blocks(spark, matrix: np.ndarray) -> BlockMatrix:
    """A matrix of the driver in blocks."""
    step = BLOCK_COLUMNS
    blocks = []
    for i in range(0, matrix.shape[0], step):
        for j in range(0, matrix.shape[1], step):
            part = matrix[i:i + step, j:j + step]
            blocks.append(((i // step, j // step), DenseMatrix(*part.shape, part.T.ravel().tolist())))
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), step, step, *matrix.shape)


def eigenvectors(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit vectors in columns, at most ``most`` and only those that vary.

    Of each vector the largest entry in size is positive; the first one where several are.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > TINY * max(values.max(initial=0), 0)]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[top, np.arange(len(values))])


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id``, ``n``, ``deviation``, ``whitened`` (array of the components), ``explained`` (array) and
    ``identity_error`` of every row with a vector of finite numbers.

    ``n`` counts the distinct vectors on the grid, the ones the transformation is fitted to. ``deviation`` is the exact
    sum over the dimensions of (n x - S)^2, with S the sum of the distinct vectors; an error is raised where it passes
    64 bits. ``whitened`` are a row's projections on the eigenvectors of the distinct vectors' covariance, each divided
    by the root of its eigenvalue; ``explained`` is the eigenvalues' share in the trace, and ``identity_error`` the
    largest entry in size of the whitened distinct vectors' covariance minus the identity.

    Rows with a null or empty vector, or one with a component that is null or not finite, are left out, as are
    components without variance: fewer than two distinct vectors give no row. All vectors must have one length, else
    ValueError. Ids may be null and repeat, rows repeat; other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    named = named.where(finite("vector") & (F.size("vector") > 0)).select("vec_id", on_grid("vector").alias("x"))
    every = numbered(named, "grid")
    widths = [r.width for r in every.select(F.size("x").alias("width")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} and of {widths[1]} components")
    fit = numbered(every.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct")
    sums = fit.select(F.posexplode("x").alias("dimension", "value")).groupBy("dimension") \
        .agg(F.sum("value").alias("s"), F.count("*").alias("n")).orderBy("dimension").collect()
    n = sums[0].n if sums else 0
    schema = "vec_id {}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    schema = schema.format(dict(named.dtypes)["vec_id"])
    if n < 2:
        return spark.createDataFrame([], schema)
    total = F.lit([r.s for r in sums]) if len(sums) > 1 else F.array(F.lit(sums[0].s).cast("long"))
    apart = F.zip_with("x", total, lambda x, s: x * n - s)  # exact
    centred = F.transform(apart, lambda d: d / F.lit(float(n)))

    matrix = block_matrix(fit, centred, block_rows)
    covariance = scatter(matrix) / n
    values, vectors = eigenvectors(covariance, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = local_blocks(spark, vectors / np.sqrt(values))
    check = scatter(matrix.multiply(turn)) / n
    error = float(np.abs(check - np.eye(len(values))).max())
    projected = rows_of(block_matrix(every, centred, block_rows).multiply(turn))
    squares = F.aggregate(apart, F.lit(0).cast("long"), lambda a, d: a + d * d)
    return every.select("index", "vec_id", squares.alias("deviation")).join(projected, "index").select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.col("values").alias("whitened"),
        F.lit((values / np.trace(covariance)).tolist()).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"))
