"""Embedding near-duplicates through a pivot-permutation index.

Each distinct vector is described by its nearest reference points, the pivots, nearest first. The inverted lists are kept
by pairs of pivots, so a list holds vectors that share both, and a pair of vectors that meets in several lists is judged
in the one of its two smallest shared pivots. There their shared pivots are counted and the ranks compared that these
have for both: the sum of rank differences, where a pivot that only one of them has counts as one rank behind its last.
Pairs with enough shared pivots and a small enough difference are verified by cosine in double precision. The number of
pivots follows that of the vectors, so lists stay short.

A long list is cut into blocks, and each two of its blocks meet in a task of their own. A task gives for each vector
how many others it links to and one link towards the smallest vector of its part, and no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievo.llm.blobs import runs
from retrievo.llm.components import components
from retrievo.staging import stage

LEAST_PIVOTS, MOST_PIVOTS = 512, 4096  # reference points, thinned from a sample of eight times as many vectors
NEAREST = 6    # pivots that describe a vector
SHARED = 2     # pivots that candidates share
DIFFERENCE = 0.8  # largest sum of rank differences, as a share of that of vectors that share no pivot
APART = 0.7    # pivots have a lower cosine with each other
BLOCK = 2048   # vectors of a list that one task compares with another block
_CHUNK, _PAIRS = 512, 1 << 14
_FOUND = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def pivot_count(vectors: int) -> int:
    """Twice the root of the number of vectors, within bounds."""
    return int(np.clip(2 * np.sqrt(vectors), LEAST_PIVOTS, MOST_PIVOTS))


def rank_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of two tables of ordered pivots the sum of rank differences; missing pivots rank after the last."""
    width = a.shape[1]
    same = a[:, :, None] == b[:, None, :]
    rank = np.arange(width)
    shared = (same * np.abs(rank[:, None] - rank[None, :])).sum((1, 2))
    return shared + ((~same.any(2)) * (width - rank)).sum(1) + ((~same.any(1)) * (width - rank)).sum(1)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def choose_pivots(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` unit vectors of mutual cosine below ``APART`` from a sample, filled up with random directions."""
    kept = np.zeros((0, sample.shape[1]))
    for v in sample:
        if len(kept) < count and (len(kept) == 0 or (kept @ v).max() < APART):
            kept = np.vstack([kept, v])
    missing = np.random.default_rng(seed).normal(size=(count - len(kept), sample.shape[1]))
    return np.vstack([kept, _units(missing)]) if len(missing) else kept


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()] \
        .astype(np.float64).reshape(len(column), -1)


def _describe(sent, nearest, count):
    def run(batches):
        for batch in batches:
            widths = pa.compute.list_value_length(batch.column("vector")).to_numpy()
            for width in np.unique(widths):
                own = batch.filter(pa.array(widths == width))
                pivots = sent.value.get(int(width))
                if pivots is None:
                    pivots = choose_pivots(np.zeros((0, int(width))), count)
                close = _units(_matrix(own.column("vector"))) @ pivots.T
                near = np.argpartition(-close, min(nearest, close.shape[1] - 1), 1)[:, :nearest]
                order = np.argsort(-np.take_along_axis(close, near, 1), 1, kind="stable")
                near = np.take_along_axis(near, order, 1)  # nearest first
                yield pa.RecordBatch.from_arrays(
                    [own.column("node"), own.column("weight"), own.column("vector"),
                     pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))],
                    names=["node", "weight", "vector", "near"])
    return run


def _compare(threshold, shared, difference):
    def run(batches):
        for (_, first, second, left, right), rows in runs(batches, ("width", "first", "second", "left", "right")):
            n = rows.num_rows
            if n < 2:
                continue
            block, node = rows.column("block").to_numpy(), rows.column("node").to_numpy()
            a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
            units, weight = _units(_matrix(rows.column("vector"))), rows.column("weight").to_numpy()
            near = _matrix(rows.column("near"))
            earlier = np.unique(near[(near < second) & (near != first)])
            other = (near[:, :, None] == earlier).any(1).astype(np.float32)  # shared pivots that come before this list's
            linked = np.zeros((len(a), len(b)), bool)
            for at in range(0, len(a), _CHUNK):
                own = a[at:at + _CHUNK]
                i, j = np.nonzero(other[own] @ other[b].T == 0)
                for x in range(0, len(i), _PAIRS):
                    k, m = i[x:x + _PAIRS], j[x:x + _PAIRS]
                    p, q = near[own[k]], near[b[m]]
                    fits = (p[:, :, None] == q[:, None, :]).any(2).sum(1) >= shared
                    fits &= rank_differences(p, q) <= difference * near.shape[1] * (near.shape[1] + 1)
                    k, m = k[fits], m[fits]
                    close = np.einsum("ij,ij->i", units[own[k]], units[b[m]]) >= threshold
                    linked[at + k[close], m[close]] = True
            if left == right:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            count = np.zeros(n, np.int64)
            count[a] += linked @ weight[b]
            root = node.copy()
            while True:  # smallest node within reach, in this part
                low = root.copy()
                for at in range(0, len(a), _CHUNK):
                    own, part = a[at:at + _CHUNK], linked[at:at + _CHUNK]
                    far = np.where(part, root[b][None, :], np.iinfo(np.int64).max).min(1)
                    low[own] = np.minimum(low[own], far)
                    back = np.where(part, root[own][:, None], np.iinfo(np.int64).max).min(0)
                    low[b] = np.minimum(low[b], back)
                if (low == root).all():
                    break
                root = low
            if left != right:
                count[b] += weight[a] @ linked
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(x[met], pa.int64()) for x in (node, root, count)], schema=_FOUND)
    return run


def near_vectors(rows: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
                 pivots: int | None = None, nearest: int = NEAREST, block: int = BLOCK, shared: int = SHARED,
                 difference: float = DIFFERENCE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest ``vec_id`` in reach. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different lengths do
    not link. Equal vectors always link. Rows may repeat an id; rows without one count as links but name no component.
    Other columns are not read. ``pivots`` is by default that of ``pivot_count``. Pairs that share fewer than ``shared``
    (two or more) of their ``nearest`` pivots are missed, as are pairs whose ranks differ more than ``difference`` allows;
    found links are exact.
    """
    vector, x = F.col(embedding), lambda f: F.forall(embedding, f)
    usable = vector.isNotNull() & (F.size(embedding) > 0) & x(
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(embedding, lambda v: v != 0)
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"),
                        F.when(F.coalesce(usable, F.lit(False)), vector).alias("vector"))
    named = named.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    distinct = stage(named.where("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "distinct")

    pivots = pivots or pivot_count(distinct.count())
    sample = distinct.withColumn("width", F.size("vector")).orderBy("node").limit(8 * pivots) \
        .select("width", "vector").collect()  # nodes are hashes, so this is a random sample of fixed size
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(r.width, []).append(r.vector)
    sent = rows.sparkSession.sparkContext.broadcast(
        {w: choose_pivots(_units(np.array(v, np.float64)), pivots) for w, v in by_width.items()})

    kind = dict(distinct.dtypes)["vector"]
    described = stage(distinct.select("node", "weight", "vector").mapInArrow(
        _describe(sent, nearest, pivots), f"node long, weight long, vector {kind}, near array<int>"), "described")
    pairs = F.flatten(F.transform("near", lambda a: F.transform(F.filter("near", lambda b: b > a),
                                                                lambda b: F.struct(a.alias("first"), b.alias("second")))))
    listed = described.select("*", F.size("vector").alias("width"), F.explode(pairs).alias("pair")) \
        .select("width", "pair.*", "node", "weight", "vector", "near")
    keys = ["width", "first", "second"]
    long_ = stage(listed.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > block)
                  .select(*keys, F.ceil(F.col("rows") / block).alias("blocks")), "long-lists")
    blocks = F.coalesce("blocks", F.lit(1)).cast("int")
    dealt = listed.join(long_, keys, "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select(*keys, F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "block",
                "node", "weight", "vector", "near")
    parts = [*keys, "left", "right"]
    found = stage(dealt.repartition(*parts).sortWithinPartitions(*parts)
                  .mapInArrow(_compare(threshold, shared, difference), "node long, root long, links long"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = stage(distinct.select("node", "vec_id", "weight").join(links, "node", "left").join(group, "node", "left")
                    .select("node", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                            F.coalesce("component", "node").alias("component")), "classes")
    smallest = stage(classes.groupBy("component").agg(F.min("vec_id").alias("component_id")), "smallest")
    classes = stage(classes.join(smallest, "component").select("node", "n_links", "component_id"), "classes")
    component = F.coalesce("component_id", "vec_id")
    return named.select("vec_id", "node").join(classes, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
