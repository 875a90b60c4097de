"""Text embedding: a deterministic hashed term vector, and the once-per-distinct-text rule for any embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from retrievo.functions.text import bm25_tokenize, clean_text, let


def term_bucket(term: Column, dim: int) -> Column:
    """Bucket of a term: the first 32 bits of its MD5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hashed_embedding(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = 64,
                     every_text: bool = False) -> DataFrame:
    """Add the unit vector of log(1 + count) per hashed term; null for text without terms.

    The default embedder: like any other it takes a table and returns it with one more column. With ``every_text`` a text
    without terms is one term, and null is the empty text, so that each has a vector as a model would give.
    """
    terms = bm25_tokenize(F.col(text))
    if every_text:
        terms = let(terms, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.coalesce(F.col(text), F.lit("")))))
    hashed = df.withColumn("_buckets", F.transform(terms, lambda t: term_bucket(t, dim)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            n = len(lists)
            lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            cell = np.repeat(np.arange(n), lengths) * dim + np.asarray(lists.flatten(), dtype=np.int64)
            weights = np.log1p(np.bincount(cell, minlength=n * dim)).reshape(n, dim)
            size = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
            unit = np.divide(weights, size, out=np.zeros_like(weights), where=size > 0).astype(np.float32)
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()), mask=pa.array(lengths == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], out])

    return hashed.mapInArrow(weigh, schema)


def every_text_embedding(df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
    """``hashed_embedding`` that gives every text a vector."""
    return hashed_embedding(df, text, out, every_text=True)


def dedupe_embed(df: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame] = hashed_embedding,
                 text: str = "text", out: str = "embedding") -> DataFrame:
    """Embed each distinct text once and attach the vector to every row that holds the text.

    Rows meet their vector by the text's hash; null texts have the vector of null. The distinct side has one row per hash,
    so a text that fills a third of the table is split by the adaptive skew join.
    """
    keyed = df.withColumn("_key", F.sha2(F.col(text).cast("binary"), 256))
    once = embed(keyed.dropDuplicates(["_key"]).select("_key", F.col(text).alias("_text")), "_text", out)
    vectors = once.select(F.col("_key").alias("_once"), out)
    return keyed.join(vectors, F.col("_key").eqNullSafe(F.col("_once")), "left").drop("_key", "_once")


MODEL_BATCH = 18  # texts that a model is asked for at once
REASON_CHARS = 200
Model = Callable[[list[str]], list]


def _answers(model: Model, texts: list[str], attempts: int) -> tuple[list, list]:
    """A vector or None for each text, and why there is none. A batch that fails is halved down to single texts; a single
    text is tried ``attempts`` times."""
    for attempt in range(attempts if len(texts) == 1 else 1):
        try:
            vectors = list(model(texts))
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            kept = [None if v is None else np.asarray(v, np.float32) for v in vectors]
            usable = [v is not None and v.ndim == 1 and len(v) > 0 and bool(np.isfinite(v).all()) for v in kept]
            return ([v if ok else None for v, ok in zip(kept, usable)],
                    [None if ok else "no vector" if v is None else "unusable vector" for v, ok in zip(kept, usable)])
        except Exception as e:  # a model may fail in any way; the reason is kept with the text
            failed = f"{type(e).__name__}: {e}"[:REASON_CHARS]
    if len(texts) == 1:
        return [None], [failed]
    half = len(texts) // 2
    left, right = _answers(model, texts[:half], attempts), _answers(model, texts[half:], attempts)
    return left[0] + right[0], left[1] + right[1]


def model_embedding(df: DataFrame, connect: Callable[[], Model], text: str = "text", out: str = "embedding",
                    reason: str = "embed_error", batch_size: int = MODEL_BATCH, attempts: int = 2) -> DataFrame:
    """Add the vector that a model gives for each text, and null with a ``reason`` where it gives none.

    ``connect`` is called once in a task and returns the model: a function from a list of cleaned texts to a list of
    vectors. No row is lost: one text that fails costs its own vector only, as its batch is halved until it is alone. A
    batch that fails whole costs at most twice its number of calls. Null and blank texts are not sent. Vectors that are
    empty or not finite count as none. Columns with the result's names are replaced.
    """
    kept = [c for c in df.columns if c not in (out, reason)]
    rows = df.select(*kept, clean_text(F.col(text)).alias("_sent"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.ArrayType(T.FloatType())),
                           T.StructField(reason, T.StringType())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            sent = batch.column(batch.num_columns - 1).to_pylist()
            vectors, reasons = [None] * len(sent), ["text is blank"] * len(sent)
            full = [i for i, t in enumerate(sent) if t]
            for at in range(0, len(full), batch_size):
                part = full[at:at + batch_size]
                model = model or connect()
                for i, v, why in zip(part, *_answers(model, [sent[i] for i in part], attempts)):
                    vectors[i], reasons[i] = v, why
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float32())), pa.array(reasons, pa.string())],
                names=[*batch.schema.names[:-1], out, reason])

    return rows.mapInArrow(ask, schema)
