"""Rank fusion, hybrid search and the result cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from retrievo.functions.text import search_key
from retrievo.operators.lexical import Bm25Index, CorpusScan, bm25_over_candidates, bm25_search
from retrievo.operators.ordered import top_k
from retrievo.operators.vector import vector_search
from retrievo.staging import stage

RRF_K = 60
ROUTE_K = 20
CANDIDATE_POOL = 50
FUSED_DIGITS = 12


@dataclass(frozen=True)
class SearchOptions:
    """Values that are not positive fall back to the defaults."""

    top_k: int = 5
    threshold: float = 0.7
    hybrid: bool = True

    def resolved(self) -> SearchOptions:
        base = SearchOptions()
        return SearchOptions(self.top_k if self.top_k > 0 else base.top_k,
                             self.threshold if self.threshold > 0 else base.threshold, self.hybrid)


def rrf_fuse(vector_hits: DataFrame, bm25_hits: DataFrame, k: int = 5, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per question.

    Returns query_id, doc_id, rrf_score, vector_rank, bm25_rank, retrieval_source, rank.
    """
    none = F.lit(None).cast("int")
    lists = vector_hits.select("query_id", "doc_id", F.col("rank").alias("vector_rank"), none.alias("bm25_rank")) \
        .unionByName(bm25_hits.select("query_id", "doc_id", none.alias("vector_rank"),
                                      F.col("rank").alias("bm25_rank")))
    merged = lists.groupBy("query_id", "doc_id").agg(
        F.min("vector_rank").alias("vector_rank"), F.min("bm25_rank").alias("bm25_rank"))
    share = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = merged.withColumn("rrf_score", F.round(share("vector_rank") + share("bm25_rank"), FUSED_DIGITS)) \
        .withColumn("retrieval_source",
                    F.when(F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNotNull(), "both")
                    .when(F.col("vector_rank").isNotNull(), "vector_only").otherwise("bm25_only"))
    return top_k(scored, ["query_id"], [F.desc("rrf_score"), F.asc("doc_id")], k).select(
        "query_id", "doc_id", "rrf_score", "vector_rank", "bm25_rank", "retrieval_source", "rank")


def annotate_vector_only(hits: DataFrame, k: int) -> DataFrame:
    """The shape of a fused list for vector hits alone."""
    return (hits.filter(F.col("rank") <= k)
            .select("query_id", "doc_id", F.col("score").alias("rrf_score"), F.col("rank").alias("vector_rank"),
                    F.lit(None).cast("int").alias("bm25_rank"), F.lit("vector_only").alias("retrieval_source"), "rank"))


def hybrid_search(index: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(),
                  corpus: DataFrame | None = None, bm25: Bm25Index | CorpusScan | None = None,
                  candidates: DataFrame | None = None) -> DataFrame:
    """Vector and BM25 lists of 20 per question, fused to ``top_k``; vector hits alone with ``hybrid`` off.

    ``index``: doc_id, embedding. ``queries``: query_id, query, embedding. BM25 runs over ``corpus`` (doc_id, text) or
    a ready ``bm25`` index or ``CorpusScan``. Without either it ranks only the 50 best vector hits, whose text ``candidates`` holds.
    """
    opts = options.resolved()
    if not opts.hybrid:
        return annotate_vector_only(vector_search(index, queries, opts.top_k, opts.threshold), opts.top_k)
    if bm25 is not None or corpus is not None:
        vector_hits = vector_search(index, queries, ROUTE_K, opts.threshold)
        scan = bm25 if isinstance(bm25, CorpusScan) else CorpusScan(corpus) if bm25 is None else None
        lexical_hits = scan.top(queries, ROUTE_K) if scan else bm25_search(bm25, queries, ROUTE_K)
    elif candidates is not None:
        pool = stage(vector_search(index, queries, CANDIDATE_POOL, opts.threshold), "pool")
        vector_hits = pool.filter(F.col("rank") <= ROUTE_K)
        texts = pool.select("query_id", "doc_id").join(candidates.select("doc_id", "text"), "doc_id")
        lexical_hits = bm25_over_candidates(texts, queries, ROUTE_K)
    else:
        raise ValueError("hybrid search needs a corpus, a BM25 index or candidate texts")
    return rrf_fuse(vector_hits, lexical_hits, opts.top_k)


def with_search_key(log: DataFrame) -> DataFrame:
    return log.withColumn("cache_key", search_key(F.col("query"), F.col("top_k"), F.col("threshold"), F.col("hybrid")))


def cache_accounting(log: DataFrame, stored: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Hit or miss of each search in a log (request_id, ts, cache_key).

    A miss stores its result for ``ttl_seconds`` from then on, hits do not renew it, and keys in ``stored`` are those
    with a non-empty result. An empty result is never stored, so such keys always miss.

    Requests of one key are first counted per second. Within a TTL span only the first second can miss, so the chain
    of misses of a key is walked over its seconds and every later request of the span is a hit.
    """
    known = log.join(stored.select("cache_key").distinct().withColumn("_kept", F.lit(True)), "cache_key", "left")
    seconds = (known.filter("_kept").groupBy("cache_key", F.unix_timestamp("ts").alias("_s"))
               .agg(F.min(F.struct("ts", "request_id")).alias("_first")))
    starts = _span_starts(seconds, ttl_seconds)
    return (known.withColumn("_s", F.unix_timestamp("ts"))
            .join(starts, ["cache_key", "_s"], "left")
            .withColumn("hit", F.col("_kept").isNotNull()
                        & (F.col("_first").isNull() | (F.col("_first.request_id") != F.col("request_id"))))
            .select("request_id", "ts", "cache_key", "hit"))


def _span_starts(seconds: DataFrame, ttl_seconds: int) -> DataFrame:
    """The seconds at which a key's TTL span starts: the first one, then the first at or after each expiry."""
    import pyarrow as pa

    def walk(batches):
        current, until = None, None
        for batch in batches:
            keys, secs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (key, sec) in enumerate(zip(keys, secs)):
                if key != current or sec >= until:
                    current, until = key, sec + ttl_seconds
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    ordered = seconds.select("cache_key", "_s", "_first").repartition("cache_key").sortWithinPartitions(
        "cache_key", "_s")
    return ordered.mapInArrow(walk, ordered.schema)
