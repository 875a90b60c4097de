"""BM25 over a batch of questions.

``bm25_scan`` reads the texts once, stages which question terms each document holds, and takes the statistics and the
scores from that; only counts per term and the best rows of each task are shuffled. It serves question batches whose
terms fit a bounded broadcast.

``bm25_search`` works on a stored index of postings with joins and sets no bound on the questions. Each document also
has one posting with the empty term, so the document count and the mean length come from the pass that builds the
postings. It scores exactly but does not build every (question, document) pair. Common words alone cannot lift a
document into the top ``k``: once ``k`` documents reach some score from the rarer words, documents that hold only words
whose largest possible sum stays below that score are left out before the scores are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from retrievo.functions.text import bm25_tokenize
from retrievo.operators.blocks import SCORE_DIGITS, LocalTopK, hits_ddl, id_array
from retrievo.operators.ordered import top_k
from retrievo.sources.index import index_exists
from retrievo.staging import stage

K1 = 1.2
B = 0.75
DOCUMENT_ROW = ""
# question terms a scan broadcasts at most; larger batches go through an index
SCAN_TERMS = 1_000_000
# scores one task holds at a time
SCORE_CELLS = 4_000_000


@dataclass(frozen=True)
class Bm25Index:
    """``postings``: doc_id, dl, term, tf; the empty term marks one row per document."""

    postings: DataFrame

    def stats(self) -> DataFrame:
        """One row: document count and mean length in tokens."""
        return (self.postings.filter(F.col("term") == DOCUMENT_ROW)
                .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl")))

    def document_frequencies(self) -> DataFrame:
        return (self.postings.filter(F.col("term") != DOCUMENT_ROW)
                .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """Distinct tokens per question with their multiplicity ``qtf``."""
    return (queries.select(F.col(query_id).alias("query_id"), F.explode(bm25_tokenize(F.col(text))).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings of the corpus, or only those of the terms in ``vocabulary``. A document is one row."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), bm25_tokenize(F.col(text)).alias("_tokens"))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    terms = tokens.mapInArrow(_count_terms, f"doc_id {kind}, dl long, term string, tf long")
    return terms if vocabulary is None else terms.join(_wanted(vocabulary), "term", "left_semi")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each document from its own row, and the posting with the empty term; nothing is shuffled."""
    for batch in batches:
        lists = batch.column(1)
        lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(batch.num_rows), lengths)
        size = max(1, len(coded.dictionary))
        pair, tf = np.unique(row * size + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
        every = np.arange(batch.num_rows)
        row = np.concatenate([pair // size, every])
        words = pa.concat_arrays([coded.dictionary.cast(pa.string()).take(pa.array(pair % size)),
                                  pa.array([DOCUMENT_ROW] * batch.num_rows, pa.string())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(lengths[row]), words,
             pa.array(np.concatenate([tf, np.ones(batch.num_rows, np.int64)]))], names=["doc_id", "dl", "term", "tf"])


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df straight from the corpus: each document counts its distinct terms, so only counts are shuffled."""
    return (docs.select(F.explode(F.array_distinct(bm25_tokenize(F.col(text)))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def _wanted(vocabulary: DataFrame) -> DataFrame:
    """The distinct terms and the document row, as a table of known size."""
    one = vocabulary.sparkSession.range(1).select(F.lit(DOCUMENT_ROW).alias("term"))
    return stage(vocabulary.select("term").distinct().unionByName(one), "vocabulary")


def bm25_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               vocabulary: DataFrame | None = None) -> Bm25Index:
    """Build the postings once and stage them for the searches that follow."""
    return Bm25Index(stage(postings(docs, doc_id, text, vocabulary), "postings"))


def write_index(index: Bm25Index, path: str, partitions: int) -> None:
    """Store an index in ranges of (term, document): a search reads only the files whose term range it needs, and a
    term that occurs in most documents is spread over many files."""
    (index.postings.repartitionByRange(partitions, "term", "doc_id")
     .sortWithinPartitions("term", "doc_id")
     .withColumn("built_at", F.current_timestamp())
     .write.mode("overwrite").parquet(path))


def read_index(spark, path: str, max_age: str | None = None) -> Bm25Index | None:
    """A stored index, or None when it is older than ``max_age`` (such as ``"5 minutes"``)."""
    table = spark.read.parquet(path)
    if max_age is not None:
        fresh = table.agg((F.max("built_at") >= F.current_timestamp() - F.expr(f"interval {max_age}")).alias("f"))
        if not fresh.first()["f"]:
            return None
    return Bm25Index(table.drop("built_at"))


def fresh_index(docs: DataFrame, path: str, max_age: str, partitions: int) -> Bm25Index:
    """The stored index of ``docs``, built anew where there is none yet or it is older than ``max_age``."""
    spark = docs.sparkSession
    index = read_index(spark, path, max_age) if index_exists(spark, path) else None
    if index is None:
        write_index(Bm25Index(postings(docs)), path, partitions)
        index = read_index(spark, path)
    return index


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avg_dl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    exact = scores.withColumn("score", F.round("score", SCORE_DIGITS)).filter(F.col("score") > 0)
    return top_k(exact, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def _salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Equi-join that spreads each key of ``left`` over ``salts`` tasks by document."""
    if salts <= 1:
        return left.join(right, keys)
    spread = left.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def bm25_search(index: Bm25Index, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B,
                query_id: str = "query_id", text: str = "query", prune_pairs: int = 200_000_000,
                seed_rows: int = 10_000, salts: int = 1) -> DataFrame:
    """Top ``k`` documents per question: query_id, doc_id, score, rank.

    Repeated question tokens count once each; only positive scores are returned; equal scores are ordered by document.
    Pruning gives the same result from fewer summed pairs but takes more jobs, so it starts where the postings of all
    question terms exceed ``prune_pairs``. ``salts`` spreads a common term over several tasks where the question terms
    are too many to broadcast.
    """
    qt = stage(query_terms(queries, query_id, text), "query_terms")
    stats = index.stats().select(F.struct("n_docs", "avg_dl")).scalar()
    n_docs, avg_dl = stats["n_docs"], stats["avg_dl"]
    impacts = (index.postings.join(qt.select("term").distinct(), "term", "left_semi")
               .select("doc_id", "term", saturation(F.col("tf"), F.col("dl"), avg_dl, k1, b).alias("sat")))
    terms = impacts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("sat").alias("max_sat"))
    weights = (qt.join(terms, "term")
               .withColumn("weight", F.col("qtf") * idf(n_docs, F.col("df")))
               .withColumn("bound", F.col("weight") * F.col("max_sat"))
               .select("query_id", "term", "df", "weight", "bound"))
    weights = stage(weights, "weights")
    if (weights.agg(F.sum("df")).first()[0] or 0) <= prune_pairs:
        return _ranked(_sum_scores(impacts, weights, salts), k)
    impacts = stage(impacts, "impacts")

    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = (weights.withColumn("_before", F.coalesce(F.sum("df").over(rarest), F.lit(0)))
             .filter((F.col("_before") == 0) | (F.col("_before") + F.col("df") <= seed_rows)))
    reached = top_k(_sum_scores(impacts, seeds, salts), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    floor = (reached.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_min"))
             .select("query_id", F.when(F.col("_n") >= k, F.col("_min") - 1e-6).otherwise(F.lit(0.0)).alias("floor")))

    weakest = Window.partitionBy("query_id").orderBy("bound", "term")
    split = stage(weights.join(floor, "query_id", "left")
                  .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
                  .withColumn("_upto", F.sum("bound").over(weakest.rowsBetween(Window.unboundedPreceding, 0)))
                  .withColumn("needed", F.col("_upto") >= F.col("floor") / 2)
                  .withColumn("rest", F.sum(F.when(~F.col("needed"), F.col("bound")).otherwise(0.0))
                              .over(Window.partitionBy("query_id")))
                  .drop("_upto"), "term_split")
    needed, spare = split.filter("needed"), split.filter("NOT needed")
    limits = split.groupBy("query_id").agg(F.max("floor").alias("floor"), F.max("rest").alias("rest"))
    partial = (_sum_scores(impacts, needed, salts).join(limits, "query_id")
               .filter(F.col("score") + F.col("rest") >= F.col("floor"))
               .select("query_id", "doc_id", "score"))
    partial = stage(partial, "candidates")
    extra = (partial.select("query_id", "doc_id").join(spare.select("query_id", "term", "weight"), "query_id")
             .join(impacts, ["doc_id", "term"])
             .select("query_id", "doc_id", (F.col("weight") * F.col("sat")).alias("score")))
    total = partial.unionByName(extra).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return _ranked(total, k)


def _sum_scores(impacts: DataFrame, weights: DataFrame, salts: int) -> DataFrame:
    return (_salted(impacts, weights.select("query_id", "term", "weight"), ["term"], salts)
            .groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("weight") * F.col("sat")).alias("score")))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """Top ``k`` over a corpus (doc_id, text): a scan, or an index of the question terms for very large batches."""
    return CorpusScan(docs).top(queries, k, k1, b)


def bm25_scan(docs: DataFrame, qt: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """Top ``k`` for the question terms ``qt`` (query_id, term, qtf), at most ``SCAN_TERMS`` rows of them."""
    return CorpusScan(docs).scan(qt, k, k1, b)


class CorpusScan:
    """Searches of one corpus (doc_id, text), whose texts are cut into tokens once for all batches of questions.

    That pass stages a row for each document: its length, and which of the question terms it holds how often. A later
    batch reads only this table as long as it asks for the same terms or fewer; others take a new pass.
    """

    def __init__(self, docs: DataFrame):
        self.docs, self.terms, self.held = docs, None, None

    def top(self, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
        qt = stage(query_terms(queries), "query_terms")
        if qt.count() <= SCAN_TERMS:
            return self.scan(qt, k, k1, b)
        return bm25_search(bm25_index(self.docs, vocabulary=qt), queries, k, k1, b)

    def _find(self, asked: pa.Array) -> None:
        if self.terms is not None and pc.all(pc.is_in(asked, value_set=self.terms)).as_py() is not False:
            return
        self.terms = pc.unique(asked)
        shared = self.docs.sparkSession.sparkContext.broadcast(self.terms)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = shared.value
            n_terms = max(1, len(terms))
            for batch in batches:
                lists = batch.column(1)
                lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
                term = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1), dtype=np.int64)
                row = np.repeat(np.arange(batch.num_rows), lengths)
                pair, tf = np.unique((row * n_terms + term)[term >= 0], return_counts=True)
                upto = pa.array(np.searchsorted(pair // n_terms, np.arange(batch.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(lengths), *[pa.ListArray.from_arrays(upto, pa.array(c, pa.int32()))
                                                           for c in (pair % n_terms, tf)]], names=["doc_id", "dl", "terms", "tfs"])

        tokens = self.docs.select("doc_id", bm25_tokenize(F.col("text")).alias("tokens"))
        kind = dict(self.docs.dtypes)["doc_id"]
        self.held = stage(tokens.mapInArrow(find, f"doc_id {kind}, dl long, terms array<int>, tfs array<int>"), "matches")

    def scan(self, qt: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """Top ``k`` for the question terms ``qt`` (query_id, term, qtf), at most ``SCAN_TERMS`` rows of them."""
        docs, ddl = self.docs, hits_ddl(qt, self.docs)
        query_type, doc_type = dict(qt.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
        asked = qt.toArrow()  # bounded by SCAN_TERMS
        term = asked["term"].combine_chunks()
        self._find(term)
        total = self.held.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).first()
        if not total["n"]:
            return docs.sparkSession.createDataFrame([], ddl + ", rank int")
        n_docs, avg_dl, df = total["n"], total["dl"] / total["n"], np.zeros(len(self.terms), np.int64)
        counts = self.held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row per term
        df[counts["term"].to_numpy()] = counts["count"].to_numpy()
        place = np.asarray(pc.index_in(term, value_set=self.terms), dtype=np.int64)
        order = np.argsort(place, kind="stable")
        order = order[df[place[order]] > 0]
        query_ids, query = np.unique(id_array(asked["query_id"].combine_chunks())[order], return_inverse=True)
        rarity = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        weight = asked["qtf"].to_numpy()[order] * rarity[place[order]]
        first = np.searchsorted(place[order], np.arange(len(df) + 1))
        shared = docs.sparkSession.sparkContext.broadcast((first, query, weight, query_ids))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, query, weight, query_ids = shared.value
            n_queries = len(query_ids)
            best = LocalTopK(n_queries, k, 10.0 ** -SCORE_DIGITS)
            step = max(1, SCORE_CELLS // max(1, n_queries))
            for batch in batches:
                ids, lengths = id_array(batch.column(0)), batch.column(1).to_numpy()
                row = np.repeat(np.arange(len(ids)), np.asarray(batch.column(2).value_lengths(), dtype=np.int64))
                term, tf = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in (2, 3))
                sat = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / avg_dl))
                for start in range(0, len(ids), step):
                    lo, hi = np.searchsorted(row, [start, start + step])
                    size = min(step, len(ids) - start)
                    per = first[term[lo:hi] + 1] - first[term[lo:hi]]
                    offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                    entry = np.repeat(first[term[lo:hi]], per) + offset
                    cell = np.repeat(row[lo:hi] - start, per) * n_queries + query[entry]
                    scores = np.bincount(cell, weights=np.repeat(sat[lo:hi], per) * weight[entry],
                                         minlength=size * n_queries)
                    best.add(ids[start:start + size], scores.reshape(size, n_queries))
            yield best.hits(query_ids, query_type, doc_type)

        return top_k(self.held.mapInArrow(score, ddl), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def bm25_over_candidates(candidates: DataFrame, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B,
                         query_id: str = "query_id", text: str = "query") -> DataFrame:
    """BM25 whose statistics come from each question's own candidates (query_id, doc_id, text)."""
    asked = query_terms(queries, query_id, text).groupBy("query_id").agg(
        F.collect_list(F.struct("term", "qtf")).alias("_asked"))  # the terms of one question
    # everything below stays in the partition of its question: one pass over each pool
    pool = Window.partitionBy("query_id")
    sized = (candidates.select("query_id", "doc_id", bm25_tokenize(F.col("text")).alias("_tokens"))
             .withColumn("dl", F.size("_tokens").cast("long"))
             .withColumns({"n_docs": F.count(F.lit(1)).over(pool), "avg_dl": F.avg("dl").over(pool)}))
    found = (sized.join(asked, "query_id").select("*", F.explode("_asked").alias("_a"))
             .select("query_id", "doc_id", "dl", "n_docs", "avg_dl", "_a.term", "_a.qtf",
                     F.size(F.filter("_tokens", lambda t: t == F.col("_a.term"))).alias("tf"))
             .filter("tf > 0").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "term"))))
    scores = found.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("qtf") * idf(F.col("n_docs"), F.col("df"))
              * saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"), k1, b)).alias("score"))
    return _ranked(scores, k)
