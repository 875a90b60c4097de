"""Retrieval quality: per-case metrics, reports, comparisons and dataset checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from retrievo.functions.text import is_blank, normalize, strip
from retrievo.operators import fusion
from retrievo.operators.ordered import exact_quantiles
from retrievo.sources.readers import DEFAULT_CATEGORY
from retrievo.staging import stage

DEFAULT_K = 5
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def sanitize_ks(ks: Sequence[int | None] | None, default: int = DEFAULT_K) -> list[int]:
    """Positive cut-offs, distinct in order; the default where none is left."""
    kept = list(dict.fromkeys(k for k in ks or [] if k is not None and k > 0))
    return kept or [default]


def normalize_qrels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trimmed cases with distinct ids and a category; rejects are cases with a blank question or without ids."""
    ids = F.array_distinct(F.filter(F.transform(
        F.coalesce("relevant_ids", F.array().cast("array<string>")), strip), lambda x: ~is_blank(x)))
    rest = [c for c in df.columns if c not in ("question", "relevant_ids", "category")]
    rows = df.select(
        *rest, strip(F.col("question")).alias("question"), ids.alias("relevant_ids"),
        F.when(is_blank(F.col("category")), DEFAULT_CATEGORY).otherwise(strip(F.col("category"))).alias("category"))
    reason = F.when(is_blank(F.col("question")), "blank question").when(F.size("relevant_ids") == 0, "no relevant ids")
    judged = rows.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def per_case(hits: DataFrame, cases: DataFrame, ks: Sequence[int], relevant: DataFrame | None = None) -> DataFrame:
    """query_id, category, k, found, recall, precision, result_count; cases without results stay.

    ``hits``: query_id, doc_id, rank from one retrieval at the largest k. ``cases``: query_id, category, and either
    relevant_ids or a table ``relevant`` of distinct (query_id, doc_id), which has no bound on the ids of a case.
    Precision divides by k, not by the number of results.
    """
    ks = sanitize_ks(ks)
    if relevant is None:
        relevant = cases.select("query_id", F.explode(F.array_distinct("relevant_ids")).alias("doc_id"))
        sized = cases.select("query_id", "category", F.size(F.array_distinct("relevant_ids")).alias("_rel"))
    else:
        counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("_rel"))
        sized = cases.select("query_id", "category").join(counts, "query_id", "left").withColumn(
            "_rel", F.coalesce("_rel", F.lit(0)))
    within = lambda c, k: F.count(F.when(F.col(c) <= k, 1))
    best = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    joined = best.join(relevant.select("query_id", "doc_id", F.lit(1).alias("_r")), ["query_id", "doc_id"], "left").withColumn(
        "_found", F.when(F.col("_r") == 1, F.col("rank")))
    counted = joined.groupBy("query_id").agg(
        *[within("_found", k).alias(f"_f{k}") for k in ks], *[within("rank", k).alias(f"_n{k}") for k in ks])
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"_f{k}"), F.lit(0)).alias("found"),
                                F.coalesce(F.col(f"_n{k}"), F.lit(0)).alias("result_count")) for k in ks])
    return (sized.join(counted, "query_id", "left")
            .select("query_id", "category", "_rel", F.explode(levels).alias("_l"))
            .select("query_id", "category", "_l.k", "_l.found",
                    F.when(F.col("_rel") > 0, F.col("_l.found") / F.col("_rel")).otherwise(0.0).alias("recall"),
                    (F.col("_l.found") / F.col("_l.k")).alias("precision"), "_l.result_count"))


def f1(recall: Column, precision: Column) -> Column:
    return F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)


def summarize(cases: DataFrame, by: str = "category", keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per k over all cases (``by`` null) and per value of ``by``; F1 is that of the mean values."""
    keys = [*keys, "k"]
    empty = F.count(F.when(F.col("result_count") == 0, 1))
    n = F.count(F.lit(1))
    out = cases.groupingSets([keys, [*keys, by]], *keys, by).agg(
        n.alias("sample_count"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"),
        empty.alias("empty_count"), F.when(F.grouping(by) == 1, "overall").otherwise("category").alias("scope"))
    return out.withColumn("f1", f1(F.col("recall"), F.col("precision"))).withColumn(
        "empty_rate", F.col("empty_count") / F.col("sample_count")).withColumn(
        "hit_rate", 1 - F.col("empty_rate"))


def latency_summary(df: DataFrame, keys: Sequence[str], value: str = "latency_ms", width: float = 1.0) -> DataFrame:
    """Mean and nearest-rank percentiles per key."""
    keys = list(keys)
    means = df.groupBy(*keys).agg(F.avg(value).alias("avg_latency"))
    return exact_quantiles(df, keys, value, PERCENTILES, "nearest", width).join(means, keys)


@dataclass(frozen=True)
class Profile:
    """A named retrieval setting; missing values take the defaults."""

    name: str | None = None
    threshold: float | None = None
    hybrid: bool | None = None

    def resolved(self) -> Profile:
        base = fusion.SearchOptions()
        threshold = self.threshold if self.threshold is not None and self.threshold > 0 else base.threshold
        hybrid = base.hybrid if self.hybrid is None else self.hybrid
        name = self.name if self.name and self.name.strip() else \
            f"threshold={threshold:.2f},hybrid={str(hybrid).lower()}"
        return Profile(name, threshold, hybrid)


def compare_profiles(cases: DataFrame, profiles: Sequence[Profile], ks: Sequence[int], vector_hits: DataFrame,
                     bm25_hits: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """One report per profile from one run of each retrieval route.

    ``vector_hits`` is ranked without a threshold to the larger of 20 and the largest k: a threshold only cuts the tail
    of a ranked list, so every profile's list is a prefix of it.
    """
    ks = sanitize_ks(ks)
    own = [p.resolved() for p in profiles] or [Profile().resolved()]
    table = F.array(*[F.struct(F.lit(p.name).alias("name"), F.lit(float(p.threshold)).alias("threshold"),
                               F.lit(p.hybrid).alias("hybrid")) for p in own])

    def each(df: DataFrame) -> DataFrame:
        """The rows for each profile, whose name is part of the question from here on."""
        return df.withColumn("_p", F.explode(table)).withColumn("query_id", F.struct("_p.name", "query_id"))

    near = stage(each(vector_hits).filter("score >= _p.threshold"), "vector_hits")
    fused = fusion.rrf_fuse(near.filter(F.col("_p.hybrid") & (F.col("rank") <= fusion.ROUTE_K)),
                            each(bm25_hits).filter("_p.hybrid"), max(ks))
    alone = near.filter(~F.col("_p.hybrid") & (F.col("rank") <= max(ks)))
    hits = fused.select("query_id", "doc_id", "rank").unionByName(alone.select("query_id", "doc_id", "rank"))
    rows = per_case(hits, each(cases), ks, None if relevant is None else each(relevant))
    return summarize(rows.withColumn("profile", F.col("query_id.name")), keys=["profile"])


def metric_rows(report: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A report as long rows: keys, metric, value."""
    return report.select(*keys, *[F.col(m).cast("double") for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "value")


def metric_deltas(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """candidate - baseline for each metric that both long reports hold a number for."""
    on = [*keys, "metric"]
    return (baseline.filter(F.col("value").isNotNull()).withColumnRenamed("value", "baseline")
            .join(candidate.filter(F.col("value").isNotNull()).withColumnRenamed("value", "candidate"), on)
            .withColumn("delta", F.col("candidate") - F.col("baseline")))


def comparison_warnings(baseline: dict, candidate: dict) -> list[str]:
    """What makes two reports incomparable: dataset source, dataset size or cut-offs."""
    return [f"{name} differs" for name in ("datasetSource", "datasetSize", "topKs")
            if baseline.get(name) != candidate.get(name)]


def validate_qrels(df: DataFrame, kind: str = "sample", min_cases: int = 1, min_categories: int = 1,
                   require_category: bool = False) -> DataFrame:
    """Checks of a dataset (question, relevant_ids, category) as rows: section, name, value.

    Sections: ``summary``, ``category`` (cases per category), ``error`` and ``warning`` (with their counts).
    """
    strict = require_category or kind == "independent-human-labeled"
    no_category = is_blank(F.col("category"))
    ids = F.coalesce("relevant_ids", F.array().cast("array<string>"))
    rows = df.select(
        F.when(no_category, DEFAULT_CATEGORY).otherwise(strip(F.col("category"))).alias("category"),
        F.when(~is_blank(F.col("question")), F.lower(normalize(F.col("question")))).alias("_key"),
        is_blank(F.col("question")).cast("long").alias("_blank"), (F.size(ids) == 0).cast("long").alias("_noid"),
        (F.size(F.array_distinct(ids)) != F.size(ids)).cast("long").alias("_dupid"),
        no_category.cast("long").alias("_nocat"))
    per_category = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("_blank", "_noid", "_dupid", "_nocat")])
    repeats = rows.filter(F.col("_key").isNotNull()).groupBy("_key").agg((F.count(F.lit(1)) - 1).alias("r")) \
        .agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    totals = per_category.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.count(F.lit(1)).alias("categories"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_blank", "_noid", "_dupid", "_nocat")]) \
        .withColumn("repeats", repeats.select("r").scalar())
    entry = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"),
                                                  value.cast("long").alias("value"))
    short = (F.col("cases") < min_cases).cast("long")
    narrow = (F.col("categories") < min_categories).cast("long")
    unlabelled = F.col("_nocat") if strict else F.lit(0)
    errors = [entry("error", "too few cases", short), entry("error", "too few categories", narrow),
              entry("error", "blank question", F.col("_blank")), entry("error", "no relevant ids", F.col("_noid")),
              entry("error", "category required", unlabelled)]
    warnings = [entry("warning", "duplicate questions", F.col("repeats")),
                entry("warning", "duplicate ids within case", F.col("_dupid")),
                entry("warning", "relevant ids are not checked against the index", F.lit(1)),
                entry("warning", "diagnostic data", F.lit(int(kind in ("sample", "smoke")))),
                entry("warning", "annotation quality is not checked", F.lit(int(kind == "independent-human-labeled")))]
    failed = short + narrow + F.col("_blank") + F.col("_noid") + unlabelled
    summary = [entry("summary", "cases", F.col("cases")), entry("summary", "categories", F.col("categories")),
               entry("summary", "passed", (failed == 0).cast("long"))]
    report = totals.select(F.explode(F.array(*errors, *warnings, *summary)).alias("_e")).select("_e.*").filter(
        (F.col("value") > 0) | (F.col("section") == "summary"))
    return report.unionByName(per_category.select(
        F.lit("category").alias("section"), F.col("category").alias("name"), F.col("n").alias("value")))


def evidence_status(rounds: Column, chunks: Column) -> Column:
    return F.when(rounds == 0, "not_requested").when(chunks > 0, "available").otherwise("empty")


def replay_summary(records: DataFrame, rag: bool = True) -> DataFrame:
    """One row: replayed, successful and failed records, those with and without evidence, and whether the replay can
    serve as a baseline, which takes at least one record with evidence unless retrieval was off."""
    ok = F.col("status") == "ok"
    evidence = evidence_status(F.col("retrieval_rounds"), F.col("chunk_count"))
    n = lambda cond: F.count(F.when(cond, 1))
    out = records.agg(F.count(F.lit(1)).alias("query_count"), n(ok).alias("success_count"), n(~ok).alias("failure_count"),
                      n(ok & (evidence == "available")).alias("evidence_ready_count"),
                      n(ok & (evidence == "empty")).alias("empty_evidence_count"))
    return out.withColumn("benchmark_ready", F.lit(not rag) | (F.col("evidence_ready_count") > 0))


def replay_distributions(records: DataFrame) -> DataFrame:
    """Counts per value of route type, end reason, verification level and evidence status of successful records."""
    fields = ["route_type", "end_reason", "verification_level", "evidence_status"]
    ok = records.filter("status = 'ok'").withColumn(
        "evidence_status", evidence_status(F.col("retrieval_rounds"), F.col("chunk_count")))
    return (ok.select(*[F.when(is_blank(F.col(f)), "unknown").otherwise(F.col(f)).alias(f) for f in fields])
            .unpivot([], fields, "field", "name").groupBy("field", "name").agg(F.count(F.lit(1)).alias("n")))


def replay_numbers(records: DataFrame, width: float = 1.0) -> DataFrame:
    """Count, mean and interpolated percentiles of latency (all records) and of confidence, rounds and chunks."""
    ok = lambda c: F.when(F.col("status") == "ok", F.col(c).cast("double"))
    long = records.select(
        F.col("latency_ms").cast("double").alias("latency_ms"), ok("decision_confidence").alias("decision_confidence"),
        ok("retrieval_rounds").alias("retrieval_rounds"), ok("chunk_count").alias("chunk_count")).unpivot(
        [], ["latency_ms", "decision_confidence", "retrieval_rounds", "chunk_count"], "measure", "v").filter(
        F.col("v").isNotNull())
    stats = exact_quantiles(long, ["measure"], "v", PERCENTILES, "linear", width)
    means = long.groupBy("measure").agg(F.avg("v").alias("average"))
    return stats.join(means, "measure").select(
        "measure", "n", *[F.bround(c, 2).alias(c) for c in ("average", *PERCENTILES)])


def load_summary(samples: DataFrame, width: float = 1.0) -> DataFrame:
    """One row over load samples (time_stamp ms, elapsed ms, success, response_code)."""
    marks = samples.agg(
        F.count(F.lit(1)).alias("sample_count"), F.count(F.when(F.col("success"), 1)).alias("success_count"),
        F.avg("elapsed").alias("_mean"), F.min("time_stamp").alias("_from"), F.max("time_stamp").alias("_to"))
    quantiles = exact_quantiles(samples, [], "elapsed", PERCENTILES, "nearest", width)
    span = F.when(F.col("sample_count") > 1,
                  F.greatest(F.lit(0.001), (F.col("_to") - F.col("_from")) / 1000.0))
    out = marks.withColumn("_q", quantiles.select(F.struct(*PERCENTILES)).scalar())
    return out.select(
        "sample_count", "success_count", (F.col("sample_count") - F.col("success_count")).alias("error_count"),
        F.bround((F.col("sample_count") - F.col("success_count")) / F.col("sample_count"), 4).alias("error_rate"),
        F.bround("_mean", 2).alias("mean_elapsed_ms"), *[F.bround(f"_q.{p}", 2).alias(f"{p}_elapsed_ms") for p in PERCENTILES],
        F.bround(span, 3).alias("sample_duration_seconds"),
        F.bround(F.col("sample_count") / span, 2).alias("throughput_rps"))


def response_codes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("response_code").agg(F.count(F.lit(1)).alias("n"))


def redact(report: DataFrame) -> DataFrame:
    """Keep the file name of the dataset source only and hide the dataset in the summary."""
    return report.withColumn("dataset_source", F.regexp_extract("dataset_source", r"([^/\\]*)$", 1)).withColumn(
        "summary", F.regexp_replace("summary", r"(?i)dataset=.*?, size=", "dataset=<private>, size="))
