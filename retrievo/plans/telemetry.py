"""Queries over metric events. Events are sparse, about 14 an hour, so windows and limits are wider than the defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.operators import sketches, telemetry as m
from retrievo.plans.registry import register, table
from retrievo.staging import new_stage_path


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@register("counter_rollup", """
SELECT event_type, user_id, count(*) AS total FROM events GROUP BY ALL""")
def counter_rollup(spark, sf_dir):
    return m.counter_rollup(events(spark, sf_dir), ["event_type", "user_id"])


_RANK = lambda p: f"min(v) FILTER (rn >= greatest(ceil({p}::DOUBLE * n), 1))"


@register("timer_percentiles", f"""
WITH r AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT event_type, greatest(value - 10, 0) AS v FROM events))
SELECT event_type, count(*) AS n, {_RANK(0.50)} AS p50, {_RANK(0.95)} AS p95, {_RANK(0.99)} AS p99,
  round(sum(v), 4) AS total, max(v) AS max FROM r GROUP BY event_type""")
def timer_percentiles(spark, sf_dir):
    shifted = events(spark, sf_dir).withColumn("value", F.col("value") - 10)
    return m.timer_percentiles(shifted, ["event_type"]).withColumn("total", F.round("total", 4))


BOUNDS = (10.0, 50.0, 200.0)
_BUCKETS = """
b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative
  FROM events, (SELECT unnest([10.0, 50.0, 200.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL)"""


@register("slo_buckets", f"WITH {_BUCKETS} SELECT event_type, le, cumulative FROM b")
def slo_buckets(spark, sf_dir):
    return m.slo_buckets(events(spark, sf_dir), ["event_type"], bounds=BOUNDS)


_SLIDE = """
p AS (SELECT event_type, value, time_bucket(INTERVAL {slide}, ts) + to_seconds({step} * (1 + k)) AS "at"
  FROM events, (SELECT unnest(range({n})) AS k))"""


def _slide(slide, step, n):
    return _SLIDE.format(slide=slide, step=step, n=n)


@register("rate_5m", f"""
WITH {_slide("'1 minute'", 60, 5)} SELECT "at", event_type, round(count(*) / 300.0, 9)::DOUBLE AS rate FROM p GROUP BY ALL""")
def rate_5m(spark, sf_dir):
    return _ntz(m.rate(events(spark, sf_dir), ["event_type"]), "at").withColumn("rate", F.round("rate", 9))


@register("histogram_p95", f"""
WITH {_BUCKETS}, s AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cumulative) OVER w, 0) AS below,
  0.95::DOUBLE * max(cumulative) OVER (PARTITION BY event_type) AS rank FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(arg_min(CASE WHEN le = 'inf'::DOUBLE THEN lo
  ELSE lo + (le - lo) * (rank - below) / (cumulative - below) END, le), 6) AS quantile
FROM s WHERE cumulative >= rank GROUP BY event_type""")
def histogram_p95(spark, sf_dir):
    buckets = m.slo_buckets(events(spark, sf_dir), ["event_type"], bounds=BOUNDS)
    return m.histogram_quantile(buckets, ["event_type"], 0.95).withColumn("quantile", F.round("quantile", 6))


@register("error_ratio", """
SELECT user_id, round(count(*) FILTER (event_type = 'error') / 2592000.0
  / greatest(count(*) / 2592000.0, 0.001), 9)::DOUBLE AS ratio FROM events GROUP BY user_id""")
def error_ratio(spark, sf_dir):
    return m.ratio(events(spark, sf_dir), F.col("event_type") == "error", ["user_id"], 2_592_000).withColumn(
        "ratio", F.round("ratio", 9))


@register("hit_ratio", """
SELECT user_id, round(sum(value) FILTER (event_type = 'click') / 3600.0
  / greatest(count(*) FILTER (event_type IN ('click', 'view')) / 3600.0, 0.001), 6)::DOUBLE AS ratio
FROM events GROUP BY user_id""")
def hit_ratio(spark, sf_dir):
    """A summed value over a count of some of the events, as for failures per request."""
    clicks = F.when(F.col("event_type") == "click", F.col("value"))
    return m.ratio(events(spark, sf_dir), clicks, ["user_id"], 3600, F.col("event_type").isin("click", "view")) \
        .withColumn("ratio", F.round("ratio", 6))


@register("daily_increase", """
SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS increase FROM events GROUP BY ALL""")
def daily_increase(spark, sf_dir):
    return _ntz(m.increase(events(spark, sf_dir), ["event_type"]), "day")


@register("sustained_alerts", f"""
WITH {_slide("'1 hour'", 3600, 6)},
r AS (SELECT "at", count(*) FILTER (event_type = 'error') / 21600.0 / greatest(count(*) / 21600.0, 0.001) AS ratio
  FROM p GROUP BY "at" HAVING ratio > 0.22),
i AS (SELECT *, epoch("at")::BIGINT // 3600 - row_number() OVER (ORDER BY "at") AS island FROM r)
SELECT min("at") AS started_at, max("at") AS last_at, round(max(ratio), 6)::DOUBLE AS peak,
  (epoch(max("at")) - epoch(min("at")))::BIGINT AS held_seconds FROM i GROUP BY island HAVING held_seconds >= 10800""")
def sustained_alerts(spark, sf_dir):
    points = m.windowed_ratio(events(spark, sf_dir), F.col("event_type") == "error", "6 hours", "1 hour", 21_600)
    return _ntz(m.sustained(points, 0.22, 3_600, 10_800), "started_at", "last_at").withColumn(
        "peak", F.round("peak", 6))


@register("latency_alerts", f"""
WITH {_slide("'1 hour'", 3600, 6)},
b AS (SELECT "at", le, count(*) FILTER (value <= le) AS cumulative
  FROM p, (SELECT unnest([10.0, 50.0, 200.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL),
s AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cumulative) OVER w, 0) AS below,
  0.95::DOUBLE * max(cumulative) OVER (PARTITION BY "at") AS rank FROM b WINDOW w AS (PARTITION BY "at" ORDER BY le)),
h AS (SELECT "at", arg_min(CASE WHEN le = 'inf'::DOUBLE THEN lo
  ELSE lo + (le - lo) * (rank - below) / (cumulative - below) END, le) AS v FROM s WHERE cumulative >= rank GROUP BY "at"),
i AS (SELECT *, epoch("at")::BIGINT // 3600 - row_number() OVER (ORDER BY "at") AS island FROM h WHERE v > 180)
SELECT min("at") AS started_at, max("at") AS last_at, round(max(v), 6) AS peak,
  (epoch(max("at")) - epoch(min("at")))::BIGINT AS held_seconds FROM i GROUP BY island HAVING held_seconds >= 7200""")
def latency_alerts(spark, sf_dir):
    """Alert on a p95 from buckets instead of a ratio."""
    windowed = events(spark, sf_dir).withColumn("_w", F.window("ts", "6 hours", "1 hour")).withColumn(
        "at", F.col("_w.end"))
    p95 = m.histogram_quantile(m.slo_buckets(windowed, ["at"], bounds=BOUNDS), ["at"], 0.95)
    return _ntz(m.sustained(p95, 180, 3_600, 7_200, value="quantile"), "started_at", "last_at").withColumn(
        "peak", F.round("peak", 6))


LIMIT, WINDOW_S = 2, 86_400


@register("rate_limit_replay", f"""
WITH r AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS e, row_number() OVER (
    PARTITION BY user_id, floor(epoch(ts) / {WINDOW_S}) ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, user_id, e // {WINDOW_S} AS bucket, n <= {LIMIT} AS allowed,
  CASE WHEN n > {LIMIT} THEN greatest(1, {WINDOW_S} - e % {WINDOW_S}) END AS retry_after FROM r""")
def rate_limit_replay(spark, sf_dir):
    return m.rate_limit(events(spark, sf_dir), "user_id", LIMIT, WINDOW_S).select(
        "event_id", "user_id", "bucket", "allowed", "retry_after")


@register("token_budget_replay", f"""
WITH t AS (SELECT *, ceil(value * 40)::BIGINT AS chars, floor(epoch(ts) / {WINDOW_S}) AS b FROM events),
s1 AS (SELECT *, 256 + chars AS tokens, CASE WHEN chars > 12000 THEN 'request_too_large' END AS d FROM t),
s2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS n FROM s1 WHERE d IS NULL),
s3 AS (SELECT *, CASE WHEN n > 3 THEN 'rate_limit_exceeded' WHEN tokens > 4000 THEN 'request_cost_limit_exceeded' END
  AS d2 FROM s2),
s4 AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS used FROM s3 WHERE d2 IS NULL)
SELECT event_id, tokens, decision, CASE WHEN decision = 'allowed' THEN NULL WHEN decision LIKE 'request%' THEN 0
  ELSE greatest(1, {WINDOW_S} - floor(epoch(ts))::BIGINT % {WINDOW_S}) END AS retry_after FROM (
SELECT event_id, ts, tokens, d AS decision FROM s1 WHERE d IS NOT NULL
UNION ALL SELECT event_id, ts, tokens, d2 FROM s3 WHERE d2 IS NOT NULL
UNION ALL SELECT event_id, ts, tokens, CASE WHEN used <= 4500 THEN 'allowed' ELSE 'cost_budget_exceeded' END FROM s4)""")
def token_budget_replay(spark, sf_dir):
    """Forty characters per unit of value stand in for the input text."""
    ev = events(spark, sf_dir)
    return m.token_budget(ev, "user_id", F.ceil(F.col("value") * 40), per_min=4_500, requests=3,
                          window_s=WINDOW_S).select("event_id", "tokens", "decision", "retry_after")


@register("sketch_percentiles", """
SELECT event_type, count(*) AS n, round(sum(greatest(value - 10, 0)), 4) AS total, greatest(max(value) - 10, 0) AS max,
  true AS p50_within, true AS p95_within, true AS p99_within
FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type""")
def sketch_percentiles(spark, sf_dir):
    """Percentiles of half a month from stored sketches of minutes: totals, and whether each rank is within its bound."""
    shifted = events(spark, sf_dir).withColumn("value", F.col("value") - 10).withColumn("ts", F.col("ts").cast("timestamp"))
    path, start, end = new_stage_path(spark, "sketches"), "2024-01-05 06:00:00", "2024-01-20 12:00:00"
    sketches.write_sketches(sketches.timer_sketches(shifted, ["event_type"]), path)
    found = sketches.sketched_percentiles(sketches.read_sketches(spark, path, start, end), ["event_type"])
    own = shifted.filter((F.col("ts") >= start) & (F.col("ts") < end))
    errors = sketches.rank_errors(found, own, ["event_type"])
    within = [(F.col(f"e.{p}") <= sketches.RANK_ERROR).alias(f"{p}_within") for p in m.TIMER_PERCENTILES]
    return found.alias("f").join(errors.alias("e"), "event_type").select(
        "event_type", "n", F.round("total", 4).alias("total"), "max", *within)
