"""Streaming forms, drained over the event table; each must agree with the SQL of its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrievo.plans.memory import LIFETIMES
from retrievo.plans.registry import SQL, register, table
from retrievo.plans import ingestion as _ingestion, telemetry as _telemetry  # noqa: F401  (their SQL is used here)
from retrievo.plans.ingestion import _GOOD
from retrievo.plans.sources import CHAT_SQL, chat_lines
from retrievo.plans.telemetry import LIMIT, WINDOW_S, _slide
from retrievo.staging import new_stage_path
from retrievo.streaming import imports, line_imports, quotas, sinks, stateful, telemetry


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _decided(spark, sf_dir, **limits):
    path = new_stage_path(spark, "quotas")
    quotas.run_quotas(event_stream(spark, sf_dir), path, f"{path}/checkpoint", "user_id", window_s=WINDOW_S, **limits)
    return spark.read.parquet(f"{path}/decisions")


@register("stream_rate_limit", SQL["rate_limit_replay"])
def stream_rate_limit(spark, sf_dir):
    out = _decided(spark, sf_dir, limit=LIMIT)
    return out.select("event_id", "user_id", "bucket", (F.col("decision") == "allowed").alias("allowed"), "retry_after")


@register("stream_token_budget", SQL["token_budget_replay"])
def stream_token_budget(spark, sf_dir):
    out = _decided(spark, sf_dir, text_length=F.ceil(F.col("value") * 40), limit=3, per_min=4_500)
    return out.select("event_id", "tokens", "decision", "retry_after")


@register("stream_import", SQL["import_counts"])
def stream_import(spark, sf_dir):
    """Chat lines written as one folder per file name, then imported two files at a time."""
    path = new_stage_path(spark, "import")
    chat_lines(spark, sf_dir).select("file_name", "line").write.partitionBy("file_name").text(f"{path}/in")
    imports.run_import(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", files_per_batch=16)
    totals = imports.import_totals(spark, f"{path}/out")
    name = F.regexp_extract("file_name", "file_name=([^/]+)", 1)
    return totals.groupBy(name.alias("file_name")).agg(
        *[F.sum(c).alias(c) for c in ("success_count", "fail_count", "total")])


LINES_PER_BATCH = 2_000
AT_ONCE = 16  # batches of a micro-batch


def _line_import(spark, sf_dir):
    path = new_stage_path(spark, "line-import")
    chat_lines(spark, sf_dir).select("file_name", "line").write.partitionBy("file_name").text(f"{path}/in")
    line_imports.run_line_import(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", lines_per_batch=LINES_PER_BATCH,
                                 at_once=AT_ONCE)
    return f"{path}/out"


@register("stream_line_import", SQL["import_counts"])
def stream_line_import(spark, sf_dir):
    """Chat lines written as files and imported in batches of lines with offsets inside the files."""
    totals = line_imports.line_import_totals(spark, _line_import(spark, sf_dir))
    name = F.regexp_extract("file_name", "file_name=([^/]+)", 1)
    return totals.groupBy(name.alias("file_name")).agg(
        *[F.sum(c).alias(c) for c in ("success_count", "fail_count", "total")])


@register("import_progress", f"""
WITH {CHAT_SQL}, n AS (SELECT count(*) AS lines FROM conversations)
SELECT ceil(lines / {LINES_PER_BATCH}.0)::BIGINT AS batches, lines, lines AS lines_done, 100.0::DOUBLE AS percent,
  (SELECT count(*) FILTER ({_GOOD}) FROM chat) AS success, (SELECT count(*) FILTER (NOT ({_GOOD})) FROM chat) AS fail FROM n""")
def import_progress(spark, sf_dir):
    """The running progress that an import has left, summed up: blank lines are read but neither succeed nor fail."""
    rows = line_imports.import_progress(spark, _line_import(spark, sf_dir))
    return rows.agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in ("lines", "success", "fail")],
                    F.max("lines_done").alias("lines_done"), F.max("percent").alias("percent"))


def _kept(spark, stream):
    """A stream with keyed state or windows in append mode, drained into a table."""
    path = new_stage_path(spark, "stream")
    stateful.drain_stateful(stream, sinks.batch_files(f"{path}/out"), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@register("stream_lifetimes", """
WITH RECURSIVE log AS (SELECT event_id AS id, event_type AS kind, user_id AS k, ts, CASE event_type WHEN 'click' THEN 86400
  WHEN 'view' THEN 3600 WHEN 'purchase' THEN 86400 END AS life FROM events),
miss AS (SELECT kind, k, min(ts) AS ts FROM log WHERE life IS NOT NULL GROUP BY ALL
  UNION ALL SELECT l.kind, l.k, min(l.ts) FROM miss m JOIN log l ON l.kind = m.kind AND l.k = m.k
    AND l.ts >= m.ts + to_seconds(life) GROUP BY l.kind, l.k),
stored AS (SELECT min(id) AS id FROM log JOIN miss USING (kind, k, ts) GROUP BY kind, k, ts)
SELECT id AS request_id, kind, k::VARCHAR AS key, life IS NOT NULL AND id NOT IN (SELECT id FROM stored) AS hit FROM log""")
def stream_lifetimes(spark, sf_dir):
    """Entries of three kinds that are stored on a miss, for 24 hours, one hour and 24 hours."""
    asked = event_stream(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("key"), "ts")
    return _kept(spark, stateful.lifetimes_stream(asked, LIFETIMES)).drop("batch_id")


def _closing_row(events):
    """A row two days after all others, which lets the watermark pass them."""
    last = events.agg(F.max("ts").alias("ts")).withColumn("ts", F.expr("ts + INTERVAL 2 DAYS"))
    return last.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])


PARTS = 4


def _split_events(spark, sf_dir, parts):
    """Events written in ``parts`` steps, those of a step taken from the whole range of time, and split as they come
    into rows on time and late ones: the folder of both and their schema."""
    path = new_stage_path(spark, "events")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    step = F.pmod(F.xxhash64("event_id"), F.lit(parts))
    for k in range(parts):
        events.filter(step == k).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        telemetry.split_late(stream, path, f"{path}/checkpoint")
    _closing_row(events).write.mode("append").parquet(f"{path}/in")
    telemetry.split_late(spark.readStream.schema(events.schema).parquet(f"{path}/in"), path, f"{path}/checkpoint")
    return path, events.schema


def _closed(spark, sf_dir, windows):
    """All windows of the events in append mode: ``windows`` makes them of the stream of rows on time."""
    path, schema = _split_events(spark, sf_dir, 1)
    return _kept(spark, windows(stateful.on_time_stream(spark, path, schema)))


@register("stream_rate_5m", SQL["rate_5m"])
def stream_rate_5m(spark, sf_dir):
    out = _closed(spark, sf_dir, lambda events: telemetry.rate_stream(events, ["event_type"]))
    return out.select(F.col("at").cast("timestamp_ntz").alias("at"), "event_type", F.round("rate", 9).alias("rate"))


@register("stream_daily_increase", SQL["daily_increase"])
def stream_daily_increase(spark, sf_dir):
    out = _closed(spark, sf_dir, lambda events: telemetry.increase_stream(events, ["event_type"]))
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "increase")


@register("stream_error_ratio", f"""
WITH {_slide("'1 hour'", 3600, 6)}
SELECT "at", round(count(*) FILTER (event_type = 'error') / 21600.0 / greatest(count(*) / 21600.0, 0.001), 9)::DOUBLE
  AS ratio FROM p GROUP BY "at\"""")
def stream_error_ratio(spark, sf_dir):
    out = _closed(spark, sf_dir, lambda events: telemetry.ratio_stream(
        events, F.col("event_type") == "error", "6 hours", "1 hour", 21_600))
    return out.select(F.col("at").cast("timestamp_ntz").alias("at"), F.round("ratio", 9).alias("ratio"))


@register("stream_increase_late", SQL["daily_increase"])
def stream_increase_late(spark, sf_dir):
    """Daily counts in append mode of events that come out of order: closed windows and the late rows make the whole."""
    path, schema = _split_events(spark, sf_dir, PARTS)
    closed = _kept(spark, telemetry.increase_stream(stateful.on_time_stream(spark, path, schema), ["event_type"]))
    late = spark.read.parquet(f"{path}/late").groupBy(
        F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("increase"))
    return closed.select("day", "event_type", "increase").unionByName(late).groupBy(
        F.col("day").cast("timestamp_ntz").alias("day"), "event_type").agg(F.sum("increase").alias("increase"))


@register("stream_alerts", SQL["sustained_alerts"])
def stream_alerts(spark, sf_dir):
    """Windows in append mode feed the alerts' state: the spans that have fired, once they are resolved."""
    path, schema = _split_events(spark, sf_dir, 1)
    points = stateful.ratio_points(stateful.on_time_stream(spark, path, schema), F.col("event_type") == "error",
                                   "6 hours", "1 hour", 21_600)
    out = _kept(spark, stateful.alert_stream(points, 0.22, 3_600, 10_800))
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "last_at")]
    return out.filter("state = 'resolved' AND fired").select(*ntz, F.round("peak", 6).alias("peak"), "held_seconds")


@register("stream_rate_limit_keyed", SQL["rate_limit_replay"])
def stream_rate_limit_keyed(spark, sf_dir):
    out = _kept(spark, stateful.quota_stream(event_stream(spark, sf_dir), "user_id", limit=LIMIT, window_s=WINDOW_S))
    return out.select(F.col("request_id").alias("event_id"), F.col("identity").cast("long").alias("user_id"), "bucket",
                      (F.col("decision") == "allowed").alias("allowed"), "retry_after")


@register("stream_token_budget_keyed", SQL["token_budget_replay"])
def stream_token_budget_keyed(spark, sf_dir):
    out = _kept(spark, stateful.quota_stream(event_stream(spark, sf_dir), "user_id", text_length=F.ceil(F.col("value") * 40),
                                             limit=3, per_min=4_500, window_s=WINDOW_S))
    return out.select(F.col("request_id").alias("event_id"), "tokens", "decision", "retry_after")
