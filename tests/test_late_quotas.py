"""Late requests of a quota stream meet what earlier batches used up, however old their bucket is."""

from pyspark.sql import functions as F

from retrievo.operators import telemetry
from retrievo.streaming import quotas

# (event, second, identity, characters) per micro-batch; identity 1 uses up second 0's minute before it is closed
BATCHES = [[(i, i, 1, 10) for i in range(5)] + [(9, 9, 2, 10)],
           [(10, 5_000, 1, 10)],
           [(20, 40, 1, 10), (21, 41, 2, 10), (22, 42, 3, 10), (23, 5_001, 1, 10)],
           [(30, 9_000, 2, 10)],
           [(40, 50, 2, 10), (41, 51, 2, 10), (42, 52, 3, 10), (43, 5_002, 1, 10)]]


def _streamed(spark, tmp_path, **limits):
    for rows in BATCHES:
        spark.createDataFrame(rows, "event_id long, s long, user_id long, chars long").select(
            "event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "chars").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    quotas.run_quotas(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "user_id", **limits)
    got = spark.read.parquet(str(tmp_path / "out" / "decisions"))
    return batch, {r.event_id: r.decision for r in got.collect()}, got


def test_late_rate_limit(spark, tmp_path):
    batch, got, _ = _streamed(spark, tmp_path, limit=3)
    want = telemetry.rate_limit(batch, "user_id", 3).collect()  # within a bucket, ids follow time here
    assert got == {r.event_id: "allowed" if r.allowed else "rate_limit_exceeded" for r in want}
    assert (got[20], got[21], got[40], got[41], got[42]) == (
        "rate_limit_exceeded", "allowed", "allowed", "rate_limit_exceeded", "allowed")
    kept = spark.read.parquet(str(tmp_path / "out" / "counters" / "batch_id=4"))
    assert kept.agg(F.min("bucket")).first()[0] == 150  # late buckets do not stay


def test_late_token_budget(spark, tmp_path):
    limits = dict(per_min=3 * 266, per_request=1_000, max_chars=800)
    batch, got, rows = _streamed(spark, tmp_path, text_length=F.col("chars"), limit=20, **limits)
    want = telemetry.token_budget(batch, "user_id", F.col("chars"), requests=20, **limits)
    assert got == {r.event_id: r.decision for r in want.collect()}
    assert got[20] == got[41] == "cost_budget_exceeded" and got[42] == "allowed"
    assert rows.count() == sum(map(len, BATCHES))
