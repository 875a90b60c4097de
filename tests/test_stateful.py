"""Streams with keyed state, batch by batch and over restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from retrievo.operators import telemetry as batch
from retrievo.streaming import sinks, stateful, telemetry

START = dt.datetime(2024, 1, 1)
EVENT = "event_id long, user_id long, ts timestamp, event_type string, value double"


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def _state_rows(query):
    return sum(p.numRowsTotal for p in query.lastProgress.stateOperators)


def test_lifetimes_over_restarts(spark, tmp_path):
    """A miss stores, a hit does not renew, each kind has its lifetime; every step is a stream of its own."""
    rng = random.Random(3)
    life = {"history": 24 * 3600, "search": 3600}
    asked, now = [], 0
    for i in range(600):
        now += rng.choice([0, 5, 900, 4000])
        asked.append((i, rng.choice(["history", "search", "other"]), f"k{rng.randint(0, 3)}", _at(now)))
    until, want = {}, {}
    for i, kind, key, ts in asked:
        hit = (kind, key) in until and ts < until[kind, key]
        if not hit and kind in life:
            until[kind, key] = ts + dt.timedelta(seconds=life[kind])
        want[i] = hit
    schema = "request_id long, kind string, key string, ts timestamp"
    for a in range(0, 600, 200):
        spark.createDataFrame(asked[a:a + 200], schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = stateful.drain_stateful(stateful.lifetimes_stream(stream, life), sinks.batch_files(f"{tmp_path}/out"),
                                        f"{tmp_path}/checkpoint")
    got = {r.request_id: r.hit for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and any(want.values())
    # two weeks later all entries are gone from the state but the new one
    spark.createDataFrame([(1000, "search", "k0", _at(now + 14 * 86400))], schema).write.mode("append").parquet(f"{tmp_path}/in")
    query = stateful.drain_stateful(stateful.lifetimes_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), life),
                                    sinks.batch_files(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    assert _state_rows(query) <= 3  # the entry and its timer


def _drain_events(spark, tmp_path, steps, transform):
    query = None
    for rows in steps:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        query = stateful.drain_stateful(transform(stream), sinks.batch_files(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    return query, spark.read.parquet(f"{tmp_path}/out")


def _minute(i, minute, errors, total=4, user=1):
    return [(i * 100 + k, user, _at(minute * 60 + k), "error" if k < errors else "ok", 1.0) for k in range(total)]


def test_alert_states(spark, tmp_path):
    """Above the limit in minutes 0-6, a gap, again in 20-21; nothing for user 2. Late rows do not change what was told."""
    def transform(stream):
        points = stateful.ratio_points(stream, F.col("event_type") == "error", "1 minute", "1 minute", 60, ["user_id"],
                                       "2 minutes")
        return stateful.alert_stream(points, 0.4, 60, 300, ["user_id"])

    first = sum((_minute(i, i, 3) for i in range(7)), []) + sum((_minute(50 + i, i, 0, user=2) for i in range(7)), [])
    second = _minute(10, 7, 1) + _minute(20, 20, 4) + _minute(21, 21, 2)
    third = _minute(30, 3, 0, total=90) + _minute(31, 90, 0)  # minute 3 is long closed
    query, out = _drain_events(spark, tmp_path, [first, second, third], transform)
    rows = sorted((r.user_id, r.at, r.state, r.held_seconds, round(r.peak, 3), r.fired) for r in out.collect())
    end = lambda m: _at((m + 1) * 60)
    assert rows == [
        ("1", end(0), "pending", 0, 0.75, False), ("1", end(5), "firing", 300, 0.75, True),
        ("1", end(7), "resolved", 360, 0.75, True), ("1", end(20), "pending", 0, 1.0, False),
        ("1", end(22), "resolved", 60, 1.0, False)]
    told = [r for r in out.filter("state = 'resolved'").collect() if r.fired]
    assert [(r.started_at, r.last_at) for r in told] == [(end(0), end(6))]
    assert _state_rows(query) <= 4


def test_alerts_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted([(i, rng.randint(1, 3), _at(rng.randint(0, 5 * 3600)), rng.choice(["error", "ok", "ok"]), 1.0)
                   for i in range(1500)], key=lambda r: r[2])
    steps = [rows[a:a + 300] for a in range(0, 1500, 300)] + [[(9999, 9, _at(3 * 86400), "ok", 1.0)]]
    bad = F.col("event_type") == "error"

    def transform(stream):
        return stateful.alert_stream(stateful.ratio_points(stream, bad, "10 minutes", "5 minutes", 600, ["user_id"]),
                                     0.35, 300, 600, ["user_id"])

    _, out = _drain_events(spark, tmp_path, steps, transform)
    got = sorted((r.user_id, r.started_at, r.last_at, round(r.peak, 9), r.held_seconds)
                 for r in out.filter("state = 'resolved' AND fired").collect())
    points = batch.windowed_ratio(spark.createDataFrame(rows, EVENT), bad, "10 minutes", "5 minutes", 600, ["user_id"])
    want = sorted((str(r.user_id), r.started_at, r.last_at, round(r.peak, 9), r.held_seconds)
                  for r in batch.sustained(points, 0.35, 300, 600, ["user_id"]).collect())
    assert got == want and len(want) > 3


def test_quotas_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted([(i, rng.choice([1, 1, 1, 2, 3]), _at(rng.randint(0, 1800)), "ok", float(rng.randint(1, 400)))
                   for i in range(900)], key=lambda r: (r[2], r[0]))
    whole = spark.createDataFrame(rows, EVENT)
    for name, more in (("rate", {}), ("tokens", {"text_length": F.col("value") * 10, "per_min": 9000, "per_request": 3500,
                                                 "max_chars": 3800})):
        folder = tmp_path / name
        query, out = _drain_events(spark, folder, [rows[a:a + 250] for a in range(0, 900, 250)],
                                   lambda s: stateful.quota_stream(s, "user_id", limit=8, **more))  # noqa: B023
        if more:
            want = batch.token_budget(whole, "user_id", F.ceil(F.col("value") * 10), 9000, 3500, 3800, 8)
        else:
            want = batch.rate_limit(whole, "user_id", 8).withColumn(
                "decision", F.when(F.col("allowed"), "allowed").otherwise("rate_limit_exceeded"))
        want = {(r.event_id, r.bucket, r.decision, r.retry_after) for r in want.collect()}
        got = [(r.request_id, r.bucket, r.decision, r.retry_after) for r in out.collect()]
        assert len(got) == 900 and set(got) == want and len({d for _, _, d, _ in want}) == (5 if more else 2)
    closing = [(9999, 1, _at(5 * 86400), "ok", 1.0)]
    query, _ = _drain_events(spark, folder, [closing], lambda s: stateful.quota_stream(s, "user_id", limit=8, **more))
    assert _state_rows(query) <= 4  # the counters of all earlier buckets are gone


def test_late_rows_have_a_table(spark, tmp_path):
    """Out of order: rows on time and late rows are all rows, no window counts a row twice, the state stays small."""
    rng = random.Random(8)
    rows = [(i, 1, _at(rng.randint(0, 10 * 3600)), rng.choice("ab"), 1.0) for i in range(2000)]
    rng.shuffle(rows)
    path = f"{tmp_path}/split"
    steps = [rows[a:a + 400] for a in range(0, 2000, 400)] + [[(9999, 1, _at(5 * 86400), "a", 1.0)]]
    sizes = []
    for part in steps:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        telemetry.split_late(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/c1")
        stream = stateful.on_time_stream(spark, path, spark.createDataFrame([], EVENT).schema)
        query = stateful.drain_stateful(telemetry.increase_stream(stream, ["event_type"], "1 hour"),
                                        sinks.batch_files(f"{tmp_path}/out"), f"{tmp_path}/c2")
        sizes.append(sum(p.numRowsTotal for p in query.lastProgress.stateOperators))
        dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
        assert dropped == 0
    late = spark.read.parquet(f"{path}/late")
    assert late.count() > 1000 and late.count() + spark.read.parquet(f"{path}/on_time").count() == 2001
    closed = {(r.day, r.event_type): r.increase for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for r in late.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").count().collect():
        closed[r.h, r.event_type] = closed.get((r.h, r.event_type), 0) + r["count"]
    want = {(r.day, r.event_type): r.increase
            for r in batch.increase(spark.createDataFrame(rows, EVENT), ["event_type"], "1 hour").collect()}
    assert closed == want and max(sizes) <= 4  # open windows only


def test_the_setting_of_the_state_store_is_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with stateful.keyed_state(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_keys_share_state_values(spark, tmp_path):
    """The state of many keys is as many values as there are shards, and decisions are those of the batch operator."""
    schema = "event_id long, user_id string, ts timestamp"
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 1500 == 7 else f"u{i % 1500}", start + dt.timedelta(milliseconds=10 * i)) for i in range(4500)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = stateful.drain_stateful(stateful.quota_stream(stream, "user_id", limit=2),
                                    sinks.batch_files(f"{tmp_path}/quotas"), f"{tmp_path}/q")
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2 * stateful.SHARDS
    got = {r.request_id: r.decision for r in spark.read.parquet(f"{tmp_path}/quotas").collect()}
    assert got == {i: "allowed" if i < 3000 else "rate_limit_exceeded" for i in range(4500)}
    asked = stream.selectExpr("event_id AS request_id", "'view' AS kind", "user_id AS key", "ts")
    query = stateful.drain_stateful(stateful.lifetimes_stream(asked, {"view": 20}),
                                    sinks.batch_files(f"{tmp_path}/life"), f"{tmp_path}/l")
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2 * stateful.SHARDS
    got = {r.request_id: r.hit for r in spark.read.parquet(f"{tmp_path}/life").collect()}
    assert got == {i: 1500 <= i < 3000 for i in range(4500)}
