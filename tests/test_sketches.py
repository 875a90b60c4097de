import random

from pyspark.sql import functions as F

from retrievo.operators import sketches, telemetry

SCHEMA = "ts timestamp, kind string, value double"


def test_merged_sketches_against_exact_percentiles(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"2024-01-0{1 + i % 3} 10:{rng.randint(0, 59):02d}:00", rng.choice("ab"),
             rng.choice([rng.gauss(50, 30), rng.expovariate(0.01), 5.0])) for i in range(30_000)]
    rows += [("2024-01-01 10:00:00", "a", None), ("2024-01-02 10:00:00", "c", -3.0)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    half = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    for part in (df.filter(half), df.filter(~half | F.col("value").isNull())):  # two runs write the same buckets
        sketches.write_sketches(sketches.timer_sketches(part, ["kind"]), str(tmp_path))
    stored = sketches.read_sketches(spark, str(tmp_path), "2024-01-01", "2024-01-04")
    assert stored.count() > 300
    found = sketches.sketched_percentiles(stored, ["kind"])
    exact = {r.kind: r for r in telemetry.timer_percentiles(df.filter("value IS NOT NULL"), ["kind"]).collect()}
    for r in found.collect():
        want = exact[r.kind]
        assert (r.n, r.max) == (want.n, want.max) and abs(r.total - want.total) < 1e-6 * max(1, want.total)
    for r in sketches.rank_errors(found, df, ["kind"]).collect():
        assert max(r.p50, r.p95, r.p99) <= sketches.RANK_ERROR
    # a range inside: only its buckets count
    inside = sketches.read_sketches(spark, str(tmp_path), "2024-01-02 10:15:00", "2024-01-02 10:45:00")
    n = df.filter("ts >= '2024-01-02 10:15:00' AND ts < '2024-01-02 10:45:00' AND value IS NOT NULL").count()
    assert sketches.sketched_percentiles(inside, []).first().n == n
    one = sketches.sketched_percentiles(sketches.timer_sketches(df.filter("kind = 'c'"), ["kind"]), ["kind"]).first()
    assert (one.n, one.p50, one.p99, one.max) == (1, 0.0, 0.0, 0.0)
    assert sketches.timer_sketches(df.filter("false"), ["kind"]).count() == 0
