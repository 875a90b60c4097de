"""Building blocks against plain windows, with one key holding most rows."""

from pyspark.sql import Window, functions as F

from retrievo.operators.ordered import exact_quantiles, row_numbers, running_total


def log(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        "id", (F.col("id") * 7919 % 101).cast("double").alias("v"))


def test_running_total(spark):
    df = log(spark).withColumn("k", F.when(F.col("k") != "k0", F.col("k")))  # a null key is a key too
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("t", F.sum("v").over(w)).select("id", "t")
    got = running_total(df, ["k"], ["id"], F.floor(F.col("id") / 64), F.col("v"), "t").select("id", "t")
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    numbered = row_numbers(df, [], ["id"], F.floor(F.col("id") / 100), "n")
    assert numbered.filter("n <> id + 1").count() == 0


def test_quantiles(spark):
    df = spark.range(1, 21).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    near = exact_quantiles(df, ["k"], "v", {"p": 0.95}, "nearest").first()
    assert (near.n, near.p) == (20, 19.0)
    assert abs(exact_quantiles(df, ["k"], "v", {"p": 0.95}, "linear", 3.0).first().p - 19.05) < 1e-9
    big = log(spark)
    got = {r.k: r.p for r in exact_quantiles(big, ["k"], "v", {"p": 0.5}, "linear", 10.0).collect()}
    want = {r.k: r.p for r in big.groupBy("k").agg(F.percentile("v", 0.5).alias("p")).collect()}
    assert got == want
    assert exact_quantiles(big, [], "v", {"p": 1.0}).first().p == 100.0
