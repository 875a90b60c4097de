"""Sources, parsers, ingestion, guarded SELECT and streams."""

import json

import pytest
from pyspark.sql import functions as F

from retrievo.functions import formats, keywords
from retrievo.operators import guarded, ingestion, telemetry
from retrievo.operators.documents import chunk_text, parse_csv_qa, parse_dialogue
from retrievo.sources import index, readers
from retrievo.streaming import imports, quotas, telemetry as stream_telemetry


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("Q: a\nA: b\nQ: c\nA: d\nQ: e\nA: f\n", "FAQ"), ("User: a\nAssistant: b\nUser: c\nAssistant: d", "CONVERSATION"),
    ("just words", "PLAIN"), ("", "PLAIN"), ("Q: a\nA: b\n---\n", "PLAIN"), ("问题,回答\n退款,可以", "CSV"),
    ("# t\nbody", "ARTICLE"), ("Q: a\nA: b\nx\nUser: c\ny\nz\n", "MIXED"),
])
def test_formats(spark, text, want):
    assert one(spark, text, formats.detect_format) == want


def test_structured_text(spark):
    assert one(spark, "Q: a\nA: b", formats.structured_text) == "FAQ-1:\n问题：a\n回答：b\n\n"
    assert one(spark, "plain text", formats.structured_text) == "plain text"
    assert one(spark, "  \n ", formats.structured_text) == ""


def test_full_width_dialogue(spark):
    df = spark.createDataFrame([(1, "用户：你好:吗\n客服： 在的")], "doc_id long, text string")
    assert [(r.role, r.text) for r in parse_dialogue(df).orderBy("turn").collect()] == [("顾客", "你好:吗"), ("客服", "在的")]


def test_csv_header(spark):
    df = spark.createDataFrame([(1, "\nquestion,answer\na,b,c\nd，e\n,x\n"), (2, "a,b")], "doc_id long, text string")
    assert [(r.doc_id, r.record, r.question, r.answer, r.category) for r in parse_csv_qa(df).orderBy("doc_id", "record").collect()] \
        == [(1, 1, "a", "b", "c"), (1, 2, "d", "e", None), (2, 1, "a", "b", None)]


def test_keywords(spark):
    assert one(spark, "RAG 召回 abcd", keywords.extract_keywords) == ["RAG", "召回", "abcd", "ab", "bc", "cd", "abc", "bcd"]
    assert one(spark, "请问", keywords.extract_keywords) == ["请问"]
    assert one(spark, " ", keywords.extract_keywords) == []


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(str(i) for i in range(25))), (2, "a b"), (3, " ")], "doc_id long, text string")
    out = chunk_text(df, 10, 2).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.content.split()[0], r.total_chunks) for r in out] == [(1, "0", 3), (1, "8", 3), (1, "16", 3), (2, "a", 1)]
    with pytest.raises(ValueError):
        chunk_text(df, 5, 5)


def test_document_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Q: x\nA: y\n")
    (tmp_path / "b.MD").write_text("# kept\n")
    out = {r.file_name: (r.file_type, r.text) for r in readers.read_text_documents(spark, str(tmp_path)).collect()}
    assert out == {"a.txt": ("txt", "FAQ-1:\n问题：x\n回答：y\n\n"), "b.MD": ("md", "# kept\n")}


def line(*messages):
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in messages]}, ensure_ascii=False)


LINES = [line(("system", "s"), ("user", " 一\n二 "), ("assistant", "ok")), "{broken", "", line(("user", "a"), ("assistant", "b")),
         line(("system", "s"), ("user", ""), ("assistant", "b"))]


def test_resumable_import(spark, tmp_path):
    src, dst, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "train.jsonl").write_text("\n".join(LINES))
    imports.run_import(spark, src, dst, ck)
    imports.run_import(spark, src, dst, ck)  # nothing new
    totals = lambda: {r.file_name.split("/")[-1]: (r.success_count, r.fail_count) for r in imports.import_totals(spark, dst).collect()}
    assert totals() == {"train.jsonl": (1, 3)}
    (tmp_path / "in" / "dev.jsonl").write_text(LINES[0])
    imports.run_import(spark, src, dst, ck)
    assert totals() == {"train.jsonl": (1, 3), "dev.jsonl": (1, 0)}
    row = spark.read.parquet(f"{dst}/pairs").filter("category = 'train'").first()
    assert (row.question, row.answer, row.qa_text) == ("一 二", "ok", "用户问题：一 二 客服回答：ok")
    with pytest.raises(index.ReadOnlyError):
        imports.run_import(spark, src, dst, ck, read_only=True)


def test_budget_is_checked_before_the_call(spark):
    calls = spark.createDataFrame([(i, "p" * 20, "r" * 20) for i in range(10)], "id long, prompt string, response string")
    made = ingestion.budget_cutoff(calls, [], "id", F.floor(F.col("id") / 3), budget=50 * 0.5 / 1_000_000)
    assert sorted(r.id for r in made.collect()) == [0, 1, 2]


@pytest.fixture(scope="module")
def users(sf_dir):
    return {"users": lambda s: s.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")}


def test_guarded_rows(spark, users):
    assert guarded.guarded_select(spark, "select id from users;", users, 5).count() == 5
    assert guarded.guarded_select(spark, "SELECT count(*) AS n FROM users WHERE name <> 'drop table x; --'".replace("; --", ""), users).first().n == 20


@pytest.mark.parametrize("sql", [
    "", "delete from users", "select * from admins", "select 1", "select * from users; drop table users",
    "select * from users -- x", "select * from users, hidden", "select * from users join global_temp.x",
    "select reflect('java.lang.System', 'exit', '1') from users", "select java_method('a', 'b') from users",
    "select * from parquet.`/tmp`", "select * from `users`", "with a as (select 1) select * from a",
    "select * from users, range(10)", "select id from users where id in (select id from hidden)",
    "select id from users where exists (select 1 from default.hidden)", "select id from users, spark_catalog.default.hidden",
])
def test_guarded_rejects(spark, users, sql):
    spark.range(1).createOrReplaceTempView("hidden")
    with pytest.raises(Exception) as error:
        guarded.guarded_select(spark, sql, users).collect()
    assert isinstance(error.value, guarded.RejectedSql) or "TABLE_OR_VIEW_NOT_FOUND" in str(error.value)


def test_histogram_quantile(spark):
    b = spark.createDataFrame([("a", 0.1, 10), ("a", 0.5, 20), ("a", float("inf"), 20), ("b", 0.1, 0), ("b", 0.5, 0), ("b", float("inf"), 4)],
                              "k string, le double, cumulative long")
    out = {r.k: r.quantile for r in telemetry.histogram_quantile(b, ["k"], 0.95).collect()}
    assert out["a"] == pytest.approx(0.1 + 0.4 * 0.9) and out["b"] == 0.5


def test_quota_stream_over_several_batches(spark, tmp_path):
    """One identity sends most requests; the stream cuts its minute into batches and must agree with the batch replay."""
    for part in range(4):
        rows = [(part * 50 + i, 60 * (part // 2) + part % 2 * 30 + i // 5, 1 if i % 5 else 2 + i % 3, i * 37 % 900) for i in range(50)]
        spark.createDataFrame(rows, "event_id long, s long, user_id long, chars long").select(
            "event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "chars").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limits = dict(per_min=6_000, per_request=1_000, max_chars=800)
    quotas.run_quotas(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "user_id", text_length=F.col("chars"), limit=20, **limits)
    got = spark.read.parquet(str(tmp_path / "out" / "decisions")).select("event_id", "decision")
    want = telemetry.token_budget(batch, "user_id", F.col("chars"), requests=20, **limits).select("event_id", "decision")
    assert got.count() == 200 and got.exceptAll(want).count() == 0
    assert got.select("decision").distinct().count() >= 4


def test_late_rows(spark, tmp_path):
    for name, times in (("a", [0, 1000]), ("b", [100, 990, 1200])):
        spark.createDataFrame([(t,) for t in times], "s long").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream_telemetry.split_late(stream, out, str(tmp_path / "ck"), delay_seconds=600)
    assert [r[0] for r in spark.read.parquet(f"{out}/late").select(F.unix_timestamp("ts")).collect()] == [100]
    assert spark.read.parquet(f"{out}/on_time").count() == 4


def test_rate_stream_closes_windows(spark, tmp_path):
    spark.createDataFrame([(0,), (30,), (4000,)], "s long").select(F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_telemetry.rate_stream(stream, []).writeStream.format("memory").queryName("rates").outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination()
    rates = spark.sql("SELECT rate FROM rates").collect()
    assert rates and max(r.rate for r in rates) == pytest.approx(2 / 300)
