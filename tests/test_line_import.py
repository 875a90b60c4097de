"""Imports that stop and go on inside a file."""

import json

import pytest
from pyspark.sql import functions as F

from retrievo.operators import ingestion
from retrievo.sources.index import ReadOnlyError
from retrievo.sources.line_stream import build_index, indexed_files, line_stream, split_lines
from retrievo.sources.readers import parse_chat_lines
from retrievo.streaming.line_imports import BATCH_LINES, import_progress, line_import_totals, run_line_import


def _line(i):
    if i % 11 == 3:
        return '{"messages": [{"role": "user"'
    if i % 13 == 5:
        return "   "
    messages = [{"role": "system", "content": "s"}, {"role": "user", "content": f"question {i}" if i % 7 else ""},
                {"role": "assistant", "content": "answer " * (i % 5)}]
    return json.dumps({"messages": messages[:2] if i % 17 == 0 else messages})


def _write(folder, name, lines, end="\n", last="\n"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes((end.join(lines) + last).encode() if lines else b"")


def test_blocks_become_lines():
    data = b"a\nbb\n\nccc"
    for n in (1, 2, 3, 100):
        assert list(split_lines(data[i:i + n] for i in range(0, len(data), n))) == [b"a", b"bb", b"", b"ccc"]
    assert list(split_lines(iter([b"a\n", b"\n"]))) == [b"a", b""]


@pytest.mark.parametrize("range_bytes, mark_lines", [(64, 5), (1000, 1), (1 << 20, 1000)])
def test_every_line_of_every_file(spark, tmp_path, range_bytes, mark_lines):
    source = tmp_path / "in"
    files = {"a.jsonl": [f"line {i} é" * (i % 4) for i in range(113)], "b.jsonl": ["one"], "c.jsonl": [],
             "d.jsonl": ["x" * 5000, "", "y"]}
    _write(source, "a.jsonl", files["a.jsonl"], "\r\n", "\r\n")
    _write(source, "b.jsonl", files["b.jsonl"], last="")
    _write(source, "c.jsonl", [])
    _write(source, "d.jsonl", files["d.jsonl"], last="")
    index = build_index(spark, str(source), f"{tmp_path}/index", range_bytes, mark_lines)
    assert indexed_files(spark, index) == [113, 1, 3]  # Spark lists no empty files
    sizes = []

    def sink(df, batch_id):
        sizes.append(df.count())
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id={batch_id}")

    query = line_stream(spark, index, 40, 7).writeStream.option(
        "checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(sink).start()
    query.processAllAvailable()
    query.stop()
    assert sizes == [40, 40, 37]
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r.file_name.rsplit("/", 1)[1], {})[r.line_no] = r.line
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in files.items() if v}


def test_killed_inside_a_file(spark, tmp_path):
    """One file in batches of 18 lines; the run breaks before and after a batch is written, then goes on."""
    source, target, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    lines = [_line(i) for i in range(230)]
    _write(source, "train.jsonl", lines)
    seen = []

    def broken(at):
        def after(batch_id):
            seen.append(batch_id)
            if batch_id == at:
                raise RuntimeError("lost")
        return after

    for stop in (3, 7):
        with pytest.raises(Exception):
            run_line_import(spark, str(source), target, checkpoint, lines_per_batch=BATCH_LINES, after_batch=broken(stop))
    run_line_import(spark, str(source), target, checkpoint, lines_per_batch=BATCH_LINES, after_batch=seen.append)
    assert seen == [0, 1, 2, 3, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12]
    done = spark.read.parquet(f"{target}/lines")
    numbers = sorted(r.line_no for r in done.select("line_no").collect())
    assert numbers == [i for i, t in enumerate(lines) if t.strip()]
    assert all(r.line_no // BATCH_LINES == r.batch_id for r in done.select("line_no", "batch_id").collect())

    plain = parse_chat_lines(spark.createDataFrame([("train.jsonl", t) for t in lines], "file_name string, line string"))
    want = ingestion.import_counts(plain).first()
    total = line_import_totals(spark, target).first()
    assert (total.success_count, total.fail_count, total.total) == (want.success_count, want.fail_count, want.total)
    assert done.filter("reason IS NULL").count() == want.success_count
    steps = import_progress(spark, target).orderBy("batch_id").collect()
    assert [r.batch_id for r in steps] == list(range(13)) and steps[-1].percent == 100.0
    assert sum(r.success for r in steps) == want.success_count and sum(r.fail for r in steps) == want.fail_count
    assert [r.lines_done for r in steps] == [min(230, 18 * (i + 1)) for i in range(13)]
    # nothing new: nothing is done; a file that comes later is imported alone
    run_line_import(spark, str(source), target, checkpoint, lines_per_batch=BATCH_LINES, after_batch=seen.append)
    assert len(seen) == 15
    _write(source, "a-test.jsonl", lines[:20])  # its path comes before that of the file already read
    run_line_import(spark, str(source), target, checkpoint, lines_per_batch=BATCH_LINES, after_batch=seen.append)
    assert seen[15:] == [13, 14]
    by_file = {r.file_name.rsplit("/", 1)[1]: r.total for r in line_import_totals(spark, target).collect()}
    assert by_file["a-test.jsonl"] == sum(bool(t.strip()) for t in lines[:20]) and by_file["train.jsonl"] == want.total


def test_progress_over_many_batches(spark, tmp_path):
    source, target = tmp_path / "in", f"{tmp_path}/out"
    for name in ("dev.jsonl", "train.jsonl"):
        _write(source, name, [_line(i) for i in range(120)])
    run_line_import(spark, str(source), target, f"{tmp_path}/checkpoint", lines_per_batch=2)
    steps = import_progress(spark, target).agg(F.count("*").alias("n"), F.sum("lines").alias("lines"),
                                               F.sum("success").alias("ok"), F.sum("fail").alias("bad")).first()
    totals = line_import_totals(spark, target).agg(F.sum("success_count").alias("ok"), F.sum("fail_count").alias("bad")).first()
    assert steps.n == 120 and (steps.ok, steps.bad) == (totals.ok, totals.bad)


def test_batches_side_by_side(spark, tmp_path):
    """Eight batches a micro-batch, stopped after the first is written: rows and progress as with one at a time."""
    source, target, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    files = {"dev.jsonl": [_line(i) for i in range(75)], "train.jsonl": [_line(i) for i in range(75, 230)]}
    for name, lines in files.items():
        _write(source, name, lines)
    seen = []

    def lost(batch_id):
        seen.append(batch_id)
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        run_line_import(spark, str(source), target, checkpoint, lines_per_batch=BATCH_LINES, after_batch=lost, at_once=8)
    run_line_import(spark, str(source), target, checkpoint, lines_per_batch=BATCH_LINES, after_batch=seen.append, at_once=8)
    assert seen == [0, 0, 8]
    rows = spark.read.parquet(f"{target}/lines").select("line_no", "file_name", "batch_id", "reason").collect()
    at = [r.line_no + (75 if r.file_name.endswith("train.jsonl") else 0) for r in rows]
    assert sorted(at) == [i for i in range(230) if _line(i).strip()]
    assert all(i // BATCH_LINES == r.batch_id for i, r in zip(at, rows))
    steps = import_progress(spark, target).orderBy("batch_id").collect()
    assert [(r.batch_id, r.lines_done) for r in steps] == [(i, min(230, 18 * (i + 1))) for i in range(13)]
    for r in steps:
        own = [x.reason for x in rows if x.batch_id == r.batch_id]
        assert (r.success, r.fail) == (own.count(None), len(own) - own.count(None))


def test_read_only(spark, tmp_path):
    with pytest.raises(ReadOnlyError):
        run_line_import(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/c", read_only=True)
