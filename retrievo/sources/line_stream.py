"""A streaming source of text lines that remembers file and line.

An index is built by one pass of tasks over byte ranges: each counts the line ends of its range and marks every
``mark_lines``-th line. Micro-batches then hold a given number of lines, also inside one large file; a batch is cut at
marks into parts that tasks read by byte range. The driver holds the list of files and the marks of one batch, no lines.

Files are opened by URI, so any store that pyarrow knows will do. Lines end with a line feed, a carriage return before
it goes; a file's last line may lack its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SOURCE = "retrievo_lines"
SCHEMA = "file_name string, line_no long, line string"
RANGE_BYTES = 64 << 20
MARK_LINES = 1000
LINES_PER_BATCH = 1_000_000
LINES_PER_TASK = 50_000
_READ = 1 << 20
_ARROW = pa.schema([("file_name", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])
_MARKS = "path string, start long, lines long, mark long, byte long"


def _store(uri: str):
    """File system and path of a URI, also of one that Spark prints with one slash, and of a plain path."""
    if "://" not in uri:
        uri = uri.replace(":/", ":///", 1) if ":/" in uri else "file://" + uri
    return fs.FileSystem.from_uri(uri)


def _open(uri: str):
    store, inside = _store(uri)
    return store.open_input_file(inside)


def _marks(mark_lines: int):
    """For each byte range its number of line ends, and every ``mark_lines``-th line that begins in it."""
    def run(batches):
        for batch in batches:
            for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size"))):
                lines, marks = 0, [(0, start)] if start == 0 else []
                with _open(path) as f:
                    f.seek(start)
                    left = size
                    while left and (data := f.read(min(_READ, left))):
                        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                        first = mark_lines - 1 - lines % mark_lines  # a mark follows each mark_lines-th line end
                        for k in range(first, len(ends), mark_lines):
                            marks.append((lines + k + 1, start + size - left + int(ends[k]) + 1))
                        lines += len(ends)
                        left -= len(data)
                marks = marks or [(0, None)]
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(marks), "start": [start] * len(marks), "lines": [lines] * len(marks),
                    "mark": [m for m, _ in marks], "byte": [b for _, b in marks]},
                    schema=pa.schema([("path", pa.string())] + [(c, pa.int64()) for c in
                                                                ("start", "lines", "mark", "byte")]))
    return run


def _last_bytes():
    """Whether a file's last line lacks its end."""
    def run(batches):
        for batch in batches:
            paths, sizes = batch.column("path").to_pylist(), batch.column("length").to_pylist()
            open_ended = []
            for path, size in zip(paths, sizes):
                with _open(path) as f:
                    f.seek(max(0, size - 1))
                    open_ended.append(int(size > 0 and f.read(1) != b"\n"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(open_ended)],
                                             names=["path", "length", "tail"])
    return run


def _versions(target: str) -> list[int]:
    """Finished versions of an index, oldest first."""
    store, folder = _store(target)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    numbers = sorted(int(f.base_name[1:]) for f in found if f.base_name.startswith("v") and f.base_name[1:].isdigit())
    return [n for n in numbers if store.get_file_info(f"{folder}/v{n}/files/_SUCCESS").type != fs.FileType.NotFound]


def _counted(spark: SparkSession, files: DataFrame, range_bytes: int, mark_lines: int, target: str) -> tuple[list, DataFrame]:
    """(path, length, lines) of every file, and the marks of all."""
    files.mapInArrow(_last_bytes(), "path string, length long, tail long").write.mode("overwrite").parquet(f"{target}/found")
    found = spark.read.parquet(f"{target}/found")
    starts = found.filter("length > 0").withColumn("start", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))))
    ranges = starts.select("path", "start", F.least(F.lit(range_bytes), F.col("length") - F.col("start")).alias("size"))
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    ranges.repartition(tasks).mapInArrow(_marks(mark_lines), _MARKS).write.mode("overwrite").parquet(f"{target}/counted")
    marks = spark.read.parquet(f"{target}/counted")
    # lines before each range: a range is one row, so a file of a terabyte has some ten thousand of them
    per_range = marks.groupBy("path", "start").agg(F.first("lines").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("start")) - F.col("lines")
    placed = marks.drop("lines").join(per_range.withColumn("before", before).drop("lines"), ["path", "start"])
    totals = per_range.groupBy("path").agg(F.sum("lines").alias("ends"))
    rows = found.join(totals, "path", "left").select(
        "path", "length", (F.coalesce("ends", F.lit(0)) + F.col("tail")).alias("lines")).collect()
    return rows, placed.filter("byte IS NOT NULL").select("path", (F.col("before") + F.col("mark")).alias("line"), "byte")


def build_index(spark: SparkSession, path: str, target: str, range_bytes: int = RANGE_BYTES,
                mark_lines: int = MARK_LINES) -> str:
    """The folder of a new version of the index: ``files`` (path, length, lines, file_no) and ``marks`` (path, line,
    byte).

    Files keep the number they have in the version before; new ones follow in the order of their paths. Only files that
    are new or have another length are read. A file that was read to its end before it grew is not read again. A mark is
    one row for ``mark_lines`` lines or for a range.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    now = {r.path: r.length for r in listed.collect()}
    versions = _versions(target)
    known, kept = {}, None
    if versions:
        last = f"{target}/v{versions[-1]}"
        known = {r.path: r for r in spark.read.parquet(f"{last}/files").collect()}
        if all(p in known and known[p].length == size for p, size in now.items()):
            return last
        kept = spark.read.parquet(f"{last}/marks")
    fresh = sorted(p for p, size in now.items() if p not in known or known[p].length != size)
    folder = f"{target}/v{versions[-1] + 1 if versions else 0}"
    changed = spark.createDataFrame([(p, now[p]) for p in fresh], "path string, length long")
    rows, marks = _counted(spark, changed, range_bytes, mark_lines, folder)
    if kept is not None:
        marks = marks.unionByName(kept.join(F.broadcast(changed.select("path")), "path", "left_anti"))
    marks.repartitionByRange("path", "line").sortWithinPartitions("path", "line") \
        .write.mode("overwrite").parquet(f"{folder}/marks")
    numbers = {p: r.file_no for p, r in known.items()}
    for p in fresh:
        numbers.setdefault(p, len(numbers))
    counted = {p: (r.length, r.lines) for p, r in known.items()} | {r.path: (r.length, r.lines) for r in rows}
    spark.createDataFrame([(p, *counted[p], numbers[p]) for p in sorted(counted)],
                          "path string, length long, lines long, file_no int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")
    return folder


@dataclass
class LineRange(InputPartition):
    """Lines ``first`` to ``last`` (exclusive) of a file, found ``skip`` lines after a byte; ``step`` counts runs of lines
    in the micro-batch."""

    path: str
    byte: int
    skip: int
    first: int
    last: int
    step: int


def split_lines(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Lines of a file's blocks; a long line is put together once."""
    held: list[bytes] = []
    for block in blocks:
        at = block.rfind(b"\n") + 1
        if not at:
            held.append(block)
            continue
        lines = (b"".join(held) + block[:at - 1]).split(b"\n")
        held = [block[at:]]
        yield from lines
    rest = b"".join(held)
    if rest:
        yield rest


class LineReader(DataSourceStreamReader):
    """Offsets are ``{"file": n, "line": n}``: the next line to be read."""

    def __init__(self, options):
        self.index = options["index"]
        self.per_batch = int(options.get("lines_per_batch", LINES_PER_BATCH))
        self.per_task = int(options.get("lines_per_task", LINES_PER_TASK))
        self.per_step = int(options.get("lines_per_step", 0))
        self.at: dict | None = None
        files = self._table("files").sort_by("file_no").to_pydict()
        self.files = list(zip(files["path"], files["lines"]))

    def _table(self, name: str, **more) -> pa.Table:
        store, inside = _store(f"{self.index}/{name}")
        return pq.read_table(inside, filesystem=store, **more)

    def initialOffset(self) -> dict:
        return {"file": 0, "line": 0}

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        file, line, left = at["file"], at["line"], self.per_batch
        while left and file < len(self.files):
            take = min(left, self.files[file][1] - line)
            line, left = line + take, left - take
            if line == self.files[file][1]:
                file, line = file + 1, 0
        self.at = {"file": file, "line": line}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        if self.at is None:  # a restart plans its last batch once more before it asks for another one
            self.at = end
        out, done = [], 0
        for k in range(start["file"], min(end["file"] + 1, len(self.files))):
            path, lines = self.files[k]
            first = start["line"] if k == start["file"] else 0
            last = end["line"] if k == end["file"] else lines
            if first < last:
                out += self._parts(path, first, last, done)
                done += last - first
        return out

    def _parts(self, path: str, first: int, last: int, done: int = 0) -> list[LineRange]:
        marks = self._table("marks", columns=["line", "byte"], filters=[("path", "=", path), ("line", "<", last)])
        line, byte = (marks.sort_by("line").column(c).to_numpy() for c in ("line", "byte"))
        out = []
        while first < last:
            step = done // self.per_step if self.per_step else 0
            to = min(last, first + self.per_task, *([first + (step + 1) * self.per_step - done] if self.per_step else []))
            k = int(np.searchsorted(line, first, side="right")) - 1
            out.append(LineRange(path, int(byte[k]), first - int(line[k]), first, to, step))
            first, done = to, done + to - first
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        p = partition
        with _open(p.path) as f:
            f.seek(p.byte)
            blocks = iter(lambda: f.read(_READ), b"")
            number, numbers, texts, size = p.first - p.skip, [], [], 0
            for line in split_lines(blocks):
                if number >= p.last:
                    break
                if number >= p.first:
                    numbers.append(number)
                    texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    size += len(line)
                    if size >= _READ or len(texts) >= 10_000:
                        yield self._rows(p, numbers, texts)
                        numbers, texts, size = [], [], 0
                number += 1
            if texts:
                yield self._rows(p, numbers, texts)

    def _rows(self, p: LineRange, numbers: list[int], texts: list[str]) -> pa.RecordBatch:
        columns = [pa.array([p.path] * len(texts)), pa.array(numbers, pa.int64()), pa.array(texts)]
        if not self.per_step:
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        return pa.RecordBatch.from_arrays([*columns, pa.array([p.step] * len(texts), pa.int32())],
                                          schema=_ARROW.append(pa.field("step", pa.int32())))

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA + (", step int" if "lines_per_step" in self.options else "")

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options)


def line_stream(spark: SparkSession, index: str, lines_per_batch: int = LINES_PER_BATCH,
                lines_per_task: int = LINES_PER_TASK, lines_per_step: int | None = None) -> DataFrame:
    """file_name, line_no (from 0) and line of the indexed files, file by file, ``lines_per_batch`` a micro-batch.

    With ``lines_per_step`` also the ``step`` that a line belongs to: its micro-batch's runs of so many lines, from 0.
    """
    spark.dataSource.register(LineSource)
    stream = (spark.readStream.format(SOURCE).option("index", index).option("lines_per_batch", str(lines_per_batch))
              .option("lines_per_task", str(lines_per_task)))
    return (stream.option("lines_per_step", str(lines_per_step)) if lines_per_step else stream).load()


def indexed_files(spark: SparkSession, index: str) -> list[int]:
    """Lines of each indexed file, by its number."""
    return [r.lines for r in spark.read.parquet(f"{index}/files").orderBy("file_no").select("lines").collect()]


def offset_lines(offset: str | dict, lines: list[int]) -> int:
    """Lines before an offset, given the files' line counts in order."""
    at = json.loads(offset) if isinstance(offset, str) else offset
    return sum(lines[:at["file"]]) + at["line"]
