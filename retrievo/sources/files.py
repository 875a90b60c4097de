"""Text files, one for each row, and whole files read back; names stay in tasks, however many files there are."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from retrievo.session import BATCH_BYTES
from retrievo.sources.index import require_writable

LISTED = 10_000  # names that a task hands on at once


def write_text_files(rows: DataFrame, folder: str, name: str = "file_name", text: str = "text",
                     read_only: bool = False, folders: int = 0) -> int:
    """Write each row's text as a UTF-8 file of the given name under ``folder`` and return the number of files.

    Tasks write their own rows, and a task that runs again replaces what it wrote. Names must be distinct. Rows whose text
    is null have no file. ``folder`` is a URI, so any store that pyarrow knows will do. With ``folders``, a file lies in
    one of so many folders below it, which its name's hash picks: one folder of millions of files is slow to list.
    """
    require_writable(read_only)
    uri = folder if "://" in folder else f"file://{folder}"

    def write(batches):
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        made = {None}
        for batch in batches:
            for file, body, part in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in made:
                    store.create_dir(f"{path}/{part}", recursive=True)
                    made.add(part)
                with store.open_output_stream(f"{path}/{file}" if part is None else f"{path}/{part}/{file}") as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    part = F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(folders)).cast("string") if folders else F.lit(None).cast("string")
    kept = rows.select(F.col(name), F.col(text), part.alias("_part")).filter(F.col(text).isNotNull())
    return kept.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def open_store(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path as Hadoop writes it, the path there, and what the store's paths lack."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/"), "file:"
    store, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return store, path, uri[:len(uri) - len(path)]


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Path of each entry of a folder, and whether it is a folder. A local folder is never held as a whole."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if not e.name.startswith(("_", ".")):
                    yield e.path, e.is_dir()
    else:
        for e in store.get_file_info(fs.FileSelector(folder)):
            if not e.base_name.startswith(("_", ".")):
                yield e.path, e.type == fs.FileType.Directory


def _walk(store: fs.FileSystem, path: str, folder: bool) -> Iterator[tuple[str, bool]]:
    if not folder:
        yield path, False
    else:
        for below, is_folder in _entries(store, path):
            yield from _walk(store, below, is_folder)


def _listing(deep: bool):
    """A task that replaces folders by what they hold, all levels if ``deep``, and hands files on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()),
                                               pa.array([f for _, f in rows], pa.bool_())], names=["path", "folder"])

        rows = []
        for given in batches:
            for uri, folder in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                store, path, before = open_store(uri)
                for found, is_folder in (_walk if deep or not folder else lambda s, p, _: _entries(s, p))(store, path, folder):
                    rows.append((before + found, is_folder))
                    if len(rows) == LISTED:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the files that are not empty, in batches of bounded bytes."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
            (pa.string(), pa.string(), pa.binary()))], names=["path", "file_name", "content"])

    rows, held = [], 0
    for given in batches:
        for uri in given.column(0).to_pylist():
            store, path, _ = open_store(uri)
            with store.open_input_stream(path) as f:
                content = f.read()
            if content:
                rows.append((_ILLEGAL.sub(lambda c: f"%{ord(c[0]):02X}", uri), uri.rsplit("/", 1)[1], content))
                held += len(content)
            if held >= BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
    yield batch(rows)


_ILLEGAL = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\x80-\U0010ffff]")  # in a URI's path, as Java writes it


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files under a folder and the folders below it: path (of a URI), file_name, content.

    ``path`` may also be a file, or a glob of files and folders; ``pattern`` is a glob for names. Names that begin with
    ``_`` or ``.`` and empty files are left out. Folders are listed in tasks, and files are dealt out by their names.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    given = hadoop.Path(path)
    found = list(given.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(given) or [])
    if not found:
        raise FileNotFoundError(path)
    named = hadoop.GlobPattern(pattern).compiled().pattern()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    roots = spark.createDataFrame([(s.getPath().toString(), s.isDirectory()) for s in found], "path string, folder boolean")
    top = roots.mapInArrow(_listing(False), roots.schema).repartition(tasks)
    files = top.mapInArrow(_listing(True), roots.schema).select("path").filter(
        F.substring_index("path", "/", -1).rlike(f"(?s)^(?:{named})$"))
    return files.repartition(tasks).mapInArrow(_read, "path string, file_name string, content binary")
