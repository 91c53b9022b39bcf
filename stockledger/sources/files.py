"""Files of a folder as rows: listed and read by tasks, so the driver never holds their names.

Spark's ``binaryFile`` reader keeps every file's status, and every file again in the
tasks of each read, on the driver: over 1 KB a file.  Here the driver holds folders only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stockledger.session import scratch_path

# levels of folders that are opened one after the other to find enough to deal out
LEVELS = 4
# rows of a batch of the listing
LISTED_ROWS = 10_000
# bytes of contents that a task holds, besides those of its last file
CONTENT_BYTES = 8 * 1024 * 1024

# (path, is a folder, length, milliseconds of the last change)
Entry = tuple[str, bool, int, int]
LISTED = "path string, length bigint, ms bigint"


def passed_over(name: str, folder: bool) -> bool:
    """Names that Spark's readers pass over."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def taken(e: Entry) -> bool:
    """Whether Spark's readers take it: they pass over hidden names and files of no bytes."""
    return not passed_over(e[0].rsplit("/", 1)[-1], e[1]) and (e[1] or e[2] > 0)


def entries(store: fs.FileSystem, folder: str) -> Iterator[Entry]:
    """What a folder has and Spark's readers take; a local folder is read entry by entry, another store gives all of a folder at once."""
    found = _local(folder) if isinstance(store, fs.LocalFileSystem) else (
        (i.path, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000)
        for i in store.get_file_info(fs.FileSelector(folder)))
    return filter(taken, found)


def _local(folder: str) -> Iterator[Entry]:
    with os.scandir(folder) as found:
        for e in found:
            try:
                e.name.encode()
                at = e.stat()
            except (UnicodeEncodeError, FileNotFoundError):     # a name that Java cannot read; gone since, or a link to nothing
                continue
            yield e.path, e.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000


def _below(store: fs.FileSystem, folder: str) -> Iterator[Entry]:
    """The files at any depth below a folder."""
    todo = [folder]
    while todo:
        for e in entries(store, todo.pop()):
            if e[1]:
                todo.append(e[0])
            else:
                yield e


def _dealt(spark: SparkSession, at: str, items: list, tasks: int, work: Callable[[fs.FileSystem, object], Iterator[Entry]]) -> DataFrame:
    """``LISTED`` rows of what ``work`` gives for the items, which are dealt to at most ``tasks`` tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(at)
        rows: list[Entry] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()),
                                              pa.array([r[3] for r in rows], pa.int64())], ["path", "length", "ms"])
            rows.clear()
            return out

        for b in batches:
            for i in b.column("id").to_pylist():
                for e in work(store, items[i]):
                    rows.append(e)
                    if len(rows) == LISTED_ROWS:
                        yield batch()
        yield batch()

    return spark.range(0, len(items), 1, max(1, min(len(items), tasks))).mapInArrow(run, LISTED)


@dataclass(frozen=True)
class Store:
    """``at``: its URI for pyarrow; ``before``: what stands before its own paths; ``roots``: what a path or its pattern names in it."""
    at: str
    before: str
    roots: list[Entry]


def opened(spark: SparkSession, path: str) -> Store | None:
    """The store of ``path``, or None where nothing is there or only Hadoop reaches it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    roots = [(x.getPath().toString(), x.isDirectory(), x.getLen(), x.getModificationTime()) for x in there or []]
    if not roots:
        return None
    first = roots[0][0]
    uri = quote(re.sub(r"^file:/+", "file:///", first), safe="/:@")
    try:
        store, base = fs.FileSystem.from_uri(uri)
        if not first.endswith(base) or store.get_file_info(base).type == fs.FileType.NotFound:
            return None
    except (pa.ArrowException, OSError):
        return None
    before = first.removesuffix(base)
    return Store(uri, before, [(p.removeprefix(before), *rest) for p, *rest in roots])


def listed(spark: SparkSession, store: Store, tasks: int) -> DataFrame:
    """(path, length, modificationTime) of the files at any depth below a store's roots, as Spark's ``binaryFile`` reader
    lists them: once, now; hidden files and files of no bytes are left out.

    Folders are opened by tasks, level by level, until there are enough to deal out, and then listed with all below them
    by at most ``tasks`` tasks, into a table in the scratch folder.
    """
    done, level = [], [p for p, folder, *_ in store.roots if folder]
    for _ in range(LEVELS):
        if not level or len(level) >= tasks:
            break
        below = _dealt(spark, store.at, level, tasks, lambda s, p: (e for e in entries(s, p) if e[1]))
        done, level = done + level, [r.path for r in below.select("path").collect()]
    items = [(p, False) for p in done] + [(p, True) for p in level] + [(e, None) for e in store.roots if taken(e) and not e[1]]

    def work(s: fs.FileSystem, item: tuple) -> Iterator[Entry]:
        at, deep = item
        return iter([at]) if deep is None else _below(s, at) if deep else (e for e in entries(s, at) if not e[1])

    files = _dealt(spark, store.at, items, tasks, work)
    if len(store.roots) > 1:      # one may lie in another
        files = files.dropDuplicates(["path"])
    files.write.parquet(kept := scratch_path(spark, "listing"))
    return spark.read.schema(LISTED).parquet(kept).select(
        F.concat(F.lit(store.before), "path").alias("path"), "length", F.timestamp_millis("ms").alias("modificationTime"))


def with_content(files: DataFrame, store: Store, tasks: int) -> DataFrame:
    """``files`` that ``listed`` gave with their bytes as ``content``, dealt to ``tasks`` tasks by name.

    A batch ends with the file that brings it to ``CONTENT_BYTES``.
    """
    at, before, cols = store.at, store.before, files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, _ = fs.FileSystem.from_uri(at)
        for b in batches:
            begin, size, held = 0, 0, []
            for i, name in enumerate(b.column("path").to_pylist(), 1):
                with s.open_input_stream(name.removeprefix(before), compression=None) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= CONTENT_BYTES or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(begin, i - begin).columns, pa.array(held, pa.binary())], [*cols, "content"])
                    begin, size, held = i, 0, []

    return files.repartition(tasks, "path").mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))
