"""Files as DataFrames: listings and contents.

Files and folders whose names start with ``.`` or ``_`` are left out, as everywhere in Spark.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.functions.text import decode_text
from assetflow.shared import is_folder, new_path, path_exists, qualified_path
from assetflow.sources.stores import locate

# What a task lists before it gives the folders it has not reached back to all tasks.
ENTRIES_AT_ONCE = 20_000
_ENTRY = "path string, size_bytes long, modified_us long, is_folder boolean"


def _listing(files: DataFrame) -> DataFrame:
    # ``content`` is not selected, so no file is opened.
    return files.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")
    )


def _hidden(name: str) -> bool:
    """Names that are left out of listings; ``_key=value`` is a partition's folder."""
    if name.startswith("_"):
        return "=" not in name
    return name.startswith(".") or name.endswith("._COPYING_")


def _entries(folder: str, stores: dict) -> Iterator[tuple[str, int | None, int | None, bool]]:
    """What is directly in a folder; nothing when it is gone meanwhile."""
    store, path, _ = locate(folder, stores)
    if isinstance(store, fs.LocalFileSystem):
        try:
            found = os.scandir(path)
        except FileNotFoundError:
            return
        with found:
            for entry in found:
                if _hidden(entry.name):
                    continue
                try:
                    if entry.is_dir():
                        # A link to a folder above would be followed for ever.
                        above = entry.is_symlink() and os.path.realpath(path).startswith(
                            (os.path.realpath(entry.path) + "/", os.path.realpath(entry.path))
                        )
                        if not above:
                            yield f"{folder}/{entry.name}", None, None, True
                        continue
                    about = entry.stat()
                except OSError:
                    continue
                yield f"{folder}/{entry.name}", about.st_size, about.st_mtime_ns // 1_000_000 * 1000, False
        return
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if _hidden(info.base_name):
            continue
        below = info.type == fs.FileType.Directory
        us = None if below or info.mtime_ns is None else info.mtime_ns // 1_000_000 * 1000
        yield f"{folder}/{info.base_name}", None if below else info.size, us, below


def _list_folders(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk down from each folder; folders left when a task has listed enough are given back."""
    stores: dict = {}
    names = ["path", "size_bytes", "modified_us", "is_folder"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
        )

    seen, rows = 0, []
    for arrived in stream:
        for folder in arrived.column(0).to_pylist():
            todo = [folder]
            while todo:
                if seen >= ENTRIES_AT_ONCE and todo != [folder]:
                    rows += [(f, None, None, True) for f in todo]
                    break
                for entry in _entries(todo.pop(), stores):
                    seen += 1
                    if entry[3]:
                        todo.append(entry[0])
                    else:
                        rows.append(entry)
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
    if rows:
        yield batch(rows)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``, empty ones too: path, size_bytes, modified_at.

    Executors list, in rounds: each task walks down from its folders and gives back those it did not
    reach, which are dealt out anew. Neither files nor folders pass through the driver; what was
    found is stored in the shared folder. A single folder is listed by one task. Runs when called.
    """
    if not path_exists(spark, root):
        raise FileNotFoundError(root)
    found = new_path(spark, "listing")
    if not is_folder(spark, root):
        return _listing(spark.read.format("binaryFile").load(root))
    frontier = spark.createDataFrame([(qualified_path(spark, root).rstrip("/"),)], "path string")
    slots = spark.sparkContext.defaultParallelism
    rounds = 0
    while True:
        listed = frontier.mapInArrow(_list_folders, _ENTRY)
        listed.write.partitionBy("is_folder").parquet(f"{found}/round={rounds}")
        folders = f"{found}/round={rounds}/is_folder=true"
        if not path_exists(spark, folders):
            break
        frontier = spark.read.schema("path string").parquet(folders).repartition(4 * slots, "path")
        rounds += 1
    files = [f"{found}/round={r}/is_folder=false" for r in range(rounds + 1)]
    files = [f for f in files if path_exists(spark, f)]
    schema = "path string, size_bytes long, modified_us long"
    entries = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return entries.select(
        "path", "size_bytes", F.timestamp_micros("modified_us").alias("modified_at")
    )


def scan_by_glob(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files directly in ``root`` that match ``pattern``, ordered by path; only ``root`` is listed."""
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")  # else folders like day=1 are taken for columns
        .option("pathGlobFilter", pattern)
    )
    folder = re.sub(r"([\\*?\[\]{}])", r"\\\1", root.rstrip("/"))
    try:
        files = reader.load(f"{folder}/{pattern}")
    except AnalysisException as nothing:
        if nothing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, size_bytes long, modified_at timestamp")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return _listing(files).filter(parent == qualified_path(spark, root)).orderBy("path")


def read_text_whole(spark: SparkSession, root: str) -> DataFrame:
    """Each file below ``root`` as one text: path, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", decode_text(F.col("content")).alias("text"))


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """Each file below ``root`` as bytes: path, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content")
