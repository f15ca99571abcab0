"""CSV sheets converted to Parquet by the executors, file by file, and only once.

    data/<layout>/<name>.parquet   rows of one or more files that have the same columns and types
    manifest/                      path, source_id, num_rows, file, columns, error, run_id

Files are packed into tasks by bytes. A task reads a file twice, as inference does: first every
cell as text, which settles the types and finds what is broken, then to write typed columns. A file
that cannot be read is noted with its error, leaves no rows and is tried again by the next run. The
manifest is the only Spark write of a run. Data that it does not name, as of lost or repeated tasks, is
never read.
"""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.shared import broadcast_if_small, path_exists, qualified_path, stage
from assetflow.sources.sheets import common_types, union_ragged
from assetflow.sources.stores import locate

# What a task converts, and how many tasks a run has at most; a file counts for its size and some more.
TASK_BYTES, MAX_TASKS, FILE_BYTES = 128 << 20, 20_000, 64 << 10
# A row must fit a block; the next larger one is tried when it does not.
BLOCK_BYTES = (16 << 20, 256 << 20, 1 << 30)
BUFFER_BYTES, OPEN_FILES = 32 << 20, 16

MANIFEST = "path string, source_id string, num_rows long, file string, columns string, error string, run_id string"
# Types in the order they are tried: Spark's name, Arrow's type, how a cell looks.
_KINDS = (
    ("bigint", pa.int64(), r"^-?[0-9]{1,18}$"),
    ("double", pa.float64(), r"^-?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    ("date", pa.date32(), r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp_ntz", pa.timestamp("us"), r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?$"),
    ("boolean", pa.bool_(), r"^(?i:true|false)$"),
)


def _header(stream) -> list[str]:
    """Column names; none for a file without a row."""
    names = next(csv.reader(io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")), [])
    lowered = [n.lower() for n in names]
    if len(set(lowered)) < len(names) or "" in names:
        raise ValueError(f"columns without a name or of one name: {names}")
    if "source_id" in lowered:
        raise ValueError("a column is called source_id")
    return names


def _cells(open_file, names: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """The rows below the header, every cell as text; cells may hold line breaks."""
    yield from pcsv.open_csv(
        open_file(),
        read_options=pcsv.ReadOptions(
            column_names=names, skip_rows_after_names=1, block_size=block, use_threads=False
        ),
        parse_options=pcsv.ParseOptions(newlines_in_values=True),
        convert_options=pcsv.ConvertOptions(
            column_types=dict.fromkeys(names, pa.string()),
            null_values=[""],
            strings_can_be_null=True,
            quoted_strings_can_be_null=False,
        ),
    )


def _fits(cells: pa.Array, kind: tuple) -> bool:
    if not pc.all(pc.match_substring_regex(cells, kind[2])).as_py():
        return False
    try:
        cells.cast(kind[1])
    except pa.ArrowInvalid:  # no such day, or a number beyond the type
        return False
    return True


def _infer(open_file, names: list[str], block: int) -> tuple[int, list[tuple | None]]:
    """(rows, kind of each column); text where no kind fits all cells or there are none."""
    rows, possible, seen = 0, [list(_KINDS) for _ in names], [False] * len(names)
    for batch in _cells(open_file, names, block):
        rows += len(batch)
        for i, cells in enumerate(batch.columns):
            cells = cells.drop_null()
            if len(cells):
                seen[i] = True
                possible[i] = [k for k in possible[i] if _fits(cells, k)]
    return rows, [p[0] if p and s else None for p, s in zip(possible, seen, strict=True)]


class _Outputs:
    """The Parquet files of a task, one open file for each of a bounded number of layouts."""

    def __init__(self, folder: str, stores: dict):
        self.folder, self.stores = folder, stores
        self.open: dict[str, list] = {}  # columns: name, stream, writer, buffered tables, their bytes

    def add(self, columns: str, table: pa.Table) -> str:
        if columns not in self.open:
            if len(self.open) >= OPEN_FILES:
                self._close(next(iter(self.open)))
            name = f"{uuid.uuid4().hex}.parquet"
            store, path, _ = locate(f"{self.folder}/{layout_of(columns)}/{name}", self.stores)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            stream = store.open_output_stream(path)
            self.open[columns] = [name, stream, pq.ParquetWriter(stream, table.schema), [], 0]
        out = self.open[columns]
        out[3].append(table)
        out[4] += table.nbytes
        if out[4] >= BUFFER_BYTES:
            self._flush(out)
        return out[0]

    def _flush(self, out: list) -> None:
        if out[3]:
            out[2].write_table(pa.concat_tables(out[3]))
        out[3], out[4] = [], 0

    def _close(self, columns: str) -> None:
        out = self.open.pop(columns)
        self._flush(out)
        out[2].close()
        out[1].close()

    def close(self) -> None:
        for columns in list(self.open):
            self._close(columns)


def layout_of(columns: str) -> str:
    """Folder of the files with these columns."""
    return hashlib.sha256(columns.encode()).hexdigest()[:32]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _convert_file(source_id: str, open_file, outputs: _Outputs) -> tuple[int, str | None, str]:
    """(rows, names of the files they are in, columns)."""
    names = _header(open_file())
    if not names:
        return 0, None, "source_id string"
    for block in BLOCK_BYTES:
        try:
            rows, kinds = _infer(open_file, names, block)
            break
        except pa.ArrowInvalid as wrong:
            if "straddling" not in str(wrong) or block == BLOCK_BYTES[-1]:
                raise
    columns = ", ".join(
        ["source_id string", *[f"{_quoted(n)} {k[0] if k else 'string'}" for n, k in zip(names, kinds, strict=True)]]
    )
    written = set()
    for batch in _cells(open_file, names, block) if rows else ():
        arrays = [pa.repeat(source_id, len(batch))]
        arrays += [c.cast(k[1]) if k else c for c, k in zip(batch.columns, kinds, strict=True)]
        written.add(outputs.add(columns, pa.table(arrays, names=["source_id", *names])))
    return rows, ",".join(sorted(written)) or None, columns


def _converter(folder: str, run: str):
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    types = [pa.int64() if n == "num_rows" else pa.string() for n in names]

    def convert(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict = {}
        outputs = _Outputs(folder, stores)
        done = []
        for batch in stream:
            for path, source_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, own, _ = locate(path, stores)
                try:
                    found = (*_convert_file(source_id, lambda s=store, o=own: s.open_input_stream(o), outputs), None)
                except (pa.ArrowInvalid, ValueError, csv.Error, FileNotFoundError) as wrong:
                    found = (None, None, None, f"{type(wrong).__name__}: {wrong}"[:500])
                done.append((path, source_id, *found, run))
        # A row of the manifest says that its data is complete.
        outputs.close()
        for at in range(0, len(done), 10_000):
            columns = zip(*done[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    return convert


def _packed(files: DataFrame) -> DataFrame:
    """``files`` in partitions of about equal bytes, by the running sum of their sizes."""
    spark = files.sparkSession
    weighed = stage(
        files.withColumn("weight", F.col("size_bytes") + F.lit(FILE_BYTES)).withColumn(
            "part", F.spark_partition_id()
        ),
        "unconverted",
    )
    sums = weighed.groupBy("part").agg(F.sum("weight").alias("bytes"))  # a row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    total = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    each = max(TASK_BYTES, -(-total // MAX_TASKS))
    # Files of a task are not enough to keep all slots busy when there is little to do.
    each = max(1, min(each, -(-total // spark.sparkContext.defaultParallelism)))
    inside = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("before") + F.coalesce(F.sum("weight").over(inside), F.lit(0))
    tasks = max(1, -(-total // each))
    placed = weighed.join(F.broadcast(before), "part").withColumn("task", F.floor(starts / F.lit(each)).cast("int"))
    return placed.repartitionById(tasks, F.col("task")).select("path", "source_id")


def manifest(spark: SparkSession, cache: str) -> DataFrame:
    """A row per converted file, and per attempt at one that failed (``error``)."""
    path = f"{cache}/manifest"
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def missing_files(files: DataFrame, cache: str) -> DataFrame:
    """The listed files that are not in the cache: path, source_id, size_bytes, each path once.

    Without a ``source_id``, and where it is null, it is the path; rows without a path are left out.
    """
    spark = files.sparkSession
    label = F.coalesce("source_id", "path") if "source_id" in files.columns else F.col("path")
    listed = (
        files.where("path is not null")
        .select("path", label.alias("source_id"), "size_bytes")
        .groupBy("path")
        .agg(F.min("source_id").alias("source_id"), F.coalesce(F.max("size_bytes"), F.lit(0)).alias("size_bytes"))
    )
    done = manifest(spark, cache).where("error is null").select("path")
    return listed.join(done, "path", "left_anti")


def convert_missing(files: DataFrame, cache: str) -> int:
    """Convert the listed files that are not in the cache yet; returns how many were.

    ``files`` as ``scan_files`` lists them, with an optional ``source_id``. Nothing of the listing
    passes through the driver, files in the cache are not opened, and one without rows is cached
    with 0 rows. Empty lists convert nothing.
    """
    spark = files.sparkSession
    run = uuid.uuid4().hex
    folder = f"{qualified_path(spark, cache)}/data"
    seen = Observation("converted")
    results = _packed(missing_files(files, cache)).mapInArrow(_converter(folder, run), MANIFEST)
    results.observe(seen, F.count_if(F.col("error").isNull()).alias("n")).write.mode("append").parquet(
        f"{cache}/manifest"
    )
    return seen.get["n"]


def failures(spark: SparkSession, cache: str) -> DataFrame:
    """Files that no run could convert, with the error of each attempt."""
    tried = manifest(spark, cache)
    done = tried.where("error is null").select("path")
    return tried.where("error is not null").join(done, "path", "left_anti").select("path", "source_id", "run_id", "error")


def read_converted(spark: SparkSession, cache: str) -> DataFrame:
    """All cached rows by column name, with their ``source_id``.

    A column whose type differs between files is double where all are numbers, else string. The
    driver gets the distinct layouts only; each is one scan that reads the wanted columns.
    """
    done = manifest(spark, cache).where("file is not null")
    names = done.select("columns", F.explode(F.split("file", ",")).alias("__file")).distinct()
    layouts = [r["columns"] for r in names.select("columns").distinct().orderBy("columns").collect()]
    if not layouts:
        return spark.createDataFrame([], "source_id string")
    schemas = [T.StructType.fromDDL(columns) for columns in layouts]
    common = common_types(schemas)
    frames = []
    for columns, schema in zip(layouts, schemas, strict=True):
        rows = spark.read.schema(schema).parquet(f"{cache}/data/{layout_of(columns)}")
        own = broadcast_if_small(names.where(F.col("columns") == columns).select("__file"))
        kept = rows.withColumn("__name", F.col("_metadata.file_name")).join(own, F.col("__name") == F.col("__file"), "left_semi")
        frames.append(
            kept.select(*[F.col(_quoted(f.name)).cast(common.get(f.name, f.dataType)).alias(f.name) for f in schema])
        )
    return union_ragged(frames)


def require(files: DataFrame, cache: str) -> None:
    """Raise when a listed file is not in the cache, with the number of those."""
    missing = missing_files(files, cache).count()
    if missing:
        raise RuntimeError(f"{missing} file(s) missing from the cache; convert them first")
