"""Tabular files with differing columns, and their Parquet cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.shared import path_exists, stage

SOURCES_AT_ONCE = 5_000  # paths the driver hands to one read


def union_stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack frames of one schema."""
    return reduce(DataFrame.unionByName, frames)


def union_ragged(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_sheets(
    spark: SparkSession, layouts: Iterable[tuple[str | list[str], T.StructType | str | None]]
) -> DataFrame:
    """CSV sheets with a header row, stacked by column name, with the file as ``source_id``.

    Each layout is (paths of the files that share it, schema); without a schema the types are
    inferred from those files. One read serves all files of a layout; a file whose header has other
    names or another order is an error, not read by position. Cells may hold line breaks and, in
    quotes, doubled quotes.
    """
    frames = []
    for paths, schema in layouts:
        reader = spark.read.options(
            header=True, recursiveFileLookup=True, multiLine=True, escape='"', enforceSchema=False
        )
        reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
        frames.append(reader.csv(paths).withColumn("source_id", F.col("_metadata.file_path")))
    return union_ragged(frames)


def read_parquet_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of one schema in one read."""
    return spark.read.parquet(*paths)


def nonempty_sources(sheets: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows per listed source, without the sources that have none."""
    rows = sheets.groupBy("source_id").agg(F.count("*").alias("num_rows"))
    return sources.join(rows, "source_id").filter(F.col("num_rows") > 0)


# ------------------------------------------------------------------ cache
#
# data/run_id=<run>/   rows of the sources converted in one run
# manifest/            source_id, num_rows, run_id, columns; written when the run's data is complete

Reader = Callable[[list[str]], DataFrame]  # rows of some sources, each with its source_id


def _paths(cache: str) -> tuple[str, str]:
    return f"{cache}/data", f"{cache}/manifest"


def cache_manifest(spark: SparkSession, cache: str) -> DataFrame:
    """Sources in the cache: source_id, num_rows, run_id, and the run's columns as DDL."""
    schema = "source_id string, num_rows long, run_id string, columns string"
    _, manifest = _paths(cache)
    if not path_exists(spark, manifest):
        return spark.range(0).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)]
        )
    return spark.read.schema(schema).parquet(manifest)


def not_cached(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requested sources without cached output."""
    return sources.select("source_id").distinct().join(manifest, "source_id", "left_anti")


def cache_incremental(
    sources: DataFrame, read: Reader, cache: str, at_once: int = SOURCES_AT_ONCE
) -> int:
    """Add the listed sources that are not cached yet; returns how many were converted.

    For readers of any format; CSV sheets are better converted by ``sheetcache.convert_missing``.
    Only those are opened: ``read`` gets their ids, at most ``at_once`` in a run. A source without
    rows is cached too, with 0 rows. Readers go by the manifest, so the data of an interrupted run
    is never seen and its sources are done again.
    """
    spark = sources.sparkSession
    data, manifest = _paths(cache)
    missing = stage(not_cached(sources, cache_manifest(spark, cache)), "uncached")
    converted = 0
    ids = (row["source_id"] for row in missing.toLocalIterator())
    while some := list(islice(ids, at_once)):
        run = uuid.uuid4().hex
        read(some).write.parquet(f"{data}/run_id={run}")
        written = spark.read.parquet(f"{data}/run_id={run}")
        counts = written.groupBy("source_id").agg(F.count("*").alias("num_rows"))
        listed = spark.createDataFrame([(i,) for i in some], "source_id string")
        listed.join(counts, "source_id", "left").select(
            "source_id",
            F.coalesce("num_rows", F.lit(0).cast("long")).alias("num_rows"),
            F.lit(run).alias("run_id"),
            F.lit(written.schema.toDDL()).alias("columns"),
        ).write.mode("append").parquet(manifest)
        converted += len(some)
    return converted


def common_types(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """For columns whose type differs between runs: double for numbers, else string."""
    kinds: dict[str, set[T.DataType]] = {}
    for schema in schemas:
        for field in schema:
            kinds.setdefault(field.name, set()).add(field.dataType)
    return {
        name: T.DoubleType() if all(isinstance(k, T.NumericType) for k in found) else T.StringType()
        for name, found in kinds.items()
        if len(found) > 1
    }


def read_cached(spark: SparkSession, cache: str) -> DataFrame:
    """All cached rows, columns of all sources; runs of one schema are one read."""
    data, _ = _paths(cache)
    runs = cache_manifest(spark, cache).select("run_id", "columns").distinct().collect()
    paths: dict[str, list[str]] = {}
    for run in runs:
        paths.setdefault(run["columns"], []).append(f"{data}/run_id={run['run_id']}")
    if not paths:
        return spark.createDataFrame([], "source_id string")
    schemas = {ddl: T.StructType.fromDDL(ddl) for ddl in paths}
    common = common_types(list(schemas.values()))
    return union_ragged(
        spark.read.schema(schemas[ddl])
        .parquet(*own)
        .withColumns({f.name: F.col(f.name).cast(common[f.name]) for f in schemas[ddl] if f.name in common})
        for ddl, own in paths.items()
    )


def cache_require(sources: DataFrame, manifest: DataFrame) -> None:
    """Raise when a requested source is not in the cache, with the number of those."""
    missing = not_cached(sources, manifest).count()
    if missing:
        raise RuntimeError(f"{missing} source(s) missing from the cache; build it first")
