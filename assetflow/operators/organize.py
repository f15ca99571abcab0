"""Plan and carry out the copying of files into category folders."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.operators.naming import unique_names
from assetflow.shared import spread, stage
from assetflow.sources.stores import locate, split_uri  # noqa: F401  (split_uri is used from here, too)

_COPIED = "src string, dst string, size_bytes long, ok boolean, error string"


def organize_plan(
    files: DataFrame,
    done: DataFrame | None = None,
    existing: DataFrame | None = None,
    root: str = "",
) -> DataFrame:
    """Where each supported file goes: path, asset_id, folder, name, slot, dest_name, dest.

    ``files`` comes from ``classify`` plus an ``asset_id``. ``done`` is an earlier plan into the
    same place: its sources are not planned again and its names are taken, so planning the same
    files twice gives an empty second plan. ``existing`` has further (folder, name) pairs in use.
    """
    files = files.filter(F.col("folder").isNotNull()).select("path", "asset_id", "folder", "name")
    if done is not None:
        files = files.join(done.select("path", "asset_id"), ["path", "asset_id"], "left_anti")
        planned = done.select("folder", F.col("dest_name").alias("name"))
        existing = planned if existing is None else planned.union(existing.select("folder", "name"))
    return unique_names(files, existing).withColumn(
        "dest", F.concat_ws("/", F.lit(root), "folder", "dest_name")
    )


def _copy_one(src: str, dst: str, stores: dict) -> tuple[int, str | None]:
    partial = target = None
    try:
        source, src_path, _ = locate(src, stores)
        target, dst_path, at_once = locate(dst, stores)
        info = source.get_file_info(src_path)
        if at_once:
            fs.copy_files(src_path, dst_path, source_filesystem=source, destination_filesystem=target)
            return info.size, None
        folder, name = os.path.split(dst_path)
        target.create_dir(folder, recursive=True)
        # Hidden from listings, should the task be killed before it can clean up.
        partial = f"{folder}/_{name}.{uuid.uuid4().hex}.part"
        fs.copy_files(src_path, partial, source_filesystem=source, destination_filesystem=target)
        if isinstance(target, fs.LocalFileSystem) and info.mtime_ns is not None:
            os.utime(partial, ns=(info.mtime_ns, info.mtime_ns))
        target.move(partial, dst_path)
        return info.size, None
    except Exception as exc:  # kept per file: one bad file must not stop the others
        if partial is not None:
            with contextlib.suppress(OSError):
                target.delete_file(partial)
        return 0, f"{type(exc).__name__}: {exc}"


def _copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stores: dict = {}
    for pdf in batches:
        results = [_copy_one(s, d, stores) for s, d in zip(pdf["src"], pdf["dst"])]
        yield pd.DataFrame(
            {
                "src": pdf["src"],
                "dst": pdf["dst"],
                "size_bytes": [size for size, _ in results],
                "ok": [err is None for _, err in results],
                "error": [err for _, err in results],
            }
        )


def organize_copy(plan: DataFrame) -> DataFrame:
    """Copy every planned file in the executors, one result row per file.

    The plan fixes each destination, and a file appears there only when complete, so a task that
    runs twice leaves the same result. Runs when called; the outcome is stored, not repeated.
    """
    work = plan.select(F.col("path").alias("src"), F.col("dest").alias("dst"))
    return stage(spread(work, "src").mapInPandas(_copy_batches, _COPIED), "copied")


def write_by_category(files: DataFrame, path: str) -> None:
    """Write rows as Parquet, one folder per category. No task has to hold a whole category."""
    files.filter(F.col("folder").isNotNull()).write.mode("overwrite").partitionBy("folder").parquet(path)
