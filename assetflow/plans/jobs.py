"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.operators import inventory, organize, report
from assetflow.shared import path_exists, qualified_path
from assetflow.sources import files as file_sources


_PLANNED = "_planned"  # below the destination; the leading underscore keeps it out of listings


def organize_collection(spark: SparkSession, root: str, destination: str) -> DataFrame:
    """Copy every supported file below ``root`` into category folders; a row per copied file.

    A destination below ``root`` is left out of the scan, so copies are not copied again.

    The plan is kept with the destination and written before anything is copied. A later run plans
    only new files, around all names in use, and copies what is planned and not there yet: new
    files, and those an interrupted or failed run left out.
    """
    target = qualified_path(spark, destination)
    listed = file_sources.scan_files(spark, root).where(~F.startswith("path", F.lit(f"{target}/")))
    found = inventory.classify(listed).withColumn(
        "asset_id", F.lit(0).cast("long")  # a scan lists each path once
    )
    done, present = None, None
    if path_exists(spark, f"{target}/{_PLANNED}"):
        done = spark.read.parquet(f"{target}/{_PLANNED}")
    if path_exists(spark, target):
        present = file_sources.scan_files(spark, target).select("path")
    in_use = None
    if present is not None:
        in_use = present.select(
            F.element_at(F.split("path", "/"), -2).alias("folder"),
            F.element_at(F.split("path", "/"), -1).alias("name"),
        )
    plan = organize.organize_plan(found, done, in_use, target)
    plan.write.mode("append").parquet(f"{target}/{_PLANNED}")
    planned = spark.read.parquet(f"{target}/{_PLANNED}")
    if present is not None:
        planned = planned.join(present, planned.dest == present.path, "left_anti")
    return organize.organize_copy(planned)


def quality_report(classified: DataFrame, timings: DataFrame, excluded: DataFrame) -> DataFrame:
    """The benchmark report next to what the inventory holds, a row per supported type."""
    spark = classified.sparkSession
    types = inventory.category_table(spark).withColumnRenamed("ext", "file_type")
    stock = inventory.count_by_ext(classified).select(
        F.col("ext").alias("file_type"), F.col("num_files").alias("inventory_files"), "total_bytes"
    )
    measured = report.benchmark_report(timings, types.select("file_type"), excluded)
    return (
        types.join(stock, "file_type", "left")
        .fillna(0, subset=["inventory_files", "total_bytes"])
        .join(measured, "file_type")
        .orderBy("file_type")
    )
