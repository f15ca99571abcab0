"""Reports and logs on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.operators.report import REPORT_SCHEMA
from assetflow.shared import path_exists


def write_report_csv(report: DataFrame, path: str) -> None:
    """Report as CSV with a header. Reports have a row per type, so one file is enough."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report written before; empty ratios are null."""
    return spark.read.schema(REPORT_SCHEMA).csv(path, header=True)


def load_or_make_report(spark: SparkSession, path: str, make, reuse: bool) -> DataFrame:
    """The stored report when ``reuse`` is set and there is one, else a new one, stored."""
    if not (reuse and path_exists(spark, path)):
        write_report_csv(make(), path)
    return read_report_csv(spark, path)


def append_failure_log(failures: DataFrame, path: str, run_id: str) -> None:
    """Add the files of failed batches to a log that is kept across runs.

    A run's entries form one partition, so logging a run again does not double them.
    """
    (
        failures.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_failure_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
