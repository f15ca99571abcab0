"""What is in a collection: types, categories, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.constants import CATEGORY_BY_EXT
from assetflow.functions import paths


def classify(files: DataFrame) -> DataFrame:
    """Add ``name``, ``ext`` (null when unsupported) and ``folder`` from ``path``."""
    return (
        files.withColumn("name", paths.file_name(F.col("path")))
        .withColumn("ext", paths.supported_extension(F.col("path")))
        .withColumn("folder", paths.category(F.col("ext")))
    )


def supported(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("ext").isNotNull())


def unsupported(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("ext").isNull())


def category_table(spark: SparkSession) -> DataFrame:
    """The extension -> folder dimension; five rows."""
    rows = ", ".join(f"('{ext}', '{folder}')" for ext, folder in CATEGORY_BY_EXT.items())
    return spark.sql(f"select * from values {rows} as t(ext, folder)")


def count_by_ext(classified: DataFrame) -> DataFrame:
    """Files and bytes per supported extension; needs ``size_bytes``."""
    return (
        supported(classified)
        .groupBy("ext")
        .agg(F.count("*").alias("num_files"), F.sum("size_bytes").alias("total_bytes"))
    )


def max_group_size(rows: DataFrame, *keys: str) -> DataFrame:
    """Size of the largest group, 0 without rows; one row."""
    return rows.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_group_size"))


def split(rows: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """Rows where ``good`` holds and all others; a null condition counts as not good."""
    flag = F.coalesce(good, F.lit(False))
    return rows.filter(flag), rows.filter(~flag)
