"""Fixed-size batches of files and progress through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.constants import BATCH_SIZE, PROGRESS_EVERY
from assetflow.operators.ranking import rank_rows

_BLOCK = 10_000  # batches listed by one row before they are spread out
_NATIVE_TOP_N = 1000  # Spark prunes row_number() <= n before the shuffle up to here


def batch_assign(
    files: DataFrame, groups: Sequence[str], order: Sequence[str], size: int = BATCH_SIZE
) -> DataFrame:
    """Add ``batch_id`` 0, 1, ... : consecutive files of one group, ``size`` to a batch.

    Give the codec as a group to keep batches of one codec.
    """
    return rank_rows(files, groups, order, "_rn").withColumn(
        "batch_id", F.floor((F.col("_rn") - 1) / size)
    ).drop("_rn")


def batch_sizes(files: DataFrame, groups: Sequence[str], size: int = BATCH_SIZE) -> DataFrame:
    """Files in each batch of each group, the short last one included.

    Follows from the group counts alone, so no file is ranked or moved.
    """
    last = F.floor((F.col("_n") - 1) / size)
    blocks = (
        files.groupBy(*groups)
        .agg(F.count("*").alias("_n"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(last / _BLOCK))))
        .repartition(*groups, "_block")
    )
    first = F.col("_block") * _BLOCK
    return blocks.withColumn(
        "batch_id", F.explode(F.sequence(first, F.least(first + _BLOCK - 1, last)))
    ).select(
        *groups,
        "batch_id",
        F.least(F.lit(size), F.col("_n") - F.col("batch_id") * size).cast("long").alias("n_files"),
    )


def progress_marks(
    files: DataFrame,
    groups: Sequence[str],
    size: int = BATCH_SIZE,
    every: int = PROGRESS_EVERY,
) -> DataFrame:
    """Files done after each batch, kept for the batches that just passed a multiple of ``every``."""
    done = F.col("batch_id") * size + F.col("n_files")
    return (
        batch_sizes(files, groups, size)
        .withColumn("processed", done)
        .filter(F.col("processed") % every < size)
    )


def first_n(files: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` files of each group, with their position ``rn``.

    For small ``n``, every task that reads files keeps only the first ``n`` of each group, parts
    of a group keep theirs, and what is left is ranked.
    """
    if n > _NATIVE_TOP_N:
        return rank_rows(files, groups, order, "rn").filter(F.col("rn") <= n)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def firsts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("rn", position.cast("long")).filter(F.col("rn") <= n)

    in_parts = files.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    return firsts(firsts(in_parts, [*groups, "_part"]).drop("_part"), groups)
