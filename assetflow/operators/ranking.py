"""Positions and running totals that stay parallel when one key holds most of the rows.

A window over the key alone puts each key in one task. Here rows are range-partitioned by key
*and* order and written out once, so a big key spans many partitions. Each row then needs only
its place inside its partition plus what earlier partitions of the same key add up to, and
there are never more of those sums than a few per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.shared import MAX_BROADCAST_ROWS, at_most, join_on, stage

POS = "_pos"  # increases through the whole range-sorted table
PART = "_part"  # partition a row was sorted in
_POS_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def range_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Write ``df`` sorted by keys and order; adds ``POS``, increasing in that order, and ``PART``."""
    cols = [*keys, *order]
    ranged = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn(POS, F.monotonically_increasing_id())
    )
    # Written, so that counting and numbering see the same partitions.
    return stage(ranged, "ranked").withColumn(PART, F.shiftright(POS, _POS_BITS))


def _earlier(keys: Sequence[str]):
    return (
        Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    )


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out`` = 1, 2, ... in ``order`` within ``keys``; ``order`` must be unique per key.

    Runs when called: the sorted rows are written to the shared folder. Select the columns
    needed before calling. For keys that are as many as the rows, use ``running_totals``.
    """
    rows = range_sorted(df, keys, order)
    runs = rows.groupBy(PART, *keys).agg(F.min(POS).alias("_first"), F.count("*").alias("_n"))
    if not at_most(runs, MAX_BROADCAST_ROWS):
        return totals_of_sorted(rows, keys, {out: F.lit(1)}).drop(POS, PART)
    earlier_rows = F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0))
    base = runs.select(PART, *keys, (earlier_rows - F.col("_first") + 1).alias("_base"))
    return (
        join_on(rows, F.broadcast(base), [PART, *keys])
        .withColumn(out, F.col(POS) + F.col("_base"))
        .drop(POS, PART, "_base")
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """Add running sums in ``order`` within ``keys``: ``{output name: value to add up}``.

    Works at any number and size of keys. Runs when called, like ``rank_rows``.
    """
    return totals_of_sorted(range_sorted(df, keys, order), keys, totals).drop(POS, PART)


def _of_split_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that may span partitions: a partition's first and last key, two for each."""
    if not keys:
        return rows
    ends = rows.groupBy(PART).agg(F.min(POS).alias("_lo"), F.max(POS).alias("_hi"))
    places = ends.select(F.explode(F.array("_lo", "_hi")).alias(POS))
    split_keys = rows.join(F.broadcast(places), POS, "left_semi").select(*keys).distinct()
    return join_on(rows, F.broadcast(split_keys), keys, "left_semi")


def totals_of_sorted(
    rows: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]
) -> DataFrame:
    """``running_totals`` of what ``range_sorted`` returned; keeps ``POS`` and ``PART``."""
    so_far = (
        Window.partitionBy(PART, *keys)
        .orderBy(POS)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = [F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    runs = _of_split_keys(rows, keys).groupBy(PART, *keys).agg(*sums)
    offsets = runs.select(
        PART,
        *keys,
        *[F.sum(f"_sum_{name}").over(_earlier(keys)).alias(f"_off_{name}") for name in totals],
    )
    local = rows.withColumns({name: F.sum(value).over(so_far) for name, value in totals.items()})
    return (
        join_on(local, F.broadcast(offsets), [PART, *keys], "left")
        .withColumns(
            {
                name: F.col(name) + F.coalesce(F.col(f"_off_{name}"), F.lit(0))
                for name in totals
            }
        )
        .drop(*[f"_off_{name}" for name in totals])
    )
