"""Connected components of a graph given as a table of links, without gathering a group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.shared import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the least of u and its v; a hot u is summed up before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("_m")).select(
        F.col("u").alias("_u"), F.least("_m", "u").alias("_m")
    )


def _star(pairs: DataFrame) -> DataFrame:
    return pairs.join(_least(pairs), F.col("u") == F.col("_u"))


def _fingerprint(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), total).first())


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node that each linked node can reach. ``links``: u, v.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones,
    are linked to the least neighbour, until the links are stars. Rounds grow with the logarithm of
    the graph, also for long chains; every round is written to the shared folder.
    """
    current = stage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u != v")
        .distinct(),
        "links",
    )
    before = _fingerprint(current)
    while before[0]:
        large = (
            _star(_both_ways(current))
            .where("v > u and v != _m")
            .select(F.col("v").alias("u"), F.col("_m").alias("v"))
            .distinct()
        )
        # Links now point from a larger node to a smaller one.
        small = _star(large)
        current = stage(
            small.select("u", F.col("_m").alias("v"))
            .union(small.select(F.col("v").alias("u"), F.col("_m").alias("v")))
            .where("u != v")
            .distinct(),
            "links",
        )
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
