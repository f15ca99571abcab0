"""Collision-free names in a destination folder.

The rule is the one of files being copied one after the other, in (path, asset_id) order: a
file keeps its name if that is free, else it gets ``stem_k`` with the smallest free k.

The k-th file of one name normally gets suffix k, which is a ranking. The exception is a file
that really is called ``stem_k``: whichever of the two comes first has the name. Only a name and
its numbered forms can meet in this way, so exceptions are found by a join on names and settled
among distinct names, of which a name's files are only a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.functions import paths
from assetflow.operators.ranking import PART, POS, range_sorted, running_totals, totals_of_sorted
from assetflow.shared import at_most, broadcast_if_small, join_on, stage

_NUMBERED = r"(?s)^(.*)_([1-9][0-9]*)\z"
_TIME = ["_new", "path", "asset_id"]  # what is in the folder already comes first


def unique_names(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Destination names: path, asset_id, folder, name, ``slot`` (0 = unchanged), ``dest_name``.

    ``files`` needs path, asset_id, folder, name; ``existing`` the (folder, name) pairs that are
    taken. Runs when called, see ``rank_rows``.
    """
    rows = files.select("folder", "name", F.lit(1).alias("_new"), "path", "asset_id")
    if existing is not None:
        taken = existing.select("folder", "name").distinct()
        rows = rows.unionByName(
            taken.select(
                "folder",
                "name",
                F.lit(0).alias("_new"),
                F.col("name").alias("path"),
                F.lit(None).cast(files.schema["asset_id"].dataType).alias("asset_id"),
            )
        )
    in_order = range_sorted(rows, ["folder", "name"], _TIME)
    ranked = totals_of_sorted(in_order, ["folder", "name"], {"_k": F.lit(1)}).drop(POS, PART)
    ranked = ranked.withColumn("_k", F.col("_k") - 1)
    name = F.col("name")
    numbered = F.concat(
        paths.stem(name), F.lit("_"), F.col("slot").cast("string"), paths.suffix(name)
    )
    return (
        _with_slots(ranked, in_order)
        .filter(F.col("_new") == 1)
        .select(
            "path",
            "asset_id",
            "folder",
            "name",
            "slot",
            F.when(F.col("slot") == 0, name).otherwise(numbered).alias("dest_name"),
        )
    )


def _with_slots(ranked: DataFrame, in_order: DataFrame) -> DataFrame:
    pairs = _numbered_pairs(in_order)
    if pairs is None:
        return ranked.withColumn("slot", F.col("_k"))

    settled = stage(_settle(stage(_rows_before(in_order, pairs), "name-order")), "names-settled")
    # ``_lost`` = the group's plain name went to a file of the shorter name.
    lost = settled.filter("displaced").select("folder", F.col("child").alias("name"), F.lit(1).alias("_lost"))
    shifted = join_on(ranked, broadcast_if_small(lost), ["folder", "name"], "left").withColumn(
        "_lost", F.coalesce(F.col("_lost"), F.lit(0))
    )
    parents = broadcast_if_small(pairs.select("folder", F.col("parent").alias("name")).distinct())
    simple = join_on(shifted, parents, ["folder", "name"], "left_anti").withColumn(
        "slot", F.col("_k") + F.col("_lost")
    )
    # A slot its child kept is skipped by the file that wanted it and by all later ones.
    crossed = join_on(shifted, parents, ["folder", "name"], "left_semi")
    skips = settled.filter("not displaced").select(
        "folder", F.col("parent").alias("name"), F.col("wanted_by").alias("_k"), F.lit(1).alias("_skip"), "k"
    )
    merged = crossed.withColumn("_skip", F.lit(0)).unionByName(skips, allowMissingColumns=True)
    stepped = running_totals(
        merged.withColumn("_after", 1 - F.col("_skip")),
        ["folder", "name"],
        ["_k", "_after", "k"],
        {"_skipped": F.col("_skip")},
    ).filter(F.col("_after") == 1)
    stepped = stepped.withColumn("slot", F.col("_k") + F.col("_lost") + F.col("_skipped"))
    return simple.unionByName(stepped.select(*simple.columns))


def _numbered_pairs(in_order: DataFrame) -> DataFrame | None:
    """Names ``child`` = ``parent`` + ``_k`` that both occur, where the parent may want slot k.

    ``start`` is the place of the child's first file in ``in_order``. None without such names.
    """
    name = F.col("name")
    # A single file without a number in its name takes no part.
    groups = stage(
        in_order.groupBy("folder", "name")
        .agg(F.count("*").alias("_n"), F.min(POS).alias("start"))
        .withColumn("_stem", paths.stem(name))
        .withColumn("_suffix", paths.suffix(name))
        .withColumn("k", F.regexp_extract("_stem", _NUMBERED, 2).try_cast("long"))
        .filter((F.col("_n") > 1) | F.col("k").isNotNull()),
        "name-groups",
    )
    unnumbered = ["folder", "_stem", "_suffix"]
    children = groups.filter(F.col("k").isNotNull()).select(
        "folder",
        F.regexp_extract("_stem", _NUMBERED, 1).alias("_stem"),
        "_suffix",
        F.col("name").alias("child"),
        "k",
        "start",
    )
    # One name can have most of the children, so parents are matched with their distinct stems.
    parents = groups.select(*unnumbered, F.col("name").alias("parent")).join(
        children.select(*unnumbered).distinct(), unnumbered, "left_semi"
    )
    matched = stage(parents, "name-parents")
    if at_most(matched, 0):
        return None
    pairs = children.join(broadcast_if_small(matched), unnumbered)
    return stage(pairs.drop("_stem", "_suffix"), "name-pairs")


def _rows_before(in_order: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``before``: files of the parent name that come before the child's first file."""
    parents = broadcast_if_small(pairs.select("folder", F.col("parent").alias("name")).distinct())
    files = join_on(in_order.select("folder", "name", *_TIME), parents, ["folder", "name"], "left_semi")
    times = in_order.select(F.col(POS).alias("start"), *_TIME)
    children = times.join(broadcast_if_small(pairs), "start").drop("start")
    merged = (
        files.withColumnRenamed("name", "parent")
        .withColumn("_file", F.lit(1))
        .unionByName(children.withColumn("_file", F.lit(0)), allowMissingColumns=True)
    )
    counted = running_totals(merged, ["folder", "parent"], _TIME, {"before": F.col("_file")})
    return counted.filter(F.col("_file") == 0).select("folder", "parent", "child", "k", "before")


def _settle(pairs: DataFrame) -> DataFrame:
    """Who gets each contested name: ``displaced`` = the parent's file came first.

    ``wanted_by`` is the parent's file that asks for slot k. That is k, less one if the parent's
    first file lost its own name, less the slots below k that were skipped because a child had
    them first. The child is displaced when that file comes before it.

    Skipped slots follow from the outcome for smaller k. Each round bounds their number from both
    sides and settles every pair for which the bounds agree, in all names at once. The smallest
    open k of a name is always among them, and the bounds close in quickly.
    """
    keys = ["folder", "parent"]
    parents = stage(pairs.select(*keys).distinct(), "name-parents")
    rows = range_sorted(pairs, keys, ["k"]).withColumn("state", F.lit("open"))
    while True:
        bounded = _bound_rows(rows, broadcast_if_small(parents))
        state = (
            F.when(F.col("_latest") < F.col("before"), "displaced")
            .when(F.col("_earliest") >= F.col("before"), "kept")
            .otherwise("open")
        )
        rows = stage(bounded.withColumn("state", state).drop("_latest", "_earliest"), "names-settled")
        if at_most(rows.filter(F.col("state") == "open"), 0):
            break
    return _bound_rows(rows, broadcast_if_small(parents)).select(
        *keys,
        "child",
        "k",
        (F.col("state") == "displaced").alias("displaced"),
        F.col("_latest").alias("wanted_by"),
    )


def _bound_rows(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Add the ``_earliest`` and ``_latest`` file of the parent that can ask for slot k."""
    keys = ["folder", "parent"]
    kept = (F.col("state") == "kept").cast("long")
    open_or_kept = (F.col("state") != "displaced").cast("long")
    counted = totals_of_sorted(rows, keys, {"_sure": kept, "_possible": open_or_kept})
    # Parents that are somebody's numbered form may have lost their own name.
    own_name = join_on(
        rows.select("folder", F.col("child").alias("parent"), F.col("state").alias("_own")),
        parents,
        keys,
        "left_semi",
    )
    joined = join_on(counted, broadcast_if_small(own_name), keys, "left")
    own = F.coalesce(F.col("_own"), F.lit("kept"))
    surely_lost = (own == "displaced").cast("long")
    possibly_lost = (own != "kept").cast("long")
    return joined.withColumns(
        {
            "_earliest": F.col("k") - possibly_lost - (F.col("_possible") - open_or_kept),
            "_latest": F.col("k") - surely_lost - (F.col("_sure") - kept),
        }
    ).drop("_sure", "_possible", "_own")
