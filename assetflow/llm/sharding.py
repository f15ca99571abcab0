"""K-d tree shards: split at weighted medians of the widest metadata dimension, by bytes.

Only DataFrame functions. A node that has to become n shards is cut so that its left part holds
floor(n / 2) of n parts of its bytes. The cut is found by histograms of the sort key, each 13 bits
finer than the one before; the driver gets one row per node and step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.shared import broadcast_if_small, stage

SHARDS = 24
ROW_OVERHEAD = 8
# A dimension is read in 2**20 steps; rows of one step are put in order by 32 bits of a hash.
_CODE_BITS, _TIE_BITS, _STEP_BITS = 20, 32, 13
_KEY_BITS = _CODE_BITS + _TIE_BITS
# Rows numbered in one window.
_SLOT_ROWS = 20_000


@dataclass
class _Node:
    first: int  # its shards are first .. first + shards - 1
    shards: int
    dim: str | None = None
    cut: int | None = None
    left: _Node | None = None
    right: _Node | None = None

    def assign(self) -> Column:
        """First shard of the leaf that a row falls into."""
        if self.left is None:
            return F.lit(self.first)
        goes_left = _key(self.dim) < F.lit(self.cut)
        return F.when(goes_left, self.left.assign()).otherwise(self.right.assign())

    def leaves(self) -> list[_Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), _TIE_BITS) + F.col("_tie")


def _ranks(rows: DataFrame, name: str) -> DataFrame:
    """``value``, ``rank``: the distinct values of a column in order, numbered from 0.

    They are sorted by ranges; the driver and one window get a row per range only.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    values = rows.select(F.col(name).alias("value")).where("value is not null").distinct()
    placed = stage(
        values.repartitionByRange(4 * slots, "value")
        .sortWithinPartitions("value")
        .select(
            "value",
            F.spark_partition_id().alias("range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        ),
        "ranks",
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    return placed.join(F.broadcast(sums), "range").select("value", (F.col("before") + F.col("place")).alias("rank"))


def _numbered(rows: DataFrame, dims: dict[str, str]) -> DataFrame:
    """``rows`` with each dimension as a double that grows with its column: a number itself, a
    string's rank among the column's values; null is below all."""
    kinds = dict(rows.dtypes)
    for dim, name in dims.items():
        if kinds[name] in ("string", "binary"):
            ranks = broadcast_if_small(_ranks(rows, name)).select(
                F.col("value").alias(name), F.col("rank").alias(dim)
            )
            rows = rows.join(ranks, name, "left").withColumn(dim, F.coalesce(F.col(dim), F.lit(-1)).cast("double"))
        else:
            value = F.col(name).cast("double")
            rows = rows.withColumn(dim, F.when(F.isnan(value), None).otherwise(value))
    return rows


def _codes(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Each dimension as 0 .. 2**20 - 1 between its least and greatest value; null is 0."""
    ends = rows.agg(
        *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]
    ).first()
    scaled = {}
    for d in dims:
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        if lo is None or lo == hi:
            scaled[d] = F.lit(0).cast("long")
        else:
            part = (F.col(d) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float((1 << _CODE_BITS) - 1))
            scaled[d] = F.coalesce(F.floor(part), F.lit(0)).cast("long")
    return rows.withColumns(scaled)


def _widest(rows: DataFrame, dims: list[str]) -> dict[int, tuple[str, int]]:
    """For each leaf: its widest dimension and its bytes."""
    spans = rows.groupBy("_leaf").agg(
        F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]
    )
    return {
        r["_leaf"]: (max(dims, key=lambda d: r[d]), r["bytes"]) for r in spans.collect()
    }


def _table(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A few rows, one per leaf, to be joined by leaf."""
    values = ", ".join("(" + ", ".join(map(repr, row)) + ")" for row in rows)
    return F.broadcast(spark.sql(f"select * from values {values} as t({columns})"))


def _cut_all(rows: DataFrame, nodes: list[_Node], goals: dict[int, int], dims: list[str]) -> None:
    """Set each node's cut where the bytes of smaller keys come closest to its goal."""
    spark = rows.sparkSession
    lows = {n.first: 0 for n in nodes}
    below = {n.first: 0 for n in nodes}  # bytes under the low end
    ways = {n.first: dims.index(n.dim) for n in nodes}
    for shift in range(_KEY_BITS - _STEP_BITS, -1, -_STEP_BITS):
        steps = _table(
            spark,
            "_leaf, _way, _low, _below, _goal",
            [(leaf, ways[leaf], lows[leaf], below[leaf], goals[leaf]) for leaf in lows],
        )
        code = F.element_at(F.array(*dims), F.col("_way") + 1)
        place = F.shiftleft(code, _TIE_BITS) + F.col("_tie") - F.col("_low")
        # At most 2**13 rows per leaf.
        bins = (
            rows.join(steps, "_leaf")
            .select("_leaf", "size", "_below", "_goal", place.alias("_place"))
            .where((F.col("_place") >= 0) & (F.col("_place") < F.lit(1 << (shift + _STEP_BITS))))
            .groupBy("_leaf", "_below", "_goal", F.shiftright("_place", shift).alias("_bin"))
            .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        )
        so_far = Window.partitionBy("_leaf").orderBy("_bin")
        crossing = (
            bins.withColumn("_upto", F.sum("_bytes").over(so_far) + F.col("_below"))
            .where("_upto >= _goal")
            .groupBy("_leaf")
            .agg(F.min(F.struct("_bin", "_bytes", "_upto", "_rows")).alias("at"))
        )
        found = {r["_leaf"]: r["at"] for r in crossing.collect()}
        for leaf, at in found.items():
            lows[leaf] += at["_bin"] << shift
            below[leaf] = at["_upto"] - at["_bytes"]
        if all(at["_rows"] == 1 for at in found.values()):
            break
    for node in nodes:
        at, goal = found[node.first], goals[node.first]
        with_it = at["_upto"] - goal < goal - below[node.first]
        node.cut = lows[node.first] + ((1 << shift) if with_it else 0)


def kd_shards(df: DataFrame, dims: list[str], n_shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard``, 0 .. ``n_shards`` - 1, and ``slot``, gapless from 0 in each shard.

    ``df`` has a long ``size``; every column counts for the order of equal keys, and may have any
    name. Columns of ``df`` called shard or slot are replaced. ``dims``: number or string columns,
    strings by their ranks; nulls count as the least value. Rows that are equal in all columns are
    spread by their place in the written table, so no group of copies holds a shard together.
    An empty table gives an empty one. A shard can stay empty when there are few rows.
    """
    dim_cols = [f"_dim{i}" for i in range(len(dims))]
    named = {d: f"_val{i}" for i, d in enumerate(dim_cols)}
    # The columns of df travel in one struct, apart from the engine's own.
    rows = df.select(
        F.struct(*[F.col(_quoted(c)).alias(c) for c in df.columns]).alias("_given"),
        F.col("size"),
        *[F.col(_quoted(c)).alias(v) for v, c in zip(named.values(), dims, strict=True)],
        F.monotonically_increasing_id().alias("_row"),
    )
    # 20 bits of the row's values, then 12 of its place, which only matter among equal rows.
    tie = F.shiftleft(F.xxhash64("_given").bitwiseAND(F.lit((1 << 20) - 1)), 12) + F.xxhash64(
        "_row"
    ).bitwiseAND(F.lit((1 << 12) - 1))
    rows = stage(rows.withColumn("_tie", tie), "shard-rows")
    rows = _codes(stage(_numbered(rows, named).drop(*named.values()), "shard-codes"), dim_cols)

    tree = _Node(0, n_shards)
    while open_nodes := [n for n in tree.leaves() if n.shards > 1]:
        leafed = rows.withColumn("_leaf", tree.assign())
        known = _widest(leafed, dim_cols)
        open_nodes = [n for n in open_nodes if n.first in known]
        if not open_nodes:
            break
        goals = {}
        for node in open_nodes:
            node.dim, total = known[node.first]
            goals[node.first] = total * (node.shards // 2) // node.shards
        _cut_all(leafed, open_nodes, goals, dim_cols)
        for node in open_nodes:
            half = node.shards // 2
            node.left = _Node(node.first, half)
            node.right = _Node(node.first + half, node.shards - half)
    return _with_slots(rows.withColumn("_shard", tree.assign().cast("int")))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard: by parts of a bounded size, and rows within a part."""
    parts = max(1, rows.count() // (SHARDS * _SLOT_ROWS))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_tie", "_row"), F.lit(parts)))
    earlier = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_shard", "_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_shard", "_part").orderBy("_tie", "_row")
    numbered = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    given = [f.name for f in rows.schema["_given"].dataType if f.name.lower() not in ("shard", "slot")]
    return numbered.join(offsets, ["_shard", "_part"]).select(
        *[F.col("_given")[name].alias(name) for name in given],
        F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_place")).cast("long").alias("slot"),
    )


def op6_kd_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        "lang",
        "source",
        "n_chars",
    )
    return kd_shards(rows, ["source", "lang", "n_chars", "doc_id"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
