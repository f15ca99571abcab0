"""Hard negatives by Strassen products of integer tiles.

Anchors meet all rows in a grid of blocks: a block of anchors and a block of rows come together in
one task, which multiplies their tiles by Strassen's recursion and keeps, for every anchor, a heap of
its best positives, then, for every anchor and positive, a heap of the best rows inside the score
window. Heaps of different blocks merge into those of all rows: the best of the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.shared import new_path, stage

POSITIVES, NEGATIVES = 5, 3
# A negative's score is at least 50 % and at most 95 % of the positive's.
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
# Bytes of int64 cells of a block; both blocks of a task are held in memory.
BLOCK_BYTES = 8 << 20
TILE_ROWS = 256
# Recursion stops when a side of the product is no longer than this.
LEAF = 16

_BLOCK = ["uid", "id", "label", "vector"]
_FOUND = "anchor long, place int, uid long, id long, score long"
_NONE = pa.table({"anchor": [], "place": [], "uid": [], "id": [], "score": []}, pa.schema(
    [("anchor", pa.int64()), ("place", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]
))


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices with seven products of halves in place of eight.

    Odd sides are padded with zeros. Sums are exact as long as the result fits 64 bits, even where
    one on the way wraps around.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Block:
    """Rows as arrays, in order of (id, uid) with null ids last, cells padded with zeros."""

    def __init__(self, table: pa.Table):
        ids, uids = table["id"], table["uid"].to_numpy()
        missing = ids.is_null().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((uids, ids, missing))
        self.ids, self.missing, self.uids = ids[order], missing[order], uids[order]
        self.labels = table["label"].to_numpy()[order]
        vectors = table["vector"].combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        self.cells = np.zeros((len(ids), max(sizes, default=0)), np.int64)
        row = np.repeat(np.arange(len(ids)), sizes)
        column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.cells[row, column] = np.floor(SCALE * vectors.flatten().to_numpy())
        self.cells = self.cells[order]
        self.order = order

    def __len__(self) -> int:
        return len(self.ids)


class Heaps:
    """For each of ``n`` keys, its ``k`` best (score, place): high scores first, then low places."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.keys = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)
        self.places = np.empty(0, np.int64)
        # The least score that can still enter.
        self.least = np.full(n, np.iinfo(np.int64).min)

    def offer(self, keys: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        """Take in further entries; a heap and new ones merge to the best of both."""
        keys = np.concatenate([self.keys, keys])
        scores = np.concatenate([self.scores, scores])
        places = np.concatenate([self.places, places])
        order = np.lexsort((places, -scores, keys))
        keys, scores, places = keys[order], scores[order], places[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
        kept = rank < self.k
        self.keys, self.scores, self.places = keys[kept], scores[kept], places[kept]
        full = rank == self.k - 1
        self.least[keys[full]] = scores[full]


def _tiles(anchors: Block, rows: Block) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Every product of a tile of anchors and a tile of rows."""
    wide = max(anchors.cells.shape[1], rows.cells.shape[1])
    left = np.pad(anchors.cells, ((0, 0), (0, wide - anchors.cells.shape[1])))
    right = np.pad(rows.cells, ((0, 0), (0, wide - rows.cells.shape[1]))).T
    for i in range(0, len(anchors), TILE_ROWS):
        some = slice(i, min(i + TILE_ROWS, len(anchors)))
        for j in range(0, len(rows), 2 * TILE_ROWS):
            others = slice(j, min(j + 2 * TILE_ROWS, len(rows)))
            yield some, others, strassen(left[some], np.ascontiguousarray(right[:, others]))


def _best_positives(anchors: Block, rows: Block, k: int) -> Heaps:
    heaps = Heaps(len(anchors), k)
    for some, others, scores in _tiles(anchors, rows):
        fits = anchors.labels[some, None] == rows.labels[others]
        fits &= anchors.uids[some, None] != rows.uids[others]
        fits &= scores >= heaps.least[some, None]
        at, to = np.nonzero(fits)
        heaps.offer(at + some.start, scores[at, to], to + others.start)
    return heaps


def _best_negatives(
    anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, k: int
) -> Heaps:
    """A heap per anchor and positive, whose key is anchor * positives + positive."""
    width = low.shape[1]
    heaps = Heaps(low.size, k)
    for some, others, scores in _tiles(anchors, rows):
        other = anchors.labels[some, None] != rows.labels[others]
        for p in range(width):
            keys = np.arange(some.start, some.stop) * width + p
            fits = scores >= np.maximum(low[some, p], heaps.least[keys])[:, None]
            fits &= scores <= high[some, p, None]
            fits &= other
            at, to = np.nonzero(fits)
            heaps.offer(keys[at], scores[at, to], to + others.start)
    return heaps


def _found(heaps: Heaps, anchors: Block, rows: Block, width: int) -> pa.Table:
    to = heaps.places
    return pa.table(
        {
            "anchor": pa.array(anchors.uids[heaps.keys // width], pa.int64()),
            "place": pa.array(heaps.keys % width, pa.int32()),
            "uid": pa.array(rows.uids[to], pa.int64()),
            "id": pa.array(rows.ids[to], pa.int64(), mask=rows.missing[to]),
            "score": pa.array(heaps.scores, pa.int64()),
        }
    )


def _windows(table: pa.Table, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative per anchor and positive; no score fits without one.

    ``low * positive <= 100 * score <= high * positive``, without products that could overflow.
    """
    lists = table["positives"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    scores = lists.flatten().to_numpy()
    low = np.full((len(sizes), width), np.iinfo(np.int64).max)
    high = np.full((len(sizes), width), np.iinfo(np.int64).min)
    whole, rest = scores // 100, scores % 100
    low[row, column] = LOW_PERCENT * whole - (-LOW_PERCENT * rest // 100)
    high[row, column] = HIGH_PERCENT * whole + HIGH_PERCENT * rest // 100
    return low[order], high[order]


def _blocks(cells: int) -> int:
    """Number of blocks of ``BLOCK_BYTES`` that so many int64 cells fill."""
    return max(1, math.ceil(cells * 8 / BLOCK_BYTES))


def _usable(df: DataFrame, id: str, vector: str, label: Column, is_anchor: Column) -> DataFrame:
    """uid, id, label, vector and is_anchor of the rows that take part."""
    cells = F.col(vector).cast("array<double>")
    bad = F.exists(cells, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    squares = F.aggregate(cells, F.lit(0.0), lambda total, x: total + x * x)
    # Beyond this norm a product of two rows need not fit a 64-bit score.
    fits = squares * float(SCALE * SCALE) < float(1 << 62)
    usable = df.where(label.isNotNull() & F.col(vector).isNotNull()).where(~bad).where(fits)
    return usable.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id).cast("long").alias("id"),
        label.cast("long").alias("label"),
        cells.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )


def mine(
    df: DataFrame,
    is_anchor: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of ``floor(256 * x)``. An anchor's positives are its ``positives`` best
    other rows of its label; for each, the ``negatives`` best rows of other labels in the score window
    are returned. Ties go to the smaller id, a null id comes last. Rows with a null label, a null
    vector or a null or non-finite component take no part, nor do vectors of a norm over some eight
    million, whose scores need not fit 64 bits. Vectors of different lengths are compared as if the
    shorter one ended in zeros. Repeated rows are rows of their own: each copy can be anchor,
    positive and negative. Other columns of ``df`` are not looked at; an empty table gives no rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    spark = df.sparkSession
    path = new_path(spark, "vectors")
    usable = _usable(df, id, vector, label, is_anchor)
    usable.write.parquet(path)
    rows = spark.read.schema(usable.schema).parquet(path)
    sizes = rows.groupBy("is_anchor").agg(F.sum(F.size("vector")).alias("cells")).collect()
    cells = {r.is_anchor: r.cells for r in sizes}
    n_anchor = _blocks(cells.get(True, 0))
    n_rows = max(spark.sparkContext.defaultParallelism, _blocks(sum(cells.values())))
    block_of = F.xxhash64("uid")
    each_row_block = F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))
    each_anchor_block = F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1)))

    def anchor_side(anchors: DataFrame, *more: str) -> DataFrame:
        return anchors.select(
            F.pmod(block_of, F.lit(n_anchor)).cast("int").alias("a"), *_BLOCK, *more
        ).select("*", each_row_block.alias("b"))

    # Read anew: both sides of a cogroup with the very same columns would be taken for one.
    again = spark.read.schema(usable.schema).parquet(path)
    others = again.select(
        F.pmod(block_of, F.lit(n_rows)).cast("int").alias("b"), *_BLOCK
    ).select("*", each_anchor_block.alias("a"))

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NONE
        anchors, block = Block(left), Block(right)
        return _found(_best_positives(anchors, block, positives), anchors, block, 1)

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NONE
        anchors, block = Block(left), Block(right)
        low, high = _windows(left, anchors.order, positives)
        heaps = _best_negatives(anchors, block, low, high, negatives)
        return _found(heaps, anchors, block, positives)

    def over_grid(anchors: DataFrame, function) -> DataFrame:
        pairs = anchors.groupBy("a", "b").cogroup(others.groupBy("a", "b"))
        return pairs.applyInArrow(function, _FOUND)

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("uid")]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    anchors = rows.where("is_anchor")
    firsts = best(over_grid(anchor_side(anchors), best_positives), ["anchor"], positives)
    chosen = stage(
        firsts.select("anchor", (F.col("rank") - 1).alias("place"), "id", "score"), "positives"
    )
    lists = chosen.groupBy("anchor").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("positives")
    )
    ready = anchors.join(lists.withColumnRenamed("anchor", "uid"), "uid")
    found = best(
        over_grid(anchor_side(ready, "positives"), best_negatives), ["anchor", "place"], negatives
    )
    named = chosen.join(
        anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor"
    ).select(
        "anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return found.join(named, ["anchor", "place"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(
        F.col("label")
    )
    return mine(rows, F.col("vec_id") % 50 == 0, label=noisy)


def sql() -> str:
    return f"""
    with used as (
      select row_number() over () as uid, vec_id,
             case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as cells
      from embeddings
      where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
      select a.uid as anchor, a.vec_id as anchor_id, a.label as anchor_label, b.uid, b.vec_id, b.label,
             coalesce(list_sum(list_transform(list_zip(a.cells, b.cells),
                                              lambda t: coalesce(t[1], 0) * coalesce(t[2], 0))), 0)::bigint as score
      from used a, used b where a.vec_id % 50 = 0),
    positives as (
      select anchor, anchor_id, uid as positive, vec_id as positive_id, score as positive_score from scored
      where label = anchor_label and uid <> anchor
      qualify row_number() over (partition by anchor order by score desc, vec_id nulls last, uid) <= {POSITIVES}),
    negatives as (
      select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
             row_number() over (partition by p.anchor, p.positive order by s.score desc, s.vec_id nulls last, s.uid) as rank
      from positives p join scored s on p.anchor = s.anchor
      where s.label <> s.anchor_label and {LOW_PERCENT} * p.positive_score <= 100 * s.score
        and 100 * s.score <= {HIGH_PERCENT} * p.positive_score)
    select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score
    from negatives where rank <= {NEGATIVES}"""
