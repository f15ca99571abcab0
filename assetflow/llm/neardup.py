"""Near-duplicates: banded MinHash candidates, sifted by odd sketches, confirmed on full sets.

Documents with equal shingle sets are one class from the start. A class has 1,040 MinHash samples:
130 of them, in 26 bands of 5, give candidates, and all are folded into bitmaps in which each sample
flips one bit, a short one of those 130 and a long one of the others. Two classes that differ in m
samples have bitmaps that differ in at most 2 m bits, so the count of ones in their XOR bounds the
similarity from above: candidates below the threshold go before any text is moved, most of them by
the short bitmap. A third bitmap is the parity of the whole set: two sets differ in at least as many
shingles as their parities in bits, a bound that loses no link and is close to exact as long as the
differences are few beside its 4,096 bits. Longer texts are told by the samples.

No bucket is turned into all its pairs. First each class is compared with one class of each of its
buckets, drawn by hash, and the closest is confirmed. Then only classes of one bucket that are
still in different components are compared, outsiders with the others of the bucket, each pair in
the first band it shares. A link inside a component changes nothing, so the components are those of
all candidate pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm import bitmaps
from assetflow.llm.batches import map_pieces, pieces, utf8
from assetflow.llm.components import components
from assetflow.llm.wordhash import Hasher, mix
from assetflow.shared import stage

SHINGLE_WORDS = 5
PERCENT = 85
# A pair at the threshold shares no band with a probability of (1 - 0.85**5)**26 = 2e-7.
BANDS, BAND_ROWS = 26, 5
SAMPLES = BANDS * BAND_ROWS
SHORT_BITS, LONG_BITS = 1024, 7168
ALL_SAMPLES = 8 * SAMPLES
_SHORT_LONGS = SHORT_BITS // 64
PARITY_BITS = 4096
_FP = "__dup_fp"
# At the threshold 19.5 of 130 samples differ, with a deviation of 4.1; 46 are 6.5 deviations more.
# Of 1,040 samples 156 differ, with a deviation of 11.5; 202 are 4 deviations more, so that 3 of
# 100,000 pairs at the threshold are lost.
MAX_DIFFERENT, ALL_MAX_DIFFERENT = 46, 202

SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("fp", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.ArrayType(T.LongType())),
        T.StructField("parity", T.ArrayType(T.LongType())),
    ]
)


def shingle_sets(hasher: Hasher, texts: list[bytes | None], n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; the whole text where it is shorter."""
    words = hasher.words([t.lower() if t else t for t in texts])
    grams = {n: words.hash_ngrams(n)}
    sets = []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        size = min(n, hi - lo)
        if size and size not in grams:
            grams[size] = words.hash_ngrams(size)
        sets.append(np.unique(grams[size][lo : hi - size + 1]) if size else np.zeros(0, np.uint64))
    return sets


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """Names a shingle set; null for an empty one."""
    if not len(shingles):
        return None
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch) of each nonempty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    seeds = mix(np.arange(1, 2 * ALL_SAMPLES + 1, dtype=np.uint64))
    least = np.empty((len(sets), ALL_SAMPLES), np.uint64)
    for i in range(ALL_SAMPLES):
        least[:, i] = np.minimum.reduceat((flat ^ seeds[2 * i]) * (seeds[2 * i + 1] | np.uint64(1)), starts)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for row in range(BAND_ROWS):
        bands = mix(bands ^ least[:, row:SAMPLES:BAND_ROWS]) + np.arange(1, BANDS + 1, dtype=np.uint64)
    chosen = mix(least ^ seeds[::2])
    sketches = [
        _odd_sketch(chosen[:, :SAMPLES], SHORT_BITS),
        _odd_sketch(chosen[:, SAMPLES:], LONG_BITS),
    ]
    return bands.view(np.int64), np.hstack(sketches).view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmap of each whole set: the XOR of two has at most as many ones as the sets differ in."""
    places = (mix(np.concatenate(sets)) % np.uint64(PARITY_BITS)).astype(np.int64)
    at = np.repeat(np.arange(len(sets)), list(map(len, sets))) * PARITY_BITS + places
    odd = np.bincount(at, minlength=len(sets) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), PARITY_BITS), axis=1).view(np.int64)


def _odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a bitmap for each row of samples: a bit is set if an odd number of them chose it."""
    places = (samples % np.uint64(bits)).astype(np.int64)
    at = np.arange(len(samples))[:, None] * bits + places
    odd = np.bincount(at.ravel(), minlength=len(samples) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(samples), bits), axis=1)


def sign(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but ``text``, with set size, fingerprint, band keys, odd sketch and parity."""

    def make():
        hasher = Hasher()

        def run(texts):
            sets = shingle_sets(hasher, texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            sketches: list = [[]] * len(sets)
            parity: list = [[]] * len(sets)
            if full:
                some = [sets[i] for i in full]
                for i, b, s, odd in zip(full, *signatures(some), parities(some), strict=True):
                    bands[i], sketches[i], parity[i] = b, s, odd
            return [[len(s) for s in sets], [fingerprint(s) for s in sets], bands, sketches, parity]

        return run

    return map_pieces(docs, text, make, SIGNED)


def _different_bits(a: str, b: str) -> Column:
    """Bits in which the short bitmaps differ."""
    counts = [
        F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(_SHORT_LONGS)
    ]
    return sum(counts[1:], counts[0])


def _all_different_bits(a: str, b: str) -> Column:
    """Bits in which arrays of bits differ; of few pairs, so the loop need not be compiled code."""
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def _may_link(percent: int) -> Column:
    """True unless sizes, sketches or parities of a and b rule out the similarity.

    Sets of together n shingles that differ in d of them share (n - d) / 2 of (n + d) / 2.
    """
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (
        (100 * small >= percent * large)
        & (_different_bits("a_sketch", "b_sketch") <= 2 * MAX_DIFFERENT)
        & ((100 + percent) * _all_different_bits("a_parity", "b_parity") <= (100 - percent) * (small + large))
        & (_all_different_bits("a_sketch", "b_sketch") <= 2 * ALL_MAX_DIFFERENT)
    )


def _side(classes: DataFrame, side: str, *more: str) -> DataFrame:
    return classes.select(
        F.col("fp").alias(side),
        F.col("n_shingles").alias(f"{side}_n"),
        F.col("sketch").alias(f"{side}_sketch"),
        F.col("parity").alias(f"{side}_parity"),
        *[F.col(c).alias(f"{side}_{c}") for c in more],
    )


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """A text of each class in ``pairs``; other texts stay where they are."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = stage(classes.select("fp", "least_id").join(wanted, "fp", "left_semi"), "wanted")
    likely = bitmaps.select(docs, "doc_id", bitmaps.build(wanted, "least_id"), present=True)
    return (
        with_fingerprint(likely.select("text"))
        .join(wanted.select("fp"), F.col(_FP) == F.col("fp"), "left_semi")
        .groupBy(F.col(_FP).alias("fp"))
        .agg(F.first("text").alias("text"))
    )


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    texts = stage(_texts(docs, classes, pairs), "texts")
    rows = pairs.join(
        texts.select(F.col("fp").alias("a"), F.col("text").alias("a_text")), "a"
    ).join(texts.select(F.col("fp").alias("b"), F.col("text").alias("b_text")), "b")

    def run(stream):
        hasher = Hasher()
        for batch in stream:
            left, right = batch.column(2), batch.column(3)
            linked = []
            for lo, hi in pieces(left):
                for x, y in zip(
                    shingle_sets(hasher, utf8(left.slice(lo, hi - lo))),
                    shingle_sets(hasher, utf8(right.slice(lo, hi - lo))),
                    strict=True,
                ):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"]
            )

    return rows.select("a", "b", "a_text", "b_text").mapInArrow(run, "u binary, v binary")


def _closest(pairs: DataFrame) -> DataFrame:
    """For each a the b whose sketch differs least."""
    best = pairs.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def _first_candidates(classes: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """For each class the closest of the classes that stand for its buckets.

    Every bucket draws its own, so that a class in many buckets of a large group meets many others.
    """
    drawn = F.min(F.struct(F.xxhash64("fp", "band").alias("h"), "fp"))
    centers = buckets.groupBy("band").agg(drawn.alias("center"), F.count("*").alias("n"))
    pairs = (
        buckets.join(centers.where("n > 1").select("band", F.col("center.fp").alias("b")), "band")
        .where("fp != b")
        .select(F.col("fp").alias("a"), "b")
        .distinct()
    )
    sifted = (
        pairs.join(_side(classes, "a"), "a")
        .join(_side(classes, "b"), "b")
        .where(_may_link(percent))
        .select("a", "b", _different_bits("a_sketch", "b_sketch").alias("bits"))
    )
    return _closest(sifted)


def _outside_pairs(classes: DataFrame, buckets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that may be similar, each once.

    One of a pair is outside the bucket's largest component.
    """
    crowded = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    labelled = (
        buckets.join(crowded, "band", "left_semi")
        .join(labels, F.col("fp") == F.col("node"), "left")
        .select("band", "fp", F.coalesce("label", "fp").alias("label"))
    )
    sizes = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = (
        sizes.groupBy("band")
        .agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("band", F.col("most.label").alias("main"))
    )
    split = stage(labelled.join(main, "band"), "split-buckets")
    members = stage(classes.join(split.select("fp").distinct(), "fp", "left_semi"), "members")
    left = split.where("label != main").select("band", F.col("fp").alias("a"), F.col("label").alias("a_label"))
    right = split.select(
        "band",
        F.col("fp").alias("b"),
        F.col("label").alias("b_label"),
        (F.col("label") == F.col("main")).alias("b_main"),
    )
    different = (F.col("a_label") != F.col("b_label")) & (F.col("b_main") | (F.col("a") > F.col("b")))
    # A pair counts in the first of the bands that it shares.
    here = F.col("band") == F.element_at(F.array_intersect("a_bands", "b_bands"), 1)
    left = left.join(_side(members, "a", "bands"), "a")
    right = right.join(_side(members, "b", "bands"), "b")
    found = left.alias("x").join(
        right.alias("y"), (F.col("x.band") == F.col("y.band")) & different & _may_link(percent)
    )
    return (
        found.select(F.col("x.band").alias("band"), "a", "b", "a_bands", "b_bands")
        .where(here)
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``fp``, ``component_id`` and ``kept`` for each row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Texts without a word have an
    empty set, no fingerprint and are linked with nothing. The component's id is the least doc_id
    in it that is not null. Repeated rows are copies of each other and get equal results, so
    ``kept`` can hold for several rows of one doc_id; ``keep_one`` leaves one of them.
    """
    docs = docs.select("doc_id", "text")
    signed = stage(sign(docs), "signed")
    classes = stage(
        signed.where("fp is not null")
        .groupBy("fp")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
            F.first("parity").alias("parity"),
        ),
        "classes",
    )
    buckets = classes.select("fp", F.explode("bands").alias("band"))
    first = stage(_first_candidates(classes, buckets, percent), "candidates")
    links = stage(_confirmed(docs, classes, first, percent), "links")
    labels = components(links)
    outside = _outside_pairs(classes, buckets, labels, percent)
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    outside = stage(outside.join(tried, ["a", "b"], "left_anti"), "candidates")
    if not outside.isEmpty():
        more = stage(_confirmed(docs, classes, outside, percent), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    labelled = classes.select("fp", "least_id").join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = stage(labelled.join(least, "label").select("fp", "component_id"), "components")
    return (
        signed.select("doc_id", "n_shingles", "fp")
        .join(of_class, "fp", "left")
        .select(
            "doc_id",
            "n_shingles",
            "fp",
            F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__dup_fp``, the fingerprint of the text's shingle set."""
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(_FP, T.BinaryType())])
    names = schema.names

    def run(stream):
        hasher = Hasher()
        for batch in stream:
            texts = batch.column(at)
            for lo, hi in pieces(texts):
                sets = shingle_sets(hasher, utf8(texts.slice(lo, hi - lo)))
                fps = [fingerprint(s) for s in sets]
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(fps, pa.binary())], names=names)

    return df.mapInArrow(run, schema)


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all columns.

    Of rows that are equal in doc_id and shingles one stays; texts without a word all stay. Columns
    may have any name that does not start with ``__dup_``.
    """
    columns = docs.columns
    found = stage(near_duplicates(docs, percent).where("fp is not null"), "found")
    # Classes of one row that is the first of its component are not in this table.
    judged = stage(
        found.groupBy("fp")
        .agg(
            F.min("component_id").alias("first_id"),
            F.max("kept").alias("kept"),
            F.sum(F.col("kept").cast("long")).alias("rows"),
            F.count("*").alias("all"),
        )
        .where("not kept or all > 1")
        .select(*[F.col(c).alias(f"__dup_{c}") for c in ("first_id", "kept", "rows")], F.col("fp").alias("__dup_class")),
        "judged",
    )
    ids = found.join(judged, F.col("fp") == F.col("__dup_class"), "left_semi").select("doc_id")
    bitmap = bitmaps.build(ids, "doc_id")
    untouched = bitmaps.select(docs, "doc_id", bitmap, present=False)
    named = with_fingerprint(bitmaps.select(docs, "doc_id", bitmap, present=True))
    first = F.col("__dup_kept") & F.col("doc_id").eqNullSafe(F.col("__dup_first_id"))
    left = named.join(judged, F.col(_FP) == F.col("__dup_class"), "left").where(
        F.col("__dup_class").isNull() | first
    )
    if judged.where("__dup_rows > 1").isEmpty():
        return untouched.unionByName(left.select(*columns))
    left = stage(left.select(*columns, _FP, "__dup_rows"), "firsts")
    once = left.where("__dup_rows is null or __dup_rows = 1").select(*columns)
    again = left.where("__dup_rows > 1").dropDuplicates([_FP]).select(*columns)
    return untouched.unionByName(once).unionByName(again)


def op2_odd_sketches(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
