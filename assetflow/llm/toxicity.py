"""Toxicity by a classifier chain: linear models that see the probabilities of earlier categories.

Features are words and their beginnings, so that a stem counts whatever follows it. The models are
fitted on at most ``SAMPLE_ROWS`` labelled documents. Each category's model is trained with the
out-of-fold probabilities of the categories before it, since in-sample ones would look too good;
when scoring, the probabilities come down the chain in the same order.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.batches import filter_pieces, map_pieces
from assetflow.llm.optimize import minimize
from assetflow.shared import stage

# Categories in the order of the chain, as conditions on a labels row.
CATEGORIES = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "severe": "toxic = 1 and quality = 0",
}
# Bounds of the fit: labelled documents (those with the least hashes of doc_id), and features per
# category. Scoring covers all documents.
SAMPLE_ROWS = 10_000
FEATURES = 1_500
MIN_DOCS = 5
STARTS = (3, 4, 5, 6, 7)
FOLDS = 3
REGULARIZATION = 1e-4
ITERATIONS = 60
_REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> set[str]:
    return set(_WORD.findall(text.decode().lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The whole word, and its beginnings marked as such."""
    return [word, *[word[:n] + "*" for n in STARTS if len(word) > n]]


class Featurizer:
    """Turns texts into the numbers of known features; remembers a bounded number of words."""

    def __init__(self, vocabulary: list[str]):
        self._number = {f: i for i, f in enumerate(vocabulary)}
        self._of_word: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: bytes | None) -> set[int]:
        known, found = self._of_word, set()
        for word in words_of(text):
            numbers = known.get(word)
            if numbers is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                numbers = known[word] = tuple(
                    self._number[f] for f in features_of(word) if f in self._number
                )
            if numbers:
                found.update(numbers)
        return found


@dataclass
class Chain:
    """A fitted chain: per category weights of the features, of earlier categories, and a threshold."""

    categories: list[str]
    vocabulary: list[str]
    weights: list[np.ndarray]
    earlier: list[np.ndarray]
    intercepts: list[float]
    thresholds: list[float]

    def probabilities(self, found: list[set[int]]) -> np.ndarray:
        """A row per category, a column per text."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = np.repeat(np.arange(len(found)), sizes)
        numbers = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
        out = np.zeros((len(self.categories), len(found)))
        for c in range(len(self.categories)):
            score = np.bincount(rows, self.weights[c][numbers], len(found)) + self.intercepts[c]
            score += self.earlier[c] @ out[:c]
            out[c] = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int) -> DataFrame:
    """``doc_id``, ``text`` and a 0/1 column per category of at most ``rows`` labelled documents.

    A document labelled several times has a category if one label says so; labels without a value
    for some category are not used.
    """
    judged = labels.select("doc_id", *[F.expr(c).cast("int").alias(n) for n, c in categories.items()])
    judged = (
        judged.dropna()
        .groupBy("doc_id")
        .agg(*[F.max(n).alias(n) for n in categories])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(judged), "doc_id")
    return texts.dropDuplicates(["doc_id"])


def _choose_features(sample: DataFrame, names: list[str], most: int) -> list[str]:
    """For each category the features that go with it most strongly, by chi-square."""
    at = [sample.columns.index(n) for n in names]
    text_at = sample.columns.index("text")

    def count(stream):
        for batch in stream:
            labels = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in at]).T
            seen: Counter = Counter()
            hits = [Counter() for _ in names]
            for text, row in zip(batch.column(text_at).to_pylist(), labels, strict=True):
                own = {f for w in words_of((text or "").encode()) for f in features_of(w)}
                seen.update(own)
                for c, positive in enumerate(row):
                    if positive:
                        hits[c].update(own)
            columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
            columns += [pa.array([h[f] for f in seen], pa.int64()) for h in hits]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", *names])

    schema = "feature string, n long, " + ", ".join(f"{n} long" for n in names)
    counts = (
        sample.mapInArrow(count, schema)
        .groupBy("feature")
        .agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        .where(F.col("n") >= MIN_DOCS)
    )
    counts = stage(counts, "features")
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    chosen: dict[str, None] = {}
    for name in names:
        total, positive = float(totals["n"]), float(totals[name] or 0)
        both, n = F.col(name), F.col("n")
        off = both * total - n * positive
        spread = n * (total - n) * positive * (total - positive)
        strength = F.when(spread > 0, off * off / spread * total).otherwise(0.0)
        best = counts.select("feature", strength.alias("s")).where("s > 0")
        rows = best.orderBy(F.desc("s"), "feature").limit(most).collect()
        chosen.update(dict.fromkeys(r["feature"] for r in rows))
    return list(chosen)


@dataclass
class _Sample:
    """The bounded sample as arrays: a document's features are ``numbers[ends[i - 1]:ends[i]]``."""

    numbers: np.ndarray
    sizes: np.ndarray
    fold: np.ndarray
    labels: np.ndarray  # a row per category

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.numbers])])
        ends = np.cumsum(self.sizes)
        return sums[ends] - sums[ends - self.sizes]


def _fit_linear(sample: _Sample, earlier: np.ndarray, y: np.ndarray, used: np.ndarray, n_features: int):
    """Weights of the features, of the earlier categories, and the intercept: logistic loss over the
    ``used`` documents with an L2 penalty, minimised by limited-memory BFGS."""
    n, c = used.sum(), len(earlier)
    positive = y[used].sum()
    if not 0 < positive < n:
        share = (positive + 0.01) / (n + 1)
        return np.concatenate([np.zeros(n_features + c), [np.log(share / (1 - share))]])

    def loss_and_slope(theta):
        w, e, b = theta[:n_features], theta[n_features:-1], theta[-1]
        z = sample.dot(w) + e @ earlier + b
        loss = np.logaddexp(0, np.where(y, -z, z))[used].mean() + REGULARIZATION / 2 * (w @ w + e @ e)
        r = np.where(used, (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n, 0.0)
        g = np.bincount(sample.numbers, np.repeat(r, sample.sizes), n_features)
        return loss, np.concatenate([g + REGULARIZATION * w, earlier @ r + REGULARIZATION * e, [r.sum()]])

    return minimize(loss_and_slope, np.zeros(n_features + c + 1), ITERATIONS)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 on out-of-fold probabilities is best; the middle between two values."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    taken = np.arange(1, len(p) + 1)
    f1 = 2 * hits / (taken + y.sum())
    f1[:-1][p[1:] == p[:-1]] = -1  # equal probabilities go together
    last = int(np.argmax(f1))
    below = p[last + 1] if last + 1 < len(p) else 0.0
    return float((p[last] + below) / 2)


def fit(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, rows: int = SAMPLE_ROWS
) -> Chain:
    """Fit a chain on a bounded sample. Without labelled documents every probability is near 0."""
    categories = categories or CATEGORIES
    names = list(categories)
    sample = stage(labelled_sample(docs, labels, categories, rows), "sample")
    vocabulary = _choose_features(sample, names, FEATURES)
    data = _arrays(sample, vocabulary, names)
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(data)
    chain = Chain(names, vocabulary, [], [], [], [])
    n_features = len(vocabulary)
    earlier = np.zeros((0, len(data.sizes)))
    for c in range(len(names)):

        def fit_part(stream, c=c, earlier=earlier):
            """One model without each fold, and one of the whole sample."""
            for batch in stream:
                for k in batch.column(0).to_pylist():
                    part = shared.value
                    theta = _fit_linear(part, earlier, part.labels[c], part.fold != k, n_features)
                    yield pa.RecordBatch.from_pydict({"k": [k], "theta": [theta]})

        parts = spark.range(FOLDS + 1, numPartitions=FOLDS + 1)
        fitted = {r["k"]: np.array(r["theta"]) for r in parts.mapInArrow(fit_part, "k long, theta array<double>").collect()}
        p = np.zeros(len(data.sizes))
        for k in range(FOLDS):
            theta, own = fitted[k], data.fold == k
            z = data.dot(theta[:n_features]) + theta[n_features:-1] @ earlier + theta[-1]
            p[own] = (1 / (1 + np.exp(-np.clip(z, -50, 50))))[own]
        chain.weights.append(fitted[FOLDS][:n_features])
        chain.earlier.append(fitted[FOLDS][n_features:-1])
        chain.intercepts.append(float(fitted[FOLDS][-1]))
        chain.thresholds.append(_threshold(p, data.labels[c]))
        earlier = np.vstack([earlier, p])
    return chain


def _arrays(sample: DataFrame, vocabulary: list[str], names: list[str]) -> _Sample:
    """The bounded sample's features, folds and labels."""

    def make():
        featurizer = Featurizer(vocabulary)
        return lambda texts: [[sorted(featurizer(t)) for t in texts]]

    schema = T.StructType([T.StructField("numbers", T.ArrayType(T.IntegerType()))])
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    rows = map_pieces(sample, "text", make, schema).withColumn("fold", fold).orderBy("doc_id").toArrow()
    numbers = rows["numbers"].combine_chunks()
    return _Sample(
        numbers.flatten().to_numpy().astype(np.int64),
        numbers.value_lengths().to_numpy().astype(np.int64),
        rows["fold"].to_numpy(),
        np.array([rows[n].to_numpy() == 1 for n in names]),
    )


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but ``text``, then ``p_<category>`` and ``is_<category>`` of each.

    Null and empty texts have no feature. Rows are scored one by one; equal texts score equally.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = T.StructType(
        [T.StructField(f"p_{n}", T.DoubleType()) for n in chain.categories]
        + [T.StructField(f"is_{n}", T.BooleanType()) for n in chain.categories]
    )

    def make():
        featurizer = Featurizer(shared.value.vocabulary)

        def run(texts):
            p = shared.value.probabilities([featurizer(t) for t in texts])
            return [*p, *(p > np.array(shared.value.thresholds)[:, None])]

        return run

    return map_pieces(docs, text, make, schema)


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not in ``category``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    c = chain.categories.index(category)

    def make():
        featurizer = Featurizer(shared.value.vocabulary)
        limit = shared.value.thresholds[c]
        return lambda texts: shared.value.probabilities([featurizer(t) for t in texts])[c] <= limit

    return filter_pieces(docs, text, make)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).withColumnRenamed("is_toxic", "toxic")
