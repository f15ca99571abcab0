"""Features of file contents: texts, JSON documents, waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.constants import BATCH_SIZE, NEEDLE
from assetflow.functions import signals
from assetflow.functions.text import canonical_json, is_json
from assetflow.operators.batching import batch_assign
from assetflow.shared import stage

# ------------------------------------------------------------------ text


def text_measures(texts: DataFrame) -> DataFrame:
    """Replace ``text`` by its characters, bytes and whether it holds the search word."""
    text = F.col("text")
    return texts.withColumns(
        {
            "chars": F.length(text).cast("long"),
            "bytes": F.octet_length(text).cast("long"),
            "has_word": F.contains(text, F.lit(NEEDLE)),
        }
    ).drop("text")


def text_totals(texts: DataFrame, *keys: str) -> DataFrame:
    """Files, characters, bytes and files with the word, per key."""
    return (
        text_measures(texts)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("num_files"),
            F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
            F.count_if("has_word").alias("files_with_word"),
        )
    )


def text_batch_stats(texts: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Characters and files with the word in each batch of a type.

    Texts are read once, and measured where they are read; only the measures, which are written
    out first, are ranked into batches.
    """
    measured = text_measures(texts).select("ext", "path", "asset_id", "chars", "has_word")
    return (
        batch_assign(stage(measured, "measures"), ["ext"], ["path", "asset_id"], size)
        .groupBy("ext", "batch_id")
        .agg(
            F.count("*").alias("num_files"),
            F.sum("chars").alias("total_chars"),
            F.count_if("has_word").alias("files_with_word"),
        )
    )


# ------------------------------------------------------------------ JSON


def parse_json(docs: DataFrame) -> DataFrame:
    """Add ``doc``, the ``text`` as a VARIANT; null when it is not one JSON document."""
    return docs.withColumn("doc", F.try_parse_json(canonical_json(F.col("text"))))


def json_validity(docs: DataFrame, *keys: str) -> DataFrame:
    """Valid and invalid documents per key."""
    return (
        docs.withColumn("_valid", is_json(F.col("text")))
        .groupBy(*keys)
        .agg(
            F.count_if("_valid").alias("valid_docs"),
            F.count_if(~F.col("_valid")).alias("invalid_docs"),
        )
    )


# ------------------------------------------------------------------ waveforms


def signal_batch_shape(clips: DataFrame) -> DataFrame:
    """Per batch: most channels and greatest length."""
    return clips.groupBy("batch_id").agg(
        F.count("*").alias("num_clips"),
        F.max(F.size("waveform")).alias("max_channels"),
        F.max(signals.n_samples(F.col("waveform"))).alias("max_length"),
    )


def signal_pad(clips: DataFrame) -> DataFrame:
    """Clips zero-filled to their batch's shape; no sample and no channel is cut.

    Runs when called: the shapes, a row per batch, are written first, so that the clips are read
    once more and not again for every use of the result.
    """
    shape = stage(signal_batch_shape(clips).drop("num_clips"), "shapes")
    return (
        clips.join(shape, "batch_id")
        .withColumn(
            "waveform",
            signals.pad(F.col("waveform"), F.col("max_channels"), F.col("max_length")),
        )
        .drop("max_channels", "max_length")
    )
