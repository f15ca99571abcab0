"""Which videos are usable, judged by their probe metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.functions import video


def judge(probes: DataFrame) -> DataFrame:
    """Add ``verdict``, ``ok`` or the first reason against the video.

    Optional boolean columns ``no_stream`` and ``first_frame_unreadable`` carry what only a
    decoder can see.
    """

    def flag(column: str):
        return F.col(column) if column in probes.columns else None

    return probes.withColumn(
        "verdict",
        video.verdict(
            F.col("codec"),
            F.col("r_frame_rate"),
            F.col("avg_frame_rate"),
            F.col("nb_frames"),
            flag("no_stream"),
            flag("first_frame_unreadable"),
        ),
    )


def eligible(probes: DataFrame) -> DataFrame:
    return judge(probes).filter(F.col("verdict") == "ok")


def excluded_counts(probes: DataFrame) -> DataFrame:
    """Videos per reason for exclusion."""
    return (
        judge(probes)
        .filter(F.col("verdict") != "ok")
        .groupBy("verdict")
        .agg(F.count("*").alias("num_files"))
    )


def codec_groups(probes: DataFrame) -> DataFrame:
    """Openable videos per codec."""
    return (
        probes.filter(F.col("codec").isNotNull())
        .groupBy("codec")
        .agg(F.count("*").alias("num_files"))
    )


def codec_diagnostics(probes: DataFrame) -> DataFrame:
    """One status row per codec: OK, or SKIP with the reason."""
    usable = video.is_supported_codec(F.col("codec"))
    return codec_groups(probes).withColumns(
        {
            "status": F.when(usable, "OK").otherwise("SKIP"),
            "reason": F.when(~usable, "UNSUPPORTED_CODEC"),
        }
    )
