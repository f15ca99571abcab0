"""The processing of each file type, by extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.functions import signals
from assetflow.functions.text import is_json
from assetflow.operators import content, video

Processor = Callable[[DataFrame], DataFrame]


def process_video(probes: DataFrame) -> DataFrame:
    """video_verdict per probed video."""
    return video.judge(probes)


def process_audio(clips: DataFrame) -> DataFrame:
    """mean_abs, l2 and rms per clip."""
    measured = clips.withColumn("_levels", signals.levels(F.col("waveform")))
    return measured.select(*[c for c in clips.columns if c != "waveform"], "_levels.*")


def process_text(texts: DataFrame) -> DataFrame:
    """Length and search word per text."""
    return content.text_measures(texts)


def process_json(docs: DataFrame) -> DataFrame:
    """Validity on top of the text measures."""
    return content.text_measures(docs.withColumn("valid", is_json(F.col("text"))))


def process_sheets(sheets: DataFrame) -> DataFrame:
    """Rows per sheet."""
    return sheets.groupBy("source_id").agg(F.count("*").alias("num_rows"))


# File type -> processing of its contents. Add an entry to extend.
PROCESSORS: dict[str, Processor] = {
    "mp4": process_video,
    "wav": process_audio,
    "txt": process_text,
    "json": process_json,
    "xlsx": process_sheets,
}


def processor_for(ext: str) -> Processor:
    try:
        return PROCESSORS[ext]
    except KeyError:
        raise ValueError(f"no processor is registered for files of type {ext!r}") from None
