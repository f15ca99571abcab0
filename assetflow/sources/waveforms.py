"""WAV files as waveforms."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from assetflow.functions.signals import channel_levels

_SCHEMA = "path string, sample_rate int, waveform array<array<float>>, error string"
_MEASURED = "path string, sample_rate int, mean_abs double, l2 double, rms double, error string"
_FULL_SCALE = {1: 2**7, 2: 2**15, 4: 2**31}  # by bytes per sample


def _decode(content: bytes) -> tuple[int, list[np.ndarray]]:
    """Sample rate and one array per channel, full scale being 1.0."""
    with wave.open(io.BytesIO(content)) as clip:
        width, channels, rate = clip.getsampwidth(), clip.getnchannels(), clip.getframerate()
        raw = clip.readframes(clip.getnframes())
    if width == 1:
        samples = np.frombuffer(raw, "u1").astype("f4") - 128
    elif width == 3:  # as the upper bytes of 32-bit samples
        wide = np.zeros((len(raw) // 3, 4), "u1")
        wide[:, 1:] = np.frombuffer(raw, "u1").reshape(-1, 3)
        samples, width = wide.view("<i4").ravel().astype("f4"), 4
    else:
        samples = np.frombuffer(raw, f"<i{width}").astype("f4")
    samples = samples / np.float32(_FULL_SCALE[width])
    return rate, [samples[c::channels] for c in range(channels)]


def _try_decode(content: bytes) -> tuple[int | None, list[np.ndarray] | None, str | None]:
    try:
        return *_decode(content), None
    except (wave.Error, EOFError, ValueError) as exc:
        return None, None, f"{type(exc).__name__}: {exc}"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"sample_rate": "Int32"})


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):  # clips are large: one at a time
            yield _frame([(path, *_try_decode(content))], _SCHEMA)


def _clips(spark: SparkSession, root: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[wW][aA][vV]")
        .load(root)
    )
    return files.select("path", "content")


def read_waveforms(spark: SparkSession, root: str) -> DataFrame:
    """PCM clips below ``root``: path, sample_rate, waveform, and an error if a file is unreadable."""
    return _clips(spark, root).mapInPandas(_decode_batches, _SCHEMA)


def measure_waveforms(spark: SparkSession, root: str, cap: int | None = None) -> DataFrame:
    """Level statistics of the clips below ``root``; no sample leaves the task that read it."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                rate, channels, error = _try_decode(content)
                stats = (None, None, None) if channels is None else channel_levels(channels, cap)
                rows.append((path, rate, *stats, error))
            yield _frame(rows, _MEASURED)

    return _clips(spark, root).mapInPandas(measure, _MEASURED)
