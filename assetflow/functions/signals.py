"""Column expressions on waveforms: one array of samples per channel.

The single statistics are built-in expressions, which suit short arrays. Spark evaluates those
sample by sample, so for long clips ``levels`` gives all of them from one pass in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.constants import N_FFT


def n_samples(waveform: Column) -> Column:
    """Length of the longest channel."""
    return F.coalesce(F.array_max(F.transform(waveform, F.size)), F.lit(0))


def _samples(waveform: Column, cap: int | None = None) -> Column:
    if cap is not None:
        waveform = F.transform(waveform, lambda ch: F.slice(ch, 1, cap))
    return F.flatten(waveform)


def _total(values: Column, term) -> Column:
    return F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + F.coalesce(term(x.cast("double")), F.lit(0.0))
    )


def mean_abs(waveform: Column, cap: int | None = None) -> Column:
    """Mean absolute sample over all channels; null for an empty clip."""
    samples = _samples(waveform, cap)
    return F.try_divide(_total(samples, F.abs), F.size(samples))


def l2_norm(waveform: Column, cap: int | None = None) -> Column:
    """Square root of the energy, of the first ``cap`` samples of each channel if that is given."""
    return F.sqrt(_total(_samples(waveform, cap), lambda x: x * x))


def rms(waveform: Column, cap: int | None = None) -> Column:
    """Root mean square over the same samples; null for an empty clip."""
    samples = _samples(waveform, cap)
    return F.sqrt(F.try_divide(_total(samples, lambda x: x * x), F.size(samples)))


def channel_levels(
    channels: list[np.ndarray], cap: int | None = None
) -> tuple[float | None, float, float | None]:
    """Mean absolute sample, norm and root mean square of one clip, all over the same samples."""
    total = energy = 0.0
    n = 0
    for channel in channels:
        samples = channel[:cap].astype("f8")
        total += float(np.abs(samples).sum())
        energy += float(samples @ samples)
        n += len(samples)
    if not n:
        return None, 0.0, None
    return total / n, energy**0.5, (energy / n) ** 0.5


LEVELS = T.StructType([T.StructField(name, T.DoubleType()) for name in ("mean_abs", "l2", "rms")])


def levels(waveform: Column, cap: int | None = None) -> Column:
    """``mean_abs``, ``l2_norm`` and ``rms`` of an ``array<array<float>>`` as one struct."""

    @F.arrow_udf(LEVELS)
    def compute(clips: pa.Array) -> pa.Array:
        outer, channels = clips.offsets.to_numpy(), clips.values
        inner = channels.offsets.to_numpy()
        samples = pc.fill_null(channels.values, 0.0).to_numpy(zero_copy_only=False)
        rows = [
            channel_levels([samples[inner[c] : inner[c + 1]] for c in range(*outer[i : i + 2])], cap)
            for i in range(len(clips))
        ]
        fields = [pa.array([row[f] for row in rows], pa.float64()) for f in range(3)]
        return pa.StructArray.from_arrays(fields, LEVELS.names)

    return F.when(waveform.isNotNull(), compute(waveform))


def pad(waveform: Column, channels: Column, length: Column) -> Column:
    """Zero-filled to ``channels`` channels of ``length`` samples; nothing is cut."""
    zero = F.lit(0.0).cast("float")

    def fit(ch: Column) -> Column:
        return F.concat(ch, F.array_repeat(zero, (length - F.size(ch)).cast("int")))

    silent = F.array_repeat(F.array_repeat(zero, length.cast("int")), (channels - F.size(waveform)).cast("int"))
    return F.concat(F.transform(waveform, fit), silent)


def _frame_power(signal: np.ndarray, n_fft: int, hop: int) -> list[float] | None:
    half = n_fft // 2
    if len(signal) <= half:  # too short to mirror at the ends
        return None
    padded = np.pad(signal, half, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    power = np.zeros(half + 1)
    for start in range(0, len(frames), 256):
        power += (np.abs(np.fft.rfft(frames[start : start + 256], axis=1)) ** 2).sum(axis=0)
    return (power / len(frames)).tolist()


def spectrum(channel: Column, n_fft: int = N_FFT) -> Column:
    """Mean power per frequency of a channel's short-time spectrum (quarter-window hop).

    Frames are centred and the ends mirrored; null when the channel is too short for that.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def power(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda s: None
                if s is None
                else _frame_power(np.asarray(s, dtype="float64"), n_fft, n_fft // 4)
            )

    return power(channel)
