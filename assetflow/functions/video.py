"""Column expressions on video probe metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.constants import MIN_FRAMES, SUPPORTED_CODECS, VFR_TOLERANCE

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_FRACTION = rf"^\s*({_NUMBER})\s*/\s*({_NUMBER})\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_OUTER_SPACE = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+\z"


def fourcc(code: Column) -> Column:
    """Four ASCII characters packed little-endian in an integer, trimmed and lower-cased."""
    chars = [F.char(F.shiftright(code, 8 * i).bitwiseAND(F.lit(0xFF))) for i in range(4)]
    text = F.lower(F.regexp_replace(F.concat(*chars), _OUTER_SPACE, ""))
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def frame_rate(fraction: Column) -> Column:
    """``"num/den"`` as a double; 0.0 for anything else, a zero denominator included."""
    num = F.regexp_extract(fraction, _FRACTION, 1).try_cast("double")
    den = F.regexp_extract(fraction, _FRACTION, 2).try_cast("double")
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def is_vfr(nominal: Column, average: Column) -> Column:
    """Variable frame rate: both rates known and further apart than the tolerance."""
    r, a = frame_rate(nominal), frame_rate(average)
    gap = F.try_divide(F.abs(r - a), F.greatest(r, a))
    return F.coalesce((r > 0) & (a > 0) & (gap > VFR_TOLERANCE), F.lit(False))


def is_too_short(nb_frames: Column) -> Column:
    """Frame count is a number below the minimum; unknown counts pass."""
    frames = F.when(nb_frames.rlike(_INTEGER), F.trim(nb_frames).try_cast("decimal(38,0)"))
    return F.coalesce(frames < MIN_FRAMES, F.lit(False))


def is_supported_codec(codec: Column) -> Column:
    return F.coalesce(codec.isin(*SUPPORTED_CODECS), F.lit(False))


def verdict(
    codec: Column,
    nominal: Column,
    average: Column,
    nb_frames: Column,
    no_stream: Column | None = None,
    first_frame_unreadable: Column | None = None,
) -> Column:
    """First reason against a video, or ``ok``.

    A null codec means the container could not be opened. The two reasons only a decoder can
    find enter as flags; leave them out when the probe did not look.
    """
    never = F.lit(False)
    no_stream = never if no_stream is None else F.coalesce(no_stream, never)
    unreadable = (
        never if first_frame_unreadable is None else F.coalesce(first_frame_unreadable, never)
    )
    return (
        F.when(codec.isNull(), "unopenable")
        .when(~is_supported_codec(codec), "unsupported_codec")
        .when(no_stream, "no_video_stream")
        .when(is_vfr(nominal, average), "vfr")
        .when(is_too_short(nb_frames), "too_short")
        .when(unreadable, "undecodable")
        .otherwise("ok")
    )
