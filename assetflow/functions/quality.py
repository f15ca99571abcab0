"""Column expressions on measurements: rates, ratios and trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.constants import MAX_ERR_RATE


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def per_file_ms(seconds: Column, files: Column) -> Column:
    return ratio(seconds, files) * 1000


def is_trusted(accel_sec: Column, err_rate: Column) -> Column:
    """Something was measured and fewer batches failed than the limit allows."""
    return (accel_sec > 0) & (err_rate < MAX_ERR_RATE)


def quality_flag(accel_sec: Column, err_rate: Column) -> Column:
    return F.when(is_trusted(accel_sec, err_rate), F.lit("OK")).otherwise(
        F.format_string("UNRELIABLE (err_rate=%.1f%%)", err_rate * 100)
    )


def speedup(baseline_sec: Column, accel_sec: Column, err_rate: Column) -> Column:
    """Baseline over accelerated time; null when it must not be cited."""
    return F.when(is_trusted(accel_sec, err_rate), F.try_divide(baseline_sec, accel_sec))
