"""From batch timings to reports.

``timings`` has one row per attempted batch: batch_id, file_type, engine (``baseline`` or
``accel``), n_files, elapsed_sec, failed; and codec if batches were made within codecs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.constants import CURVE_CHECKPOINTS, PROGRESS_EVERY, REPORTED_ERRORS
from assetflow.functions import quality
from assetflow.operators.isolate import batch_key
from assetflow.operators.ranking import rank_rows, running_totals
from assetflow.shared import stage

REPORT_SCHEMA = (
    "file_type string, num_files long, baseline_sec double, accel_sec double, "
    "baseline_avg_ms double, accel_avg_ms double, speedup_ratio double, baseline_errors long, "
    "accel_errors long, accel_excluded long, data_quality string"
)
_SUMS = (
    "num_files",
    "baseline_sec",
    "accel_sec",
    "baseline_ok_files",
    "accel_ok_files",
    "baseline_errors",
    "accel_errors",
    "baseline_batches",
    "accel_batches",
)


def bench_by_type(timings: DataFrame) -> DataFrame:
    """Files, and per engine the time and files of successful batches, failed and all batches.

    A batch counts its files once, however many engines took it.
    """
    parts = {}
    for engine in ("baseline", "accel"):
        mine = F.col("engine") == engine
        good = mine & ~F.col("failed")
        parts[f"{engine}_sec"] = F.sum(F.when(good, F.col("elapsed_sec")))
        parts[f"{engine}_ok_files"] = F.sum(F.when(good, F.col("n_files")))
        parts[f"{engine}_errors"] = F.count_if(mine & F.col("failed"))
        parts[f"{engine}_batches"] = F.count_if(mine)
    per_batch = timings.groupBy(*batch_key(timings)).agg(
        F.max("n_files").alias("num_files"), *[part.alias(name) for name, part in parts.items()]
    )
    return per_batch.groupBy("file_type").agg(
        F.sum("num_files").alias("num_files"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in parts],
    )


def zero_fill(summary: DataFrame, types: DataFrame) -> DataFrame:
    """A row for every type in ``types(file_type)``, zeros where nothing was measured."""
    return types.join(summary, "file_type", "left").fillna(0, subset=list(_SUMS))


def err_rate(unit: str = "batch") -> Column:
    """Failed accelerated batches over attempted batches, or (``unit="file"``) over all files.

    The second mixes units and lets bad types pass; it exists for comparison.
    """
    base = {"batch": "accel_batches", "file": "num_files"}[unit]
    return quality.ratio(F.col("accel_errors"), F.col(base))


def with_averages(summary: DataFrame) -> DataFrame:
    """Add milliseconds per file, over all files and over successfully processed ones."""
    added = {}
    for engine in ("baseline", "accel"):
        sec = F.col(f"{engine}_sec")
        added[f"{engine}_avg_ms"] = quality.per_file_ms(sec, F.col("num_files"))
        added[f"{engine}_ok_avg_ms"] = quality.per_file_ms(sec, F.col(f"{engine}_ok_files"))
    return summary.withColumns(added)


def with_quality(summary: DataFrame, unit: str = "batch") -> DataFrame:
    """Add ``speedup_ratio`` (null when not to be trusted) and ``data_quality``."""
    rate = err_rate(unit)
    return summary.withColumns(
        {
            "speedup_ratio": quality.speedup(F.col("baseline_sec"), F.col("accel_sec"), rate),
            "data_quality": quality.quality_flag(F.col("accel_sec"), rate),
        }
    )


def benchmark_report(
    timings: DataFrame,
    types: DataFrame | None = None,
    excluded: DataFrame | None = None,
    unit: str = "batch",
) -> DataFrame:
    """The whole report, ordered by type.

    ``types`` adds rows for types without timings, ``excluded(file_type, accel_excluded)`` the
    files kept from the accelerated engine.
    """
    summary = bench_by_type(timings)
    if types is not None:
        summary = zero_fill(summary, types)
    if excluded is None:
        summary = summary.withColumn("accel_excluded", F.lit(0).cast("long"))
    else:
        summary = summary.join(excluded, "file_type", "left").fillna(0, subset=["accel_excluded"])
    columns = [field.split()[0] for field in REPORT_SCHEMA.split(", ")]
    return with_quality(with_averages(summary), unit).select(*columns).orderBy("file_type")


def unreliable(report: DataFrame) -> DataFrame:
    return report.filter(F.col("data_quality") != "OK")


def publication(report: DataFrame) -> DataFrame:
    """Citable rows only, five columns, two decimals."""
    return report.filter(F.col("data_quality") == "OK").select(
        "file_type",
        "num_files",
        *[F.round(c, 2).alias(c) for c in ("baseline_avg_ms", "accel_avg_ms", "speedup_ratio")],
    )


# ------------------------------------------------------------------ speedup curve


def _steps(units: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """Units summed between neighbouring checkpoints: ``step`` = first checkpoint that ``rn`` reaches.

    At most one row per checkpoint, group and engine is left, whatever the number of units.
    """
    step = F.lit(None).cast("long")
    for n in sorted(checkpoints, reverse=True):
        step = F.when(F.col("rn") <= n, F.lit(n).cast("long")).otherwise(step)
    return (
        units.withColumn("step", step)
        .groupBy("file_type", "engine", "step")
        .agg(
            F.count("*").alias("units"),
            F.sum(F.when(~F.col("failed"), F.col("elapsed_sec"))).alias("sec"),
            F.max("rn").alias("last_rn"),
        )
    )


def _ranked_units(timings: DataFrame) -> DataFrame:
    order = [c for c in batch_key(timings) if c != "file_type"]
    needed = timings.select("file_type", "engine", *order, "elapsed_sec", "failed")
    return rank_rows(needed, ["file_type", "engine"], order, "rn")


def _units_by_files(timings: DataFrame) -> DataFrame:
    """``rn``: files of a type up to the end of each unit."""
    order = [c for c in batch_key(timings) if c != "file_type"]
    needed = timings.select("file_type", "engine", *order, "n_files", "elapsed_sec", "failed")
    return running_totals(needed, ["file_type", "engine"], order, {"rn": F.col("n_files")})


def speedup_curve(timings: DataFrame, checkpoints: Sequence[int] = CURVE_CHECKPOINTS) -> DataFrame:
    """Time of the first n files of every type, for each checkpoint and for the largest type.

    One row of ``timings`` is one unit of n_files; it counts where its last file is reached. Units
    are summed between checkpoints; the curve is the running sum of those few sums.
    """
    steps = _steps(_units_by_files(timings), checkpoints)
    largest = F.max("last_rn").over(Window.partitionBy())

    def engine_sec(engine: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("engine") == engine, F.col("sec"))), F.lit(0.0))

    marks = F.array_distinct(F.array(*[F.least(F.lit(n).cast("long"), "largest") for n in checkpoints], "largest"))
    reached = F.filter(marks, lambda n: n >= F.coalesce(F.col("step"), F.col("largest")))
    return (
        steps.withColumn("largest", largest)
        .withColumn("step", F.least("step", "largest"))
        .withColumn("num_files", F.explode(reached))
        .groupBy("num_files")
        .agg(engine_sec("baseline").alias("baseline_sec"), engine_sec("accel").alias("accel_sec"))
        .withColumn("speedup_ratio", F.try_divide("baseline_sec", "accel_sec"))
    )


def totals_at_checkpoints(
    timings: DataFrame, checkpoints: Sequence[int] = CURVE_CHECKPOINTS
) -> DataFrame:
    """Units and time up to each checkpoint, per type and engine."""
    rows = ", ".join(f"({n}L)" for n in checkpoints)
    marks = timings.sparkSession.sql(f"select * from values {rows} as t(checkpoint)")
    steps = _steps(_ranked_units(timings), checkpoints).filter(F.col("step").isNotNull())
    return (
        steps.join(F.broadcast(marks), F.col("step") <= F.col("checkpoint"))
        .groupBy("file_type", "engine", "checkpoint")
        .agg(F.sum("units").alias("units"), F.coalesce(F.sum("sec"), F.lit(0.0)).alias("sec"))
    )


# ------------------------------------------------------------------ repair outcomes


def repair_summary(outcomes: DataFrame, order: str, samples: int = REPORTED_ERRORS) -> DataFrame:
    """One row: fixed, failed, percentage fixed, and the first errors in input order."""
    first = (
        outcomes.filter(~F.col("ok"))
        .select(order, F.concat_ws(": ", "name", "err").alias("line"))
        .orderBy(order)
        .limit(samples)
        .agg(F.sort_array(F.collect_list(F.struct(order, "line"))).alias("lines"))
        .select(F.array_join("lines.line", "; "))
    )
    return outcomes.agg(
        F.count_if("ok").alias("fixed"),
        F.count_if(~F.col("ok")).alias("failed"),
        (F.try_divide(F.count_if("ok"), F.count("*")) * 100).alias("fixed_pct"),
    ).withColumn("first_errors", first.scalar())


def repair_progress(outcomes: DataFrame, order: str, every: int = PROGRESS_EVERY) -> DataFrame:
    """Running fixed and failed counts, at every ``every`` outcomes and at the end."""
    counted = stage(
        running_totals(
            outcomes.select(order, "ok"),
            [],
            [order],
            {
                "done": F.lit(1),
                "fixed": F.col("ok").cast("long"),
                "failed": (~F.col("ok")).cast("long"),
            },
        ).drop("ok"),
        "progress",
    )
    return (
        counted.withColumn("total", counted.agg(F.max("done")).scalar())
        .filter((F.col("done") % every == 0) | (F.col("done") == F.col("total")))
        .withColumn("done_pct", F.col("done") / F.col("total") * 100)
        .select("done", "total", "done_pct", "fixed", "failed")
    )
