"""User-supplied batch functions, timed and with failures narrowed down to single files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.shared import spread, stage

BatchFunction = Callable[[pd.DataFrame], object]

# Parts of a failing batch up to this size are halved within the task that found the failure; larger
# ones become the groups of the next round. The files found are the same.
TASK_FILES = 64
_GROUP, _FILLED = "__isolate_group", "__isolate_filled_"
_ROW, _PART, _SETTLED, _ERROR, _SEC = (f"__isolate_{c}" for c in ("row", "part", "settled", "error", "sec"))


def _error(fn: BatchFunction, pdf: pd.DataFrame) -> str | None:
    try:
        fn(pdf)
        return None
    except Exception as exc:
        return str(exc)


def _timed(fn: BatchFunction, pdf: pd.DataFrame) -> tuple[float | None, str | None]:
    """(seconds, None) of a run, or (None, its error)."""
    start = time.perf_counter()
    error = _error(fn, pdf)
    return (time.perf_counter() - start if error is None else None), error


def batch_apply_timed(batches: DataFrame, keys: Sequence[str], fn: BatchFunction) -> DataFrame:
    """Run ``fn`` on each batch: keys, n_files, elapsed_sec, error.

    A failing batch gives a null time and its message; it never stops the job. ``keys`` must
    identify batches of bounded size, as ``batch_assign`` makes them.
    """
    fields = ", ".join(f"{k} {batches.schema[k].dataType.simpleString()}" for k in keys)
    names = batches.columns
    exact = [f.name for f in batches.schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_groups(chunks):
            plain = pdf[names]
            # With a null elsewhere in the chunk they came as other types.
            other = [c for c in exact if pdf[c].dtype != pdf[_FILLED + c].dtype]
            missing = {c: pdf[c].isna().to_numpy() for c in other}
            times, errors = [], []
            ends = [*starts[1:], len(pdf)]
            for lo, hi in zip(starts, ends, strict=True):
                files = plain.iloc[lo:hi].reset_index(drop=True)
                for c in other:
                    if not missing[c][lo:hi].any():
                        files[c] = pdf[_FILLED + c].to_numpy()[lo:hi]
                elapsed, error = _timed(fn, files)
                times.append(elapsed)
                errors.append(error)
            found = {}
            for k in keys:
                found[k] = pdf[k].iloc[starts].array
                if k in other:
                    filled = pdf[_FILLED + k].iloc[starts]
                    found[k] = filled.astype(object).where(~missing[k][starts], None).array
            n_files = [hi - lo for lo, hi in zip(starts, ends, strict=True)]
            yield pd.DataFrame(
                {**found, "n_files": n_files, "elapsed_sec": pd.array(times, "Float64"), "error": pd.array(errors, object)}
            )

    filled = {_FILLED + c: F.coalesce(c, F.lit(0).cast(batches.schema[c].dataType)) for c in exact}
    group = F.xxhash64(*keys, *[F.isnull(k) for k in keys]) if keys else F.lit(0)
    return (
        spread(batches.withColumns({**filled, _GROUP: group}), *keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(run, f"{fields}, n_files long, elapsed_sec double, error string")
    )


def _whole_groups(chunks: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Sorted rows in frames that hold whole groups, and where these start."""
    held: list[pd.DataFrame] = []
    for chunk in chunks:
        if not len(chunk):
            continue
        group = chunk[_GROUP].to_numpy()
        starts = [int(i) for i in (group[1:] != group[:-1]).nonzero()[0] + 1]
        if held and held[0][_GROUP].iloc[0] != group[0]:
            starts.insert(0, 0)
        if not starts:
            held.append(chunk)
            continue
        pdf = pd.concat([*held, chunk.iloc[: starts[-1]]], ignore_index=True)
        before = len(pdf) - starts[-1]
        yield pdf, [0, *[before + i for i in starts[:-1] if before + i]]
        held = [chunk.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True), [0]


def batch_key(batches: DataFrame) -> list[str]:
    """The columns that tell batches apart: batch ids start anew with each type, and with each
    codec where batches are made within codecs."""
    return [c for c in ("file_type", "codec", "batch_id") if c in batches.columns]


def time_engines(batches: DataFrame, engines: dict[str, BatchFunction]) -> DataFrame:
    """Run every engine's function on every batch: the ``timings`` that reports are made from.

    ``batches`` needs file_type and batch_id, and codec if batches were made within codecs. Runs
    when called and stores what was measured, so reports on it do not measure again.
    """
    keys = batch_key(batches)
    runs = [
        batch_apply_timed(batches, keys, fn).withColumn("engine", F.lit(engine))
        for engine, fn in engines.items()
    ]
    timings = reduce(DataFrame.unionByName, runs).withColumn("failed", F.col("error").isNotNull())
    return stage(timings, "timings")


def _halved(fn: BatchFunction, pdf: pd.DataFrame, error: str) -> list[str | None]:
    """The error of each file of a part that failed with ``error``."""
    errors: list[str | None] = [None] * len(pdf)
    pending = [(0, len(pdf), error)]
    while pending:
        lo, hi, failure = pending.pop()
        if hi - lo == 1:
            errors[lo] = failure
            continue
        mid = (lo + hi) // 2
        for part in ((lo, mid), (mid, hi)):
            failure = _error(fn, pdf.iloc[slice(*part)])
            if failure is not None:
                pending.append((*part, failure))
    return errors


def isolate_bad(
    batches: DataFrame,
    keys: Sequence[str],
    id_columns: Sequence[str],
    fn: BatchFunction,
    task_files: int = TASK_FILES,
) -> DataFrame:
    """Find the files on which ``fn`` fails: id columns, ok, error, good_sec; one row per input row.

    ``fn`` runs on a whole batch; only a failing batch is halved until single files fail. The halves
    of all failing parts of all batches are run at once, as groups of one Spark round, so a batch of n
    files takes some log2(n / task_files) rounds however many of its files are bad, and d bad files
    some 2 d log2(n) runs; parts of up to ``task_files`` files are halved where they failed. A
    round moves the rows of failing parts only. ``good_sec`` is the time of a run on the good
    files of the batch together, null if there are none or they fail together. Runs when called,
    and stores what was found. Null keys form a batch like any other. Input columns may have any
    name that does not start with ``__isolate_``. For a function that works row by row, give
    single-file batches or use a column expression.
    """
    names, ids = batches.columns, list(id_columns)
    fields = ", ".join(f"{c} {batches.schema[c].dataType.simpleString()}" for c in ids)
    rows = stage(batches.withColumn(_ROW, F.monotonically_increasing_id()), "isolate-rows")

    def good_seconds(files: pd.DataFrame, errors: pd.Series) -> float | None:
        fine = errors.isna()
        return _timed(fn, files[fine].reset_index(drop=True))[0] if fine.any() else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_ROW, ignore_index=True)
        files, part = pdf[names], pdf[_PART]
        good_sec, error = _timed(fn, files)
        errors = pd.Series([None] * len(pdf), dtype=object)
        settled = error is None or len(pdf) <= task_files
        if not settled:
            part = 2 * part + (pdf.index >= len(pdf) // 2)
        elif error is not None:
            errors = pd.Series(_halved(fn, files, error), dtype=object)
            if part[0] == 1:
                good_sec = good_seconds(files, errors)
        found = {_ROW: pdf[_ROW], _PART: part, _SETTLED: settled, _ERROR: errors, _SEC: good_sec}
        return pdf[ids].assign(**found)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_ROW, ignore_index=True)
        return pdf[ids].assign(**{_ERROR: pdf[_ERROR], _SEC: good_seconds(pdf[names], pdf[_ERROR])})

    result = [*ids, F.col(_ERROR).isNull().alias("ok"), F.col(_ERROR).alias("error"), F.col(_SEC).alias("good_sec")]
    outcome_type = f"{fields}, {_ROW} long, {_PART} long, {_SETTLED} boolean, {_ERROR} string, {_SEC} double"
    pending, parts, whole = rows.withColumn(_PART, F.lit(1).cast("long")), [], None
    while True:
        tried = spread(pending, *keys, _PART).groupBy(*keys, _PART).applyInPandas(run, outcome_type)
        outcome = stage(tried, "isolate-round")
        if whole is None:
            # Batches that need no second round are done, their good files timed.
            whole = outcome.where(_SETTLED).select(*result)
        else:
            parts.append(outcome.where(_SETTLED).select(_ROW, _ERROR))
        failing = outcome.where(~F.col(_SETTLED)).select(_ROW, _PART)
        if failing.isEmpty():
            break
        pending = stage(pending.drop(_PART).join(failing, _ROW), "isolate-pending")
    if not parts:
        return whole
    halved = rows.join(reduce(DataFrame.union, parts), _ROW)
    timed = spread(halved, *keys).groupBy(*keys).applyInPandas(finish, f"{fields}, {_ERROR} string, {_SEC} double")
    return whole.unionByName(stage(timed, "isolated").select(*result))


def bad_only(isolated: DataFrame) -> DataFrame:
    return isolated.filter(~F.col("ok"))
