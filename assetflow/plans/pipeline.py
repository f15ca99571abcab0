"""From a collection of files to a benchmark report: the whole run as one job.

Every file type has a pair of engines, functions on a batch of files (path, content): a plain one
that takes file after file, and one that takes the batch at once.
"""

from __future__ import annotations

import csv
import io
import json
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.constants import BATCH_SIZE
from assetflow.operators import batching, inventory, isolate, report, video
from assetflow.plans.jobs import organize_collection
from assetflow.shared import qualified_path, stage
from assetflow.sources import files as file_sources
from assetflow.sources import reports

Engine = Callable[[pd.DataFrame], object]


def _contents(batch: pd.DataFrame) -> list[bytes]:
    return [bytes(c) for c in batch["content"]]


def _texts_one_by_one(batch: pd.DataFrame) -> int:
    return sum(len(c.decode("utf-8", "ignore")) for c in _contents(batch))


def _texts_at_once(batch: pd.DataFrame) -> int:
    texts = b"".join(_contents(batch)).decode("utf-8", "ignore")
    return len(texts)


def _json_one_by_one(batch: pd.DataFrame) -> int:
    return len([json.loads(c) for c in _contents(batch)])


def _json_at_once(batch: pd.DataFrame) -> int:
    docs = json.loads(b"[" + b",".join(_contents(batch)) + b"]")
    if len(docs) != len(batch):
        raise ValueError("a file holds several documents")
    return len(docs)


def _samples(content: bytes) -> np.ndarray:
    with wave.open(io.BytesIO(content)) as clip:
        if clip.getsampwidth() != 2:
            raise ValueError("16-bit samples only")
        return np.frombuffer(clip.readframes(clip.getnframes()), "<i2")


def _waves_one_by_one(batch: pd.DataFrame) -> float:
    return sum(float(np.abs(_samples(c).astype("f8")).mean()) for c in _contents(batch))


def _waves_at_once(batch: pd.DataFrame) -> float:
    return float(np.abs(np.concatenate([_samples(c) for c in _contents(batch)]).astype("f8")).mean())


def _sheets_one_by_one(batch: pd.DataFrame) -> int:
    return sum(len(list(csv.DictReader(io.StringIO(c.decode())))) for c in _contents(batch))


def _sheets_at_once(batch: pd.DataFrame) -> int:
    return sum(pa_csv.read_csv(io.BytesIO(c)).num_rows for c in _contents(batch))


def _probes_one_by_one(batch: pd.DataFrame) -> int:
    return len([json.loads(c).get("codec") for c in _contents(batch)])


def _probes_at_once(batch: pd.DataFrame) -> int:
    codecs = pa.array([d.get("codec") for d in json.loads(b"[" + b",".join(_contents(batch)) + b"]")], pa.string())
    if codecs.null_count:
        raise ValueError(f"{codecs.null_count} of {len(batch)} videos cannot be opened")
    return pc.count_distinct(codecs).as_py()


# File type -> (plain engine, accelerated engine). Add an entry to extend.
ENGINES: dict[str, tuple[Engine, Engine]] = {
    "txt": (_texts_one_by_one, _texts_at_once),
    "json": (_json_one_by_one, _json_at_once),
    "wav": (_waves_one_by_one, _waves_at_once),
    "xlsx": (_sheets_one_by_one, _sheets_at_once),
    "mp4": (_probes_one_by_one, _probes_at_once),
}


def _for_type(engines: dict[str, tuple[Engine, Engine]], which: int) -> Engine:
    def run(batch: pd.DataFrame) -> object:
        return engines[batch["file_type"].iloc[0]][which](batch)

    return run


def measure_collection(
    files: DataFrame,
    log: str | None = None,
    run_id: str = "run",
    size: int = BATCH_SIZE,
    engines: dict[str, tuple[Engine, Engine]] | None = None,
) -> DataFrame:
    """Benchmark report of ``files``: file_type, path, content, and for videos codec and verdict.

    Batches hold files of one type, and videos of one codec; videos whose verdict is not ``ok`` are
    kept from the accelerated engine. The files of failed batches go to the log at ``log``.
    """
    files = stage(files.select("file_type", "path", "codec", "verdict", "content"), "contents")
    eligible = (F.col("file_type") != "mp4") | F.col("verdict").eqNullSafe(F.lit("ok"))
    keys = files.select("file_type", "path", F.when(eligible, F.col("codec")).alias("codec"), eligible.alias("_ok"))
    numbered = batching.batch_assign(keys, ["file_type", "_ok", "codec"], ["path"], size)
    # What the accelerated engine does not take is a codec of its own.
    numbered = numbered.withColumn("codec", F.when(F.col("_ok"), F.col("codec")).otherwise("excluded"))
    batches = stage(numbered.join(files.select("path", "content"), "path"), "batches")
    pair = engines or ENGINES
    baseline = isolate.time_engines(batches, {"baseline": _for_type(pair, 0)})
    accel = isolate.time_engines(batches.where("_ok"), {"accel": _for_type(pair, 1)})
    timings = baseline.unionByName(accel)
    if log is not None:
        failed = timings.where("failed").select(
            "file_type", F.col("codec").alias("_codec"), "batch_id", "engine", "error"
        )
        of_batch = batches.select("file_type", "codec", "batch_id", "path").join(
            failed, ["file_type", "batch_id"]
        )
        rows = of_batch.where(F.col("codec").eqNullSafe(F.col("_codec"))).drop("_codec")
        reports.append_failure_log(rows, log, run_id)
    excluded = batches.where("not _ok").groupBy("file_type").agg(F.count("*").alias("accel_excluded"))
    types = inventory.category_table(files.sparkSession).select(F.col("ext").alias("file_type"))
    return report.benchmark_report(timings, types, excluded)


def run_pipeline(
    spark: SparkSession,
    root: str,
    destination: str,
    probes: DataFrame | None = None,
    report_path: str | None = None,
    log: str | None = None,
    run_id: str = "run",
    size: int = BATCH_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """Scan ``root``, measure its files, log failures, copy them by category: (report, copies).

    ``probes`` has path and the probe columns of videos; a video without a probe cannot be opened.
    The report goes to CSV at ``report_path``. Run again, nothing is copied twice.
    """
    listed = file_sources.scan_files(spark, root)
    own = F.lit(f"{qualified_path(spark, destination)}/")
    found = inventory.supported(inventory.classify(listed.where(~F.startswith("path", own))))
    contents = file_sources.read_contents(spark, root)
    files = found.join(contents, "path").withColumnRenamed("ext", "file_type")
    if probes is None:
        files = files.withColumns({"codec": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    else:
        files = files.join(video.judge(probes).select("path", "codec", "verdict"), "path", "left")
    measured = stage(measure_collection(files, log, run_id, size), "report")
    if report_path is not None:
        reports.write_report_csv(measured, report_path)
    return measured, organize_collection(spark, root, destination)
