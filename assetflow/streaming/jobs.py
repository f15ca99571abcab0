"""The inventory and the error report on files that keep arriving (extensions).

Every job keeps its running state in the engine's state store (RocksDB, whose key files have a filter
each), so that a micro-batch costs what arrives with it and not what came before. Windows and sessions
close when the watermark passes their end and are then written once, to an append-only table; state
holds open ones only. What arrives after its window was closed is not lost: it goes to the same table
marked as late. The totals of a job are what is closed, late and still open, put together; they do not
depend on how many files a trigger takes. ``run_available`` processes what has arrived and stops; a
service would start the same job with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.constants import BATCH_SIZE
from assetflow.operators.inventory import classify, supported
from assetflow.shared import is_folder, list_names, new_path, path_exists, remove_path, stage
from assetflow.streaming import state

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # A micro-batch writes its changes, not a snapshot of all keys.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DELAY = "1 hour"


@dataclass(frozen=True)
class Results:
    """What a job has so far: rows that are final, rows that came late, and what is still open."""

    closed: DataFrame
    late: DataFrame
    open: DataFrame


@dataclass(frozen=True)
class Job:
    """``plan``: the streaming result of a stream of rows; ``totals``: of all results so far.

    With ``complete``, each micro-batch gives the whole result anew, of which the last is kept; else
    rows are appended once, and ``variable`` names the state that holds what is still open, which
    ``opened`` turns into rows like those of the plan.
    """

    plan: Callable[[DataFrame], DataFrame]
    totals: Callable[[Results], DataFrame] = lambda results: results.closed
    complete: bool = False
    variable: str | None = None
    opened: Callable[[DataFrame], DataFrame] | None = None


def file_arrivals(spark: SparkSession, root: str, max_files: int = BATCH_SIZE) -> DataFrame:
    """Files as they appear below ``root``: path, size_bytes, modified_at."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return files.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")
    )


def table_arrivals(
    spark: SparkSession, folder: str, name: str, max_files: int = BATCH_SIZE
) -> DataFrame:
    """A table's Parquet files as a stream, whether the table is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option(
        "maxFilesPerTrigger", max_files
    )
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def arrival_counts() -> Job:
    """Files and bytes so far per supported type; state is one sum per type."""

    def plan(files: DataFrame) -> DataFrame:
        return (
            supported(classify(files))
            .groupBy("ext")
            .agg(F.count("*").alias("num_files"), F.sum("size_bytes").alias("total_bytes"))
        )

    return Job(plan, complete=True)


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with a time, with a watermark on it.

    The stateful operators take times as microseconds: rows behind the watermark have to reach them,
    while the engine drops rows by a column that carries the watermark.
    """
    times = rows.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts").isNotNull())
    return times.withWatermark("ts", delay)


def error_rate_by_window(width: str = "1 day", delay: str = DELAY) -> Job:
    """Attempted and failed batches per type and time window, with the rate over all of them.

    Rows of a micro-batch are counted before they are shuffled, so a type with most of the rows
    sends no more than a few. A window is closed when ``delay`` has passed since its end. A row
    without a time is left out, a null ``failed`` is none.
    """
    def plan(timings: DataFrame) -> DataFrame:
        rows = _timed(timings, delay).withColumn("w", F.window("ts", width))
        keyed = rows.select(
            F.unix_micros("w.start").alias("window_us"),
            F.unix_micros("w.end").alias("end_us"),
            "file_type",
            F.coalesce(F.col("failed"), F.lit(False)).cast("long").alias("failed_batches"),
        )
        counted = state.count_in_batches(keyed)
        return counted.groupBy("window_us", "end_us", "file_type").transformWithStateInPandas(
            state.WindowCounts(), state.WINDOW_ROWS, "append", "eventTime"
        )

    def opened(stored: DataFrame) -> DataFrame:
        return stored.select(
            F.lit("open").alias("kind"),
            "key.window_us",
            "key.file_type",
            "value.batches",
            "value.failed_batches",
        )

    def totals(found: Results) -> DataFrame:
        rows = found.closed.unionByName(found.late).unionByName(found.open)
        added = rows.groupBy("window_us", "file_type").agg(
            F.sum("batches").alias("batches"), F.sum("failed_batches").alias("failed_batches")
        )
        return added.select(
            F.timestamp_micros("window_us").alias("window_start"),
            "file_type",
            "batches",
            "failed_batches",
            (F.col("failed_batches") / F.col("batches")).alias("err_rate"),
        )

    return Job(plan, totals, variable="counts", opened=opened)


def sessions(
    key: str,
    gap: str = "2 hours",
    delay: str = DELAY,
    key_type: str = "string",
    buckets: int = 256,
) -> Job:
    """Bursts of activity per key of type ``key_type``, ended by a pause of ``gap``.

    Keys share ``buckets`` states, each worked on as arrays; rows are merged to bursts before they are
    shuffled. A session is written when the watermark has passed its end. A burst that begins behind
    the watermark is late: only for keys that have such bursts, sessions are joined up again in the
    totals. A row without a time is left out; a null key is a key.
    """
    def plan(events: DataFrame) -> DataFrame:
        bursts = state.bursts_in_batches(
            _timed(events, delay).select(
                F.col(key).cast("string").alias("key"),
                F.unix_micros("ts").alias("start_us"),
                F.unix_micros(F.col("ts") + F.expr(f"interval {gap}")).alias("end_us"),
            )
        )
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
        return bursts.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
            state.OpenSessions(), state.SESSION_ROWS, "append", "eventTime"
        )

    def opened(stored: DataFrame) -> DataFrame:
        each = stored.select(F.explode(F.arrays_zip("value.keys", "value.starts", "value.ends", "value.counts")).alias("s"))
        return each.select(
            F.lit("open").alias("kind"),
            F.col("s.keys").alias("key"),
            F.col("s.starts").alias("start_us"),
            F.col("s.ends").alias("end_us"),
            F.col("s.counts").alias("num_events"),
        )

    def totals(found: Results) -> DataFrame:
        rows = found.closed.unionByName(found.late).unionByName(found.open)
        again = found.late.select(F.col("key").alias("late_key")).distinct()
        same = F.col("key").eqNullSafe(F.col("late_key"))
        right = rows.join(again, same, "left_anti").drop("kind")
        joined = _joined_up(rows.join(again, same, "left_semi").drop("kind"))
        return right.unionByName(joined).select(
            F.col("key").cast(key_type).alias(key),
            F.timestamp_micros("start_us").alias("session_start"),
            F.timestamp_micros("end_us").alias("session_end"),
            "num_events",
        )

    return Job(plan, totals, variable="sessions", opened=opened)


def _joined_up(rows: DataFrame) -> DataFrame:
    """Sessions and bursts of a key that overlap, as one session."""
    in_order = Window.partitionBy("key").orderBy("start_us", "end_us")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start_us") < F.max("end_us").over(earlier), 0).otherwise(1)
    numbered = rows.withColumn("fresh", fresh).withColumn(
        "session", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy("key", "session").agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.sum("num_events").alias("num_events"),
    ).drop("session")


def first_deliveries(keys: Sequence[str], within: str | None = None) -> Job:
    """Each file once, however often it is delivered again.

    Without ``within``, keys are kept for good and a repetition is found however late it comes: a look
    into the store's key files, most of which their filters spare, and never into earlier rows. With
    ``within``, keys are forgotten when the watermark on ``ts`` has passed them by so long, and state
    stays bounded.
    """

    def plan(files: DataFrame) -> DataFrame:
        if within is None:
            return files.dropDuplicates(list(keys))
        timed = files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within)
        return timed.dropDuplicatesWithinWatermark(list(keys))

    return Job(plan)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own settings come back."""
    before = {name: spark.conf.get(name, None) for name in _STORE}
    try:
        for name, value in _STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _keep_last(out: str) -> Callable[[DataFrame, int], None]:
    """Write each whole result to a folder of its own and drop those before the last two."""

    def store(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        for name in list_names(spark, f"{out}/rows"):
            number = name.removeprefix("batch_id=")
            if number.isdigit() and int(number) < batch_id - 1:
                remove_path(spark, f"{out}/rows/{name}")

    return store


def run_available(stream: DataFrame, job: Job | None = None, path: str | None = None) -> DataFrame:
    """Process everything that has arrived; returns the totals over all that arrived so far.

    Results go to Parquet below ``path``, next to the stream's progress and state: running again with
    the same path takes only what arrived since and adds it; with nothing new it returns the same
    totals. A micro-batch that is repeated after a failure counts once. Without a path, a new one in
    the shared folder is used.
    """
    job = job or Job(lambda rows: rows)
    out = path or new_path(stream.sparkSession, "stream")
    advance(stream, job, out)
    return job.totals(results(stream, job, out))


def advance(stream: DataFrame, job: Job, path: str) -> list[dict]:
    """Process everything that has arrived; returns the engine's report on each micro-batch."""
    with _state_store(stream.sparkSession):
        writer = (
            job.plan(stream)
            .writeStream.trigger(availableNow=True)
            .option("checkpointLocation", f"{path}/checkpoint")
        )
        if job.complete:
            query = writer.outputMode("complete").foreachBatch(_keep_last(path)).start()
        else:
            query = writer.outputMode("append").format("parquet").start(f"{path}/rows")
        query.awaitTermination()
    return [dict(p) for p in query.recentProgress]


def results(stream: DataFrame, job: Job, path: str) -> Results:
    """What a job has written below ``path`` so far, and what its state holds."""
    spark = stream.sparkSession
    schema = job.plan(stream).schema
    none = spark.createDataFrame([], schema)
    if not path_exists(spark, f"{path}/rows"):
        return Results(none, none, none)
    if job.complete:
        rows = spark.read.schema(f"{schema.toDDL()}, batch_id long").parquet(f"{path}/rows")
        last = rows.agg(F.max("batch_id")).first()[0]
        return Results(rows.where(F.col("batch_id") == last).drop("batch_id"), none, none)
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if job.variable is None:
        return Results(rows, none, none)
    with _state_store(spark):
        # Only what is open, and stored: a later run goes on changing the state.
        stored = spark.read.format("statestore").option("stateVarName", job.variable)
        opened = stage(job.opened(stored.load(f"{path}/checkpoint")), "open")
    return Results(
        rows.where(F.col("kind") == "closed"), rows.where(F.col("kind") == "late"), opened
    )
