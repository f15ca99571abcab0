"""Queries on batch timings and repair outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.functions import paths
from assetflow.operators import inventory, report, video
from assetflow.plans.catalog import query
from assetflow.plans.jobs import quality_report
from assetflow.shared import new_path
from assetflow.sources import reports, views


def _timings(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.TIMINGS)


def _excluded(spark: SparkSession, sf: str) -> DataFrame:
    """Videos the accelerated engine cannot take, as a row of the report."""
    codecs = video.codec_diagnostics(views.view(spark, sf, views.VIDEO_PROBE))
    skipped = F.coalesce(F.sum(F.when(F.col("status") == "SKIP", F.col("num_files"))), F.lit(0))
    return codecs.agg(skipped.alias("accel_excluded")).withColumn("file_type", F.lit("mp4"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return report.benchmark_report(_timings(spark, sf), excluded=_excluded(spark, sf))


_EXCLUDED_SQL = """(select count(*) from video_probe
    where codec not in ('h264', 'avc1', 'hevc', 'hev1', 'h265', 'vp09', 'vp9'))"""

_REPORT_SQL = f"""
    select file_type, num_files, round(baseline_sec, 6) as baseline_sec, round(accel_sec, 6) as accel_sec,
           round(baseline_avg_ms, 6) as baseline_avg_ms, round(accel_avg_ms, 6) as accel_avg_ms,
           round(speedup_ratio, 6) as speedup_ratio, baseline_errors, accel_errors,
           case when file_type = 'mp4' then {_EXCLUDED_SQL} else 0 end as accel_excluded, data_quality
    from report
"""
_REPORT_DOUBLES = ("baseline_sec", "accel_sec", "baseline_avg_ms", "accel_avg_ms", "speedup_ratio")


@query(
    "quality_report",
    f"""select r.*, i.folder, i.inventory_files, i.total_bytes from ({_REPORT_SQL}) r join
          (select ext, folder, count(*) as inventory_files, cast(sum(size_bytes) as bigint) as total_bytes
           from files where ext is not null group by ext, folder) i on i.ext = r.file_type
        order by file_type""",
    ("files", "video_probe", "report"),
)
def flagship(spark, sf):
    """The quality report next to the inventory."""
    files = inventory.classify(views.view(spark, sf, views.ASSETS))
    joined = quality_report(files, _timings(spark, sf), _excluded(spark, sf))
    return _rounded(joined, *_REPORT_DOUBLES)


@query(
    "bench_by_type",
    """select file_type, num_files, round(baseline_sec, 6) as baseline_sec, round(accel_sec, 6) as accel_sec,
              baseline_ok_files, accel_ok_files, baseline_errors, accel_errors, baseline_batches, accel_batches
       from bench""",
    ("bench",),
)
def bench_by_type(spark, sf):
    return _rounded(report.bench_by_type(_timings(spark, sf)), "baseline_sec", "accel_sec")


@query(
    "bench_averages",
    """select file_type, round(baseline_avg_ms, 6) as baseline_avg_ms, round(accel_avg_ms, 6) as accel_avg_ms,
         round(case when baseline_ok_files = 0 then 0 else baseline_sec / baseline_ok_files * 1000 end, 6) as baseline_ok_avg_ms,
         round(case when accel_ok_files = 0 then 0 else accel_sec / accel_ok_files * 1000 end, 6) as accel_ok_avg_ms
       from report""",
    ("report",),
)
def bench_averages(spark, sf):
    averages = ("baseline_avg_ms", "accel_avg_ms", "baseline_ok_avg_ms", "accel_ok_avg_ms")
    summary = report.with_averages(report.bench_by_type(_timings(spark, sf)))
    return _rounded(summary.select("file_type", *averages), *averages)


@query("bench_speedup", "select file_type, round(speedup_ratio, 6) as speedup_ratio from report", ("report",))
def bench_speedup(spark, sf):
    summary = report.with_quality(report.bench_by_type(_timings(spark, sf)))
    return _rounded(summary.select("file_type", "speedup_ratio"), "speedup_ratio")


def _rates(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    summary = report.bench_by_type(_timings(spark, sf))
    flags = report.with_quality(summary, unit)
    return flags.select("file_type", F.round(report.err_rate(unit), 6).alias("err_rate"))


@query("err_rate_file", "select file_type, round(file_rate, 6) as err_rate from report", ("report",))
def err_rate_file(spark, sf):
    return _rates(spark, sf, "file")


@query("err_rate_batch", "select file_type, round(rate, 6) as err_rate from report", ("report",))
def err_rate_batch(spark, sf):
    return _rates(spark, sf, "batch")


@query("quality_flag", "select file_type, data_quality from report", ("report",))
def quality_flag(spark, sf):
    return report.with_quality(report.bench_by_type(_timings(spark, sf))).select("file_type", "data_quality")


@query(
    "report_unreliable",
    f"select * from ({_REPORT_SQL}) where data_quality <> 'OK'",
    ("video_probe", "report"),
)
def report_unreliable(spark, sf):
    return _rounded(report.unreliable(_report(spark, sf)), *_REPORT_DOUBLES)


_PUBLICATION_SQL = """
    select file_type, num_files, round(baseline_avg_ms, 2) as baseline_avg_ms,
           round(accel_avg_ms, 2) as accel_avg_ms, round(speedup_ratio, 2) as speedup_ratio
    from report where data_quality = 'OK'
"""


@query("report_publication", _PUBLICATION_SQL, ("report",))
def report_publication(spark, sf):
    return report.publication(_report(spark, sf))


@query("sort_by_type", f"{_REPORT_SQL} order by file_type", ("video_probe", "report"))
def sort_by_type(spark, sf):
    return _rounded(_report(spark, sf), *_REPORT_DOUBLES).orderBy("file_type")


@query("write_report_csv", _REPORT_SQL, ("video_probe", "report"))
def write_report_csv(spark, sf):
    path = new_path(spark, "report")
    reports.write_report_csv(_report(spark, sf), path)
    return _rounded(reports.read_report_csv(spark, path), *_REPORT_DOUBLES)


@query("read_report_csv", _PUBLICATION_SQL, ("report",))
def read_report_csv(spark, sf):
    path = new_path(spark, "report")
    for _ in range(2):  # made the first time, read the second time
        stored = reports.load_or_make_report(spark, path, lambda: _report(spark, sf), reuse=True)
    return report.publication(stored)


@query(
    "join_zero_fill",
    """select t.raw_ext as file_type, coalesce(num_files, 0) as num_files, coalesce(accel_errors, 0) as accel_errors,
              round(coalesce(baseline_sec, 0), 6) as baseline_sec, round(coalesce(accel_sec, 0), 6) as accel_sec
       from (select distinct raw_ext from files) t left join bench b on b.file_type = t.raw_ext""",
    ("files", "bench"),
)
def join_zero_fill(spark, sf):
    # All types there are in the collection, the ones nobody times included.
    listing = views.view(spark, sf, views.ASSETS)
    types = listing.select(paths.extension(F.col("path")).alias("file_type")).distinct()
    filled = report.zero_fill(report.bench_by_type(_timings(spark, sf)), types)
    columns = ("file_type", "num_files", "accel_errors", "baseline_sec", "accel_sec")
    return _rounded(filled.select(*columns), "baseline_sec", "accel_sec")


# ------------------------------------------------------------------ curve

_RANKED_SQL = """
    select *, row_number() over (partition by file_type, engine order by batch_id) as rn from timings
"""
_CHECKPOINTS_SQL = "select unnest([10, 50, 100, 250, 500, 1000, 2000, 5000])"


_FILES_SQL = """
    select *, cast(sum(n_files) over (partition by file_type, engine order by batch_id) as bigint) as files
    from timings
"""


@query(
    "speedup_curve",
    f"""select num_files, round(b, 6) as baseline_sec, round(a, 6) as accel_sec,
               round(case when a > 0 then b / a end, 6) as speedup_ratio from
          (select c.n as num_files,
                  coalesce(sum(elapsed_sec) filter (engine = 'baseline' and not failed), 0) as b,
                  coalesce(sum(elapsed_sec) filter (engine = 'accel' and not failed), 0) as a
           from ({_FILES_SQL}) r join
             (select n from ({_CHECKPOINTS_SQL} as n) where n <= (select max(files) from ({_FILES_SQL}))
              union select max(files) from ({_FILES_SQL})) c on r.files <= c.n
           group by c.n)""",
    ("timings",),
)
def speedup_curve(spark, sf):
    curve = report.speedup_curve(_timings(spark, sf))
    return _rounded(curve, "baseline_sec", "accel_sec", "speedup_ratio")


@query(
    "join_checkpoint",
    f"""select file_type, engine, cast(n as bigint) as checkpoint, count(*) as units,
               round(coalesce(sum(elapsed_sec) filter (not failed), 0), 6) as sec
        from ({_RANKED_SQL}) join ({_CHECKPOINTS_SQL} as n) on rn <= n group by file_type, engine, n""",
    ("timings",),
)
def join_checkpoint(spark, sf):
    return _rounded(report.totals_at_checkpoints(_timings(spark, sf)), "sec")


# ------------------------------------------------------------------ repair outcomes


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.OUTCOMES)


@query(
    "repair_summary",
    """select count(*) filter (ok) as fixed, count(*) filter (not ok) as failed,
              round(count(*) filter (ok) / count(*) * 100, 6) as fixed_pct,
              (select string_agg(name || ': ' || err, '; ' order by seq) from
                 (select * from outcomes where not ok order by seq limit 5)) as first_errors
       from outcomes""",
    ("outcomes",),
)
def repair_summary(spark, sf):
    return _rounded(report.repair_summary(_outcomes(spark, sf), "seq"), "fixed_pct")


@query(
    "repair_progress",
    """select done, total, round(done / total * 100, 6) as done_pct, fixed, done - fixed as failed from
         (select row_number() over (order by seq) as done, count(*) over () as total,
                 cast(sum(case when ok then 1 else 0 end) over (order by seq) as bigint) as fixed from outcomes)
       where done % 250 = 0 or done = total""",
    ("outcomes",),
)
def repair_progress(spark, sf):
    return _rounded(report.repair_progress(_outcomes(spark, sf), "seq"), "done_pct")


@query(
    "limit_slice",
    "select seq, name, err from outcomes where not ok order by seq limit 5",
    ("outcomes",),
)
def limit_slice(spark, sf):
    return (
        _outcomes(spark, sf).filter(~F.col("ok")).select("seq", "name", "err").orderBy("seq").limit(5)
    )
