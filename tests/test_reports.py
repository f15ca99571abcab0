import pytest
from pyspark.sql import functions as F

from assetflow.operators import report

TIMINGS = "batch_id long, file_type string, engine string, n_files long, elapsed_sec double, failed boolean"

# A recorded run: type, files, seconds per engine, failed and attempted accelerated batches, and
# the averages, ratio and flag that were reported for it. These are fixed values.
RECORDED = [
    ("json", 3200, 40.129615241989086, 2.273406968000927, 0, 16, 12.54050476312159, 0.7104396775002897, 17.651751669115463, "OK"),
    ("mp4", 1087, 26.818313315001433, 0.0, 6, 6, 24.671861375346307, 0.0, None, "UNRELIABLE (err_rate=100.0%)"),
    ("txt", 12323, 30.468380880985933, 2.7615586619867827, 0, 62, 2.4724807985868646, 0.22409791949904914, 11.033037719019767, "OK"),
    ("wav", 12800, 114.1548103139794, 67.99859995400038, 0, 64, 8.91834455577964, 5.31239062140628, 1.6787817747895208, "OK"),
    ("xlsx", 3200, 270.16883862200484, 14.54466933303047, 0, 16, 84.42776206937651, 4.545209166572022, 18.575110402026137, "OK"),
]


def test_recorded_run_is_reproduced(spark):
    sums = spark.createDataFrame(
        [(t, n, b, a, n, n, 0, e, k, k) for t, n, b, a, e, k, *_ in RECORDED],
        "file_type string, num_files long, baseline_sec double, accel_sec double, baseline_ok_files long, "
        "accel_ok_files long, baseline_errors long, accel_errors long, baseline_batches long, accel_batches long",
    )
    got = report.with_quality(report.with_averages(sums)).orderBy("file_type").collect()
    for row, (*_, baseline_ms, accel_ms, ratio, flag) in zip(got, RECORDED):
        assert (row.baseline_avg_ms, row.accel_avg_ms) == pytest.approx((baseline_ms, accel_ms))
        assert row.speedup_ratio == (None if ratio is None else pytest.approx(ratio))
        assert row.data_quality == flag
    table = report.publication(report.with_quality(report.with_averages(sums)).withColumn("x", F.lit(1)))
    assert [tuple(r) for r in table.orderBy("file_type").collect()] == [
        ("json", 3200, 12.54, 0.71, 17.65),
        ("txt", 12323, 2.47, 0.22, 11.03),
        ("wav", 12800, 8.92, 5.31, 1.68),
        ("xlsx", 3200, 84.43, 4.55, 18.58),
    ]


def test_report_with_types_nobody_timed(spark):
    timings = spark.createDataFrame(
        [
            (1, "txt", "baseline", 10, 2.0, False),
            (1, "txt", "accel", 10, 1.0, False),
            (2, "txt", "accel", 20, None, True),
        ],
        TIMINGS,
    )
    types = spark.createDataFrame([("txt",), ("wav",)], "file_type string")
    excluded = spark.createDataFrame([("wav", 7)], "file_type string, accel_excluded long")
    txt, wav = report.benchmark_report(timings, types, excluded).collect()
    assert (txt.num_files, txt.accel_errors, txt.data_quality) == (30, 1, "UNRELIABLE (err_rate=50.0%)")
    assert (wav.num_files, wav.accel_excluded, wav.baseline_avg_ms, wav.speedup_ratio) == (0, 7, 0.0, None)
    (by_file,) = report.benchmark_report(timings, unit="file").collect()
    assert (by_file.speedup_ratio, by_file.data_quality) == (2.0, "OK")


def curve(spark, sizes):
    rows = [
        (i, t, e, 1, 1.0 if e == "baseline" else 0.5, False)
        for t, n in sizes.items()
        for e in ("baseline", "accel")
        for i in range(n)
    ]
    return report.speedup_curve(spark.createDataFrame(rows, TIMINGS)).orderBy("num_files").collect()


@pytest.mark.parametrize(
    "largest, marks",
    [(12_323, [10, 50, 100, 250, 500, 1000, 2000, 5000, 12_323]), (500, [10, 50, 100, 250, 500]), (7, [7]), (0, [])],
)
def test_curve_checkpoints(spark, largest, marks):
    got = curve(spark, {"txt": largest, "wav": min(largest, 60)})
    assert [r.num_files for r in got] == marks
    for r in got:
        units = r.num_files + min(r.num_files, 60)
        assert (r.baseline_sec, r.accel_sec, r.speedup_ratio) == (units, units / 2, 2.0)


def test_curve_without_accelerated_time(spark):
    df = spark.createDataFrame([(1, "txt", "baseline", 1, 2.0, False), (1, "txt", "accel", 1, None, True)], TIMINGS)
    assert [tuple(r) for r in report.speedup_curve(df).collect()] == [(1, 2.0, 0.0, None)]


def test_repair_reports(spark):
    rows = [(i, f"v{i}", i % 4 != 0, None if i % 4 else f"e{i}") for i in range(1, 604)]
    outcomes = spark.createDataFrame(rows, "seq long, name string, ok boolean, err string").repartition(5)
    summary = report.repair_summary(outcomes, "seq").first()
    assert (summary.fixed, summary.failed) == (453, 150)
    assert summary.first_errors == "v4: e4; v8: e8; v12: e12; v16: e16; v20: e20"
    marks = report.repair_progress(outcomes, "seq").orderBy("done").collect()
    assert [(r.done, r.total, r.fixed, r.failed) for r in marks] == [(250, 603, 188, 62), (500, 603, 375, 125), (603, 603, 453, 150)]
