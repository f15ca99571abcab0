import time

import pytest
from pyspark.sql import functions as F

from assetflow.operators import batching, content, inventory, isolate, report
from assetflow.plans.processors import processor_for
from assetflow.sources import views


def files(spark, sizes):
    rows = [(g, f"{g}/{i:06}") for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "g string, path string").repartition(7)


def test_batches_do_not_mix_groups(spark):
    got = batching.batch_assign(files(spark, {"A": 3, "B": 2}), ["g"], ["path"], 2)
    assert sorted((r.path, r.batch_id) for r in got.collect()) == [
        ("A/000000", 0), ("A/000001", 0), ("A/000002", 1), ("B/000000", 0), ("B/000001", 0),
    ]


def test_sizes_follow_from_counts(spark, monkeypatch):
    monkeypatch.setattr(batching, "_BLOCK", 3)
    df = files(spark, {"A": 47, "B": 20, "C": 1})
    sizes = {(r.g, r.batch_id): r.n_files for r in batching.batch_sizes(df, ["g"], 5).collect()}
    assigned = batching.batch_assign(df, ["g"], ["path"], 5).groupBy("g", "batch_id").count()
    assert sizes == {(r.g, r.batch_id): r["count"] for r in assigned.collect()}
    assert sum(sizes.values()) == 68


def test_progress_marks(spark):
    got = batching.progress_marks(files(spark, {"A": 1130}), ["g"], 200).orderBy("batch_id").collect()
    done = [min(start + 200, 1130) for start in range(0, 1130, 200)]
    assert [r.processed for r in got] == [d for d in done if d % 250 < 200]


@pytest.mark.parametrize("n", [3, 1001])
def test_first_n(spark, n):
    got = batching.first_n(files(spark, {"A": 1200, "B": 2}), ["g"], ["path"], n).collect()
    assert sorted(r.path for r in got) == [f"A/{i:06}" for i in range(n)] + ["B/000000", "B/000001"]


def test_isolation_loses_nothing(spark):
    def fail_on_seven(pdf):
        if (pdf["v"] == 7).any():
            raise ValueError("seven")

    df = spark.range(100).selectExpr("id", "id div 50 as b", "id % 50 as v")
    df = df.withColumn("v", F.when(F.col("b") == 1, F.lit(1)).otherwise(F.col("v")))
    got = isolate.isolate_bad(df, ["b"], ["id"], fail_on_seven)
    assert {r.id: r.error for r in got.collect()} == {i: "seven" if i == 7 else None for i in range(100)}
    assert [r.id for r in isolate.bad_only(got).collect()] == [7]
    timed = {r.b: r for r in isolate.batch_apply_timed(df, ["b"], fail_on_seven).collect()}
    assert (timed[0].n_files, timed[0].elapsed_sec, timed[0].error) == (50, None, "seven")
    assert timed[1].elapsed_sec >= 0 and timed[1].error is None


def test_isolation_in_rounds(spark):
    """Ten bad files of 6,000: each is found, in rounds over halves, with few runs."""
    bad = set(range(17, 6000, 600))
    runs, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def fail_on_bad(pdf):
        runs.add(1)
        seen.add(len(pdf))
        spoiled = bad.intersection(pdf["id"])
        if spoiled:
            raise ValueError(f"{len(spoiled)} bad")

    df = spark.range(6200).selectExpr("id", "if(id < 6000, null, id div 100) as b", "cast(null as int) as __error")
    got = isolate.isolate_bad(df.repartition(5), ["b"], ["id", "b"], fail_on_bad)
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(6200))
    assert {r.id: r.error for r in rows if not r.ok} == {i: "1 bad" for i in bad}
    assert all(r.error is None for r in rows if r.ok) and all(r.good_sec >= 0 for r in rows)
    # Three whole batches, two halves of each of at most 10 * 13 failing parts, one run of the good files.
    assert runs.value <= 3 + 2 * 10 * 13 + 1
    assert seen.value <= 6200 + 10 * 2 * 6000 + 6000


@pytest.mark.parametrize("task_files", [1, 2, 5, 64])
def test_isolation_does_not_depend_on_the_size_of_a_task(spark, task_files):
    def fails(pdf):
        if (pdf["v"] < 0).any() or (len(pdf) > 6 and pdf["v"].isna().any()):
            raise ValueError("bad")

    values = [(b, i, -1 if b == 1 and i % 4 == 0 else None if b == 2 and i == 3 else i) for b in range(3) for i in range(9)]
    values += [(3, i, -1) for i in range(5)]
    df = spark.createDataFrame(values, "b long, id long, v long").coalesce(1)
    got = {(r.b, r.id): r for r in isolate.isolate_bad(df, ["b"], ["b", "id"], fails, task_files).collect()}
    assert {k for k, r in got.items() if not r.ok} == {(1, 0), (1, 4), (1, 8)} | {(3, i) for i in range(5)}
    assert len(got) == len(values)
    # Batch 2 fails as a whole only, so its files are all good and cannot be timed together.
    assert {b for (b, _), r in got.items() if r.good_sec is None} == {2, 3}
    empty = isolate.isolate_bad(df.limit(0), ["b"], ["b", "id"], fails, task_files)
    assert (empty.count(), empty.columns) == (0, ["b", "id", "ok", "error", "good_sec"])


def test_report_of_measured_functions(spark):
    def slow(pdf):
        time.sleep(0.02)

    def fails_on_the_last(pdf):
        if (pdf["batch_id"] == 29).any():
            raise RuntimeError("device lost")

    batches = spark.range(300).selectExpr("id", "id div 10 as batch_id", "'wav' as file_type")
    timings = isolate.time_engines(batches, {"baseline": slow, "accel": fails_on_the_last})
    (row,) = report.benchmark_report(timings).collect()
    assert (row.num_files, row.baseline_errors, row.accel_errors, row.data_quality) == (300, 0, 1, "OK")
    assert row.baseline_sec >= 30 * 0.02 and row.speedup_ratio == row.baseline_sec / row.accel_sec
    assert [r.error for r in timings.filter("failed").collect()] == ["device lost"]


def test_split_covers_the_input(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, good boolean")
    good, bad = inventory.split(df, F.col("good"))
    assert [r.id for r in good.collect()] == [1]
    assert sorted(r.id for r in bad.collect()) == [2, 3]


def test_unknown_type_is_refused():
    with pytest.raises(ValueError, match="html"):
        processor_for("html")


def test_padding_to_the_batch(spark):
    clips = [(1, 1, [[1.0], [2.0]]), (2, 1, [[1.0, 2.0, 3.0]]), (3, 2, [[5.0]])]
    df = spark.createDataFrame(clips, "clip_id long, batch_id long, waveform array<array<float>>")
    got = {r.clip_id: r.waveform for r in content.signal_pad(df).collect()}
    assert got == {
        1: [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0]],
        2: [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]],
        3: [[5.0]],
    }


def test_every_sample_of_the_vectors_is_measured(spark):
    sf_dir = "/root/testdata/sf0.001"
    there = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("sum(size(embedding))").first()[0]
    n = F.aggregate(F.transform("waveform", F.size), F.lit(0), lambda a, x: a + x)
    clips = views.signals(spark, sf_dir)
    assert clips.agg(F.sum(n)).first()[0] == there
    assert clips.select(n).distinct().count() > 1


def test_empty_group_size(spark):
    assert inventory.max_group_size(spark.range(0).selectExpr("id as g"), "g").first()[0] == 0


def test_batches_of_different_codecs_stay_apart(spark):
    rows = [("mp4", codec, f"{codec}/{i:02}") for codec in ("h264", "hevc") for i in range(10)]
    found = spark.createDataFrame(rows, "file_type string, codec string, path string")
    batches = batching.batch_assign(found, ["file_type", "codec"], ["path"], 5)
    timings = isolate.time_engines(batches, {"baseline": len, "accel": len})
    assert sorted(r.n_files for r in timings.collect()) == [5] * 8
    row = report.bench_by_type(timings).first()
    assert (row.num_files, row.baseline_batches, row.accel_ok_files) == (20, 4, 20)


def test_curve_counts_files(spark):
    rows = [("txt", i, e, 30, 1.0, False) for i in range(4) for e in ("baseline", "accel")]
    timings = spark.createDataFrame(rows, "file_type string, batch_id long, engine string, n_files long, elapsed_sec double, failed boolean")
    curve = {r.num_files: r.baseline_sec for r in report.speedup_curve(timings, (10, 50, 90, 100)).collect()}
    assert curve == {50: 1.0, 90: 3.0, 100: 3.0, 120: 4.0}


def test_batches_of_one_task_share_python_calls(spark):
    """Small batches reach Python in chunks of many, each whole and with its own types."""

    def kinds(batch):
        raise ValueError(f"{len(batch)} {batch['n'].dtype} {batch['n'].sum():.0f} {list(batch.index)}")

    rows = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, 'a') as codec", "id div 6 as batch_id", "if(id % 50 = 0, null, id) as n", "id"
    )
    timed = isolate.batch_apply_timed(rows.coalesce(1), ["codec", "batch_id"], kinds)
    assert "FlatMapGroups" not in timed._jdf.queryExecution().toString()  # a call for each batch
    found = timed.collect()
    assert len(found) == 1000 and {(r.codec, r.n_files) for r in found} == {(None, 2), ("a", 4)}
    for r in found:
        ids = [i for i in range(6 * r.batch_id, 6 * r.batch_id + 6) if (i % 3 == 0) == (r.codec is None)]
        left = [i for i in ids if i % 50]
        kind = "int64" if len(left) == len(ids) else "float64"
        assert r.error == f"{len(ids)} {kind} {sum(left)} {list(range(len(ids)))}" and r.elapsed_sec is None
