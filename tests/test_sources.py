import io
import os
import wave

import pytest
from pyspark.sql import functions as F

from assetflow.operators import organize
from assetflow.operators.inventory import classify
from assetflow.plans import pipeline
from assetflow.plans.jobs import organize_collection
from assetflow.sources import files, reports, sheets, waveforms


@pytest.fixture
def tree(tmp_path):
    contents = {
        "a.txt": b"one\r\ntwo",
        "sub/a.txt": b"bad \xff byte",
        "sub/deep/A.MP4": b"0" * 50,
        "b.mp4": b"1" * 10,
        "c.mp4": b"2" * 20,
        "notes.bin": b"x",
        "day=1/d.mp4": b"3",
        ".hidden.txt": b"not listed",
    }
    for name, data in contents.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (1_600_000_000, 1_600_000_000))
    return tmp_path / "in"


def test_scan_files(spark, tree):
    found = files.scan_files(spark, str(tree))
    listing = {r.path.removeprefix(f"file:{tree}/"): r.size_bytes for r in found.collect()}
    assert listing == {
        "a.txt": 8,
        "sub/a.txt": 10,
        "sub/deep/A.MP4": 50,
        "b.mp4": 10,
        "c.mp4": 20,
        "notes.bin": 1,
        "day=1/d.mp4": 1,
    }

@pytest.mark.parametrize("at_once", [1, 7, 20_000])
def test_a_listing_in_rounds_is_that_of_spark(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(files, "ENTRIES_AT_ONCE", at_once)
    root = tmp_path / "tree"
    for i in range(40):
        folder = root / f"d{i % 5}" / f"e {i % 7}#" / "/".join("abcd"[: i % 5])
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}%20.txt").write_bytes(b"x" * i)
    for name in ("_hidden", ".git", "_x=1", "day=2"):
        (root / name).mkdir()
        (root / name / "g.txt").write_bytes(b"y")
        (root / "d1" / f"{name}.txt").write_bytes(b"z")
    (root / "empty" / "below").mkdir(parents=True)
    (root / "t._COPYING_").write_bytes(b"")
    (root / "link.txt").symlink_to(root / "d0" / "_x=1.txt")
    (root / "other").symlink_to(root / "d1")
    found = files.scan_files(spark, str(root))
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    expected = by_spark.select("path", "length", "modificationTime").collect()
    assert len(expected) > 40
    listed = {*map(tuple, found.collect())}
    # Spark reads no rows from empty files; a listing has them.
    assert {r for r in listed if r[1]} == {*map(tuple, expected)}
    assert [r[0].rsplit("/", 1)[1] for r in listed if not r[1]] == ["f0%20.txt"]


def test_links_to_folders_above_are_not_followed(spark, tmp_path):
    below = tmp_path / "a" / "b"
    below.mkdir(parents=True)
    (below / "f.txt").write_bytes(b"1")
    (below / "up").symlink_to(tmp_path / "a")
    (below / "here").symlink_to(below)
    found = files.scan_files(spark, str(tmp_path))
    assert [r.path for r in found.collect()] == [f"file:{below}/f.txt"]


def test_listings_of_little(spark, tmp_path):
    assert files.scan_files(spark, str(tmp_path)).collect() == []
    (tmp_path / "one.txt").write_bytes(b"12")
    found = files.scan_files(spark, f"{tmp_path}/one.txt").collect()
    assert [(r.path, r.size_bytes) for r in found] == [(f"file:{tmp_path}/one.txt", 2)]
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, f"{tmp_path}/nothing")


def test_scan_by_glob(spark, tree):
    found = files.scan_by_glob(spark, str(tree), "*.mp4").collect()
    assert [r.path for r in found] == [f"file:{tree}/b.mp4", f"file:{tree}/c.mp4"]
    assert files.scan_by_glob(spark, str(tree), "*.nothing").collect() == []


def test_read_text_whole(spark, tree):
    texts = files.read_text_whole(spark, str(tree / "sub")).filter(F.col("path").endswith(".txt"))
    assert [r.text for r in texts.collect()] == ["bad  byte"]


def test_organize_copy(spark, tree, tmp_path):
    out = tmp_path / "out"
    copied = organize_collection(spark, f"file:{tree}", str(out)).collect()
    assert all(r.ok for r in copied) and len(copied) == 6
    assert stored_files(out) == {
        "text/a.txt": b"one\r\ntwo",
        "text/a_1.txt": b"bad \xff byte",
        "videos/A.MP4": b"0" * 50,
        "videos/b.mp4": b"1" * 10,
        "videos/c.mp4": b"2" * 20,
        "videos/d.mp4": b"3",
    }
    assert (out / "text/a_1.txt").stat().st_mtime == 1_600_000_000


def stored_files(out):
    return {
        str(p.relative_to(out)): p.read_bytes()
        for p in out.rglob("*")
        if p.is_file() and not p.name.startswith((".", "_")) and p.parent.name != "_planned"
    }


def test_organize_again(spark, tree, tmp_path):
    out = tmp_path / "out"
    (out / "text").mkdir(parents=True)
    (out / "text/a.txt").write_bytes(b"was here")
    assert len(organize_collection(spark, str(tree), str(out)).collect()) == 6
    first = stored_files(out)
    assert (first["text/a.txt"], first["text/a_1.txt"], first["text/a_2.txt"]) == (b"was here", b"one\r\ntwo", b"bad \xff byte")
    assert organize_collection(spark, str(tree), str(out)).collect() == []
    # One copy is lost, and a file arrives that comes before all others.
    (out / "text/a_2.txt").unlink()
    (tree / "a").mkdir()
    (tree / "a/a.txt").write_bytes(b"new")
    assert len(organize_collection(spark, str(tree), str(out)).collect()) == 2
    assert stored_files(out) == first | {"text/a_3.txt": b"new"}


def test_paths_in_stores():
    assert organize.split_uri("file:/a b/c%20d#e") == ("file", "", "/a b/c%20d#e")
    assert organize.split_uri("file:///a/b") == ("file", "", "/a/b")
    assert organize.split_uri("/a/b") == ("file", "", "/a/b")
    assert organize.split_uri("s3a://bucket/a key/x.txt") == ("s3", "", "bucket/a key/x.txt")
    assert organize.split_uri("gs://bucket/k") == ("gs", "", "bucket/k")
    assert organize.split_uri("abfss://box@acc.dfs.core/k 1") == ("az", "acc", "box/k 1")
    assert organize.split_uri("hdfs://host:8020/a b") == ("hdfs", "host:8020", "/a b")


def test_a_failed_copy_leaves_nothing(tmp_path):
    (tmp_path / "src").write_bytes(b"x")
    (tmp_path / "dst").mkdir()  # a folder where the file should go
    (tmp_path / "dst/full").write_bytes(b"y")
    size, error = organize._copy_one(f"file:{tmp_path}/src", f"file:{tmp_path}/dst", {})
    assert size == 0 and error
    assert sorted(p.name for p in tmp_path.iterdir()) == ["dst", "src"]


def test_a_destination_below_the_root_is_not_copied_again(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1")
    out = tmp_path / "out"
    assert len(organize_collection(spark, str(tmp_path), str(out)).collect()) == 1
    assert organize_collection(spark, str(tmp_path), str(out)).collect() == []
    assert set(stored_files(out)) == {"text/a.txt"}


def test_copy_failure_stays_with_its_file(spark, tree, tmp_path):
    plan = spark.createDataFrame(
        [(f"file:{tree}/b.mp4", f"{tmp_path}/o/b.mp4"), (f"file:{tree}/gone.mp4", f"{tmp_path}/o/gone.mp4")],
        "path string, dest string",
    )
    got = {os.path.basename(r.src): (r.ok, r.error is None) for r in organize.organize_copy(plan).collect()}
    assert got == {"b.mp4": (True, True), "gone.mp4": (False, False)}
    assert os.listdir(tmp_path / "o") == ["b.mp4"]


def test_write_by_category(spark, tmp_path):
    df = classify(spark.createDataFrame([("x/a.txt",), ("x/b.json",), ("x/c.wav",), ("x/d.bin",)], "path string"))
    organize.write_by_category(df, str(tmp_path / "c"))
    folders = {p for p in os.listdir(tmp_path / "c") if p.startswith("folder=")}
    assert folders == {"folder=text", "folder=audio"}


def test_sheets_with_different_columns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/1.csv").write_text("x,y\n1,2.5\n2,3.5\n")
    (tmp_path / "a/2.csv").write_text("x,y\n3,\n")
    (tmp_path / "b/1.csv").write_text("x,z\n4,hello\n")
    got = sheets.read_sheets(spark, [(str(tmp_path / "a"), None), (str(tmp_path / "b"), "x int, z string")])
    rows = sorted((r.x, r.y, r.z, r.source_id.split("/")[-2:]) for r in got.collect())
    assert rows == [
        (1, 2.5, None, ["a", "1.csv"]),
        (2, 3.5, None, ["a", "1.csv"]),
        (3, None, None, ["a", "2.csv"]),
        (4, None, "hello", ["b", "1.csv"]),
    ]


def test_cells_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "1.csv").write_text('x,y\n"say ""hi"", ok","two\nlines"\n3,plain\n')
    got = sheets.read_sheets(spark, [(str(tmp_path), "x string, y string")]).collect()
    assert sorted((r.x, r.y) for r in got) == [("3", "plain"), ('say "hi", ok', "two\nlines")]


def test_another_order_of_columns_is_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "2.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        sheets.read_sheets(spark, [(str(tmp_path), "x int, y int")]).collect()


def test_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    listing = spark.createDataFrame([("/p/s",), ("/q/s",), ("/q/empty",)], "source_id string")
    opened = []

    def read(ids):
        opened.append(sorted(ids))
        kind = "int" if ids == ["/p/s"] else "double"  # as inferred from what is there
        rows = spark.createDataFrame([("/p/s", 1), ("/p/s", 2), ("/q/s", 3)], "source_id string, v int")
        return rows.where(F.col("source_id").isin(ids)).withColumn("v", F.col("v").cast(kind))

    with pytest.raises(RuntimeError, match="^3 source"):
        sheets.cache_require(listing, sheets.cache_manifest(spark, cache))
    assert sheets.cache_incremental(listing.filter("source_id = '/p/s'"), read, cache) == 1
    assert sheets.cache_incremental(listing, read, cache) == 2
    assert sheets.cache_incremental(listing, read, cache) == 0
    assert opened == [["/p/s"], ["/q/empty", "/q/s"]]
    manifest = sheets.cache_manifest(spark, cache)
    sheets.cache_require(listing, manifest)
    assert {r.source_id: r.num_rows for r in manifest.collect()} == {"/p/s": 2, "/q/s": 1, "/q/empty": 0}
    # A run that stopped before its manifest entry leaves rows nobody reads.
    read(["/p/s"]).write.parquet(f"{cache}/data/run_id=stopped")
    assert sorted(r.v for r in sheets.read_cached(spark, cache).collect()) == [1.0, 2.0, 3.0]


def test_cache_takes_sources_in_portions(spark, tmp_path):
    listing = spark.createDataFrame([(f"s{i}",) for i in range(5)], "source_id string")
    sizes = []

    def read(ids):
        sizes.append(len(ids))
        return listing.where(F.col("source_id").isin(ids)).withColumn("v", F.lit(1))

    assert sheets.cache_incremental(listing, read, str(tmp_path / "c"), at_once=2) == 5
    assert sizes == [2, 2, 1]


def test_report_csv_keeps_missing_ratios(spark, tmp_path):
    path = str(tmp_path / "report")
    report = spark.sql(
        "select 'mp4' file_type, 3L num_files, 1.5D baseline_sec, 0D accel_sec, 500D baseline_avg_ms, 0D accel_avg_ms, "
        "cast(null as double) speedup_ratio, 0L baseline_errors, 1L accel_errors, 2L accel_excluded, "
        "'UNRELIABLE (err_rate=100.0%)' data_quality"
    )
    made = []

    def make():
        made.append(1)
        return report

    for reuse in (True, True, False):
        stored = reports.load_or_make_report(spark, path, make, reuse)
        assert stored.collect() == report.collect()
    assert len(made) == 2
    (part,) = [p for p in os.listdir(path) if p.endswith(".csv")]
    assert (tmp_path / "report" / part).read_text().splitlines()[1] == (
        "mp4,3,1.5,0.0,500.0,0.0,,0,1,2,UNRELIABLE (err_rate=100.0%)"
    )


def test_failure_log_grows_by_run(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "batch_id long, path string")
    for run in ("1", "2", "2"):
        reports.append_failure_log(rows, log, run)
    got = sorted((r.run_id, r.path) for r in reports.read_failure_log(spark, log).collect())
    assert got == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")]


def wav_bytes(samples, width, channels):
    """PCM file of integer samples, interleaved."""
    out = io.BytesIO()
    with wave.open(out, "wb") as clip:
        clip.setnchannels(channels)
        clip.setsampwidth(width)
        clip.setframerate(8000)
        offset = 128 if width == 1 else 0
        clip.writeframes(b"".join((s + offset).to_bytes(width, "little", signed=width > 1) for s in samples))
    return out.getvalue()


def test_read_waveforms(spark, tmp_path):
    for width in (1, 2, 3, 4):
        scale = 2 ** (8 * width - 1)
        samples = [0, scale // 2, -scale, -scale // 4, scale // 8, 0]
        (tmp_path / f"w{width}.wav").write_bytes(wav_bytes(samples, width, 2))
    (tmp_path / "broken.WAV").write_bytes(b"RIFFnothing")
    (tmp_path / "other.txt").write_bytes(b"text")
    got = {r.path.split("/")[-1]: r for r in waveforms.read_waveforms(spark, str(tmp_path)).collect()}
    broken = got.pop("broken.WAV")
    assert broken.waveform is None and broken.error
    assert sorted(got) == ["w1.wav", "w2.wav", "w3.wav", "w4.wav"]
    for row in got.values():
        assert (row.sample_rate, row.error) == (8000, None)
        assert row.waveform == [[0.0, -1.0, 0.125], [0.5, -0.25, 0.0]]
    measured = {r.path.split("/")[-1]: r for r in waveforms.measure_waveforms(spark, str(tmp_path), 2).collect()}
    assert measured.pop("broken.WAV").error == broken.error
    for row in measured.values():
        energy = 1 + 0.25 + 0.0625
        assert (row.mean_abs, row.l2, row.rms) == pytest.approx((1.75 / 4, energy**0.5, (energy / 4) ** 0.5))


def test_the_whole_run(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.wav").write_bytes(wav_bytes([0, 1000, -1000], 2, 1))
    (root / "b.txt").write_text("some text")
    (root / "c.json").write_text('{"k": 1}')
    (root / "bad.json").write_text('{"k": ')
    (root / "d.xlsx").write_text("x,y\n1,2\n")
    (root / "v.mp4").write_text('{"codec": "h264"}')
    (root / "w.mp4").write_text('{"codec": null}')
    probe = "path string, codec string, r_frame_rate string, avg_frame_rate string, nb_frames string"
    probes = spark.createDataFrame([(f"file:{root}/v.mp4", "h264", "25/1", "25/1", "100")], probe)
    out, log, csv_path = (str(tmp_path / n) for n in ("out", "log", "report"))
    for run in ("one", "two"):
        measured, copies = pipeline.run_pipeline(spark, str(root), out, probes, csv_path, log, run, size=1)
        rows = {r.file_type: r for r in measured.collect()}
        assert {t: r.num_files for t, r in rows.items()} == {"txt": 1, "json": 2, "wav": 1, "xlsx": 1, "mp4": 2}
        assert (rows["json"].baseline_errors, rows["json"].accel_errors) == (1, 1)
        assert (rows["mp4"].accel_excluded, rows["mp4"].accel_errors) == (1, 0)
        assert len(copies.collect()) == (7 if run == "one" else 0)
    logged = reports.read_failure_log(spark, log).collect()
    assert sorted((r.run_id, r.engine, r.path.split("/")[-1]) for r in logged) == [
        (run, engine, "bad.json") for run in ("one", "two") for engine in ("accel", "baseline")
    ]
    assert reports.read_report_csv(spark, csv_path).count() == 5
