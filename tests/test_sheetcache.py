import datetime
import os

import pytest
from pyspark.sql import functions as F

from assetflow.sources import files, sheetcache


def land(tmp_path, sheets):
    for name, content in sheets.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content.encode() if isinstance(content, str) else content)
    return f"{tmp_path}/in", str(tmp_path / "cache")


def named(listing):
    return listing.withColumn("source_id", F.regexp_extract("path", "([^/]*)$", 1))


def test_files_are_converted_once_with_their_types(spark, tmp_path):
    root, cache = land(
        tmp_path,
        {
            "1.csv": "n,x,day,ok,at,note\n1,2.5,2024-01-31,true,2024-01-31 10:00:00,a\n-2,,2024-02-01,FALSE,2024-01-31 10:00:00.5,\n",
            "2.csv": 'note,n\n"say ""hi"", two\nlines",3\n"",\n',
            "3.csv": "n,day\n4.5,2024-02-31\n",
            "only_header.csv": "n,x\n",
            "empty.csv": "",
        },
    )
    listing = named(files.scan_files(spark, root))
    with pytest.raises(RuntimeError, match="^5 file"):
        sheetcache.require(listing, cache)
    assert sheetcache.convert_missing(listing.where("source_id = '1.csv'"), cache) == 1
    assert sheetcache.convert_missing(listing, cache) == 4
    assert sheetcache.convert_missing(listing, cache) == 0
    sheetcache.require(listing, cache)
    counts = {r.source_id: r.num_rows for r in sheetcache.manifest(spark, cache).collect()}
    assert counts == {"1.csv": 2, "2.csv": 2, "3.csv": 1, "only_header.csv": 0, "empty.csv": 0}
    got = sheetcache.read_converted(spark, cache)
    kinds = dict(got.dtypes)
    assert (kinds["n"], kinds["x"], kinds["day"], kinds["ok"]) == ("double", "double", "string", "boolean")
    rows = sorted((r.source_id, r.n, r.x, r.day, r.ok, r.note) for r in got.orderBy("n").collect() if r.n is not None)
    assert rows == [
        ("1.csv", -2.0, None, "2024-02-01", False, None),
        ("1.csv", 1.0, 2.5, "2024-01-31", True, "a"),
        ("2.csv", 3.0, None, None, None, 'say "hi", two\nlines'),
        ("3.csv", 4.5, None, "2024-02-31", None, None),
    ]
    assert [r.note for r in got.where("n is null").collect()] == [""]
    at = {r.at for r in got.where("source_id = '1.csv'").collect()}
    assert at == {datetime.datetime(2024, 1, 31, 10), datetime.datetime(2024, 1, 31, 10, 0, 0, 500_000)}


def test_a_broken_file_is_noted_and_tried_again(spark, tmp_path):
    root, cache = land(
        tmp_path,
        {
            "good.csv": "x\n1\n",
            "ragged.csv": "x,y\n1,2\n3\n",
            "twice.csv": "x,X\n1,2\n",
            "clash.csv": "source_id\n1\n",
            "bytes.csv": b"x\n\xff\xfe\n",
        },
    )
    listing = named(files.scan_files(spark, root))
    assert sheetcache.convert_missing(listing, cache) == 1
    bad = {r.source_id for r in sheetcache.failures(spark, cache).collect()}
    assert bad == {"ragged.csv", "twice.csv", "clash.csv", "bytes.csv"}
    assert {r.source_id for r in sheetcache.missing_files(listing, cache).collect()} == bad
    assert [r.x for r in sheetcache.read_converted(spark, cache).collect()] == [1]
    (tmp_path / "in/ragged.csv").write_text("x,y\n1,2\n3,4\n")
    assert sheetcache.convert_missing(listing, cache) == 1
    assert {r.source_id for r in sheetcache.failures(spark, cache).collect()} == bad - {"ragged.csv"}
    assert sheetcache.read_converted(spark, cache).agg(F.sum("x")).first()[0] == 5


def test_data_that_no_manifest_names_is_not_read(spark, tmp_path):
    root, cache = land(tmp_path, {"1.csv": "x\n1\n2\n"})
    listing = files.scan_files(spark, root)
    sheetcache.convert_missing(listing, cache)
    # What a lost task left behind: a second copy of the rows under another name.
    (layout,) = os.listdir(f"{cache}/data")
    (name,) = [f for f in os.listdir(f"{cache}/data/{layout}") if f.endswith(".parquet")]
    content = open(f"{cache}/data/{layout}/{name}", "rb").read()
    with open(f"{cache}/data/{layout}/lost.parquet", "wb") as lost:
        lost.write(content)
    got = sheetcache.read_converted(spark, cache)
    assert sorted(r.x for r in got.collect()) == [1, 2]
    assert {os.path.basename(r.source_id) for r in got.collect()} == {"1.csv"}


def test_a_read_takes_the_wanted_columns_only(spark, tmp_path):
    root, cache = land(tmp_path, {"1.csv": "x,y,z\n1,2,3\n"})
    sheetcache.convert_missing(files.scan_files(spark, root), cache)
    plan = sheetcache.read_converted(spark, cache).select("y")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "ReadSchema" in line and "y:bigint" in line)
    assert "x:" not in scan.split("ReadSchema")[1] and "z:" not in scan.split("ReadSchema")[1]


def test_rows_longer_than_a_block_and_many_layouts(spark, tmp_path, monkeypatch):
    long = "w" * 300_000
    sheets = {f"{i}.csv": f"c{i},x\n1,{long}\n" for i in range(40)}
    root, cache = land(tmp_path, sheets)
    monkeypatch.setattr(sheetcache, "BLOCK_BYTES", (1 << 16, 1 << 20))
    monkeypatch.setattr(sheetcache, "OPEN_FILES", 2)
    assert sheetcache.convert_missing(files.scan_files(spark, root), cache) == 40
    got = sheetcache.read_converted(spark, cache)
    assert len(got.columns) == 42 and got.agg(F.sum(F.length("x"))).first()[0] == 40 * len(long)


def test_files_are_packed_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(sheetcache, "FILE_BYTES", 0)
    monkeypatch.setattr(sheetcache, "TASK_BYTES", 1000)
    sizes = [5000, 900, 900, *[10] * 400]
    rows = [(f"/p{i}", f"s{i}", size) for i, size in enumerate(sizes)]
    listing = spark.createDataFrame(rows, "path string, source_id string, size_bytes long")
    packed = sheetcache._packed(listing).withColumn("part", F.spark_partition_id())
    of = packed.join(listing, "path").groupBy("part").agg(F.sum("size_bytes").alias("n"), F.count("*").alias("files"))
    got = of.collect()
    assert sum(r.files for r in got) == len(sizes)
    # No task exceeds its share by more than one file.
    assert all(r.n < 1000 + 5000 for r in got) and sum(r.n > 2000 for r in got) == 1


def test_nulls_repeats_and_empty_listings(spark, tmp_path):
    root, cache = land(tmp_path, {"1.csv": "x\n1\n"})
    path = files.scan_files(spark, root).first().path
    rows = [(path, None, 4), (path, None, 4), (None, "a", 1), (f"{path}.gone", "b", None)]
    listing = spark.createDataFrame(rows, "path string, source_id string, size_bytes long")
    assert sheetcache.convert_missing(listing.limit(0), cache) == 0
    assert sheetcache.read_converted(spark, cache).count() == 0
    assert sheetcache.convert_missing(listing, cache) == 1
    assert [(r.x, r.source_id) for r in sheetcache.read_converted(spark, cache).collect()] == [(1, path)]
    assert [r.source_id for r in sheetcache.failures(spark, cache).collect()] == ["b"]
