import datetime as dt
import random

import compare
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from assetflow.sources.views import TABLES
from assetflow.streaming import jobs, state

SMALL = "/root/testdata/sf0.001"


def test_arriving_files(spark, tmp_path):
    for name in ("a.txt", "b.TXT", "c.wav", "d.bin", "e.json"):
        (tmp_path / name).write_bytes(b"12345")
    files = jobs.file_arrivals(spark, str(tmp_path), max_files=2)
    rows = jobs.run_available(files, jobs.arrival_counts()).collect()
    assert {r.ext: (r.num_files, r.total_bytes) for r in rows} == {
        "txt": (2, 10),
        "wav": (1, 5),
        "json": (1, 5),
    }


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def arrivals(spark, folder, *batches):
    """A stream that delivers the batches in turn, with increasing file times."""
    schema = "ts timestamp, path string, file_type string, failed boolean"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_count(spark, tmp_path):
    day = 24 * 60
    stream = arrivals(
        spark,
        str(tmp_path / "s"),
        [(at(0), "a", "txt", False), (at(10), "b", "txt", True)],
        [(at(2 * day), "c", "txt", False)],
        [(at(2 * day + 5), "d", "txt", True)],
        [(at(20), "late", "txt", True)],
    )
    got = jobs.run_available(stream, jobs.error_rate_by_window()).orderBy("window_start").collect()
    assert [(r.window_start, r.batches, r.failed_batches) for r in got] == [
        (at(0), 3, 2),
        (at(2 * day), 2, 1),
    ]


def test_repeated_deliveries(spark, tmp_path):
    stream = arrivals(
        spark,
        str(tmp_path / "s"),
        [(at(0), "a", "txt", False), (at(1), "a", "txt", False), (at(2), "b", "txt", False)],
        [(at(9000), "a", "txt", False), (at(4), "c", "txt", False)],
        [(at(3), "b", "txt", False)],
    )
    rows = jobs.run_available(stream.select("ts", "path"), jobs.first_deliveries(["path"]))
    assert sorted(r.path for r in rows.collect()) == ["a", "b", "c"]


def test_sessions_that_later_rows_join(spark, tmp_path):
    stream = arrivals(
        spark,
        str(tmp_path / "s"),
        [(at(m), "u", "txt", False) for m in (0, 300)] + [(at(5000), "v", "txt", False)],
        [(at(m), "u", "txt", False) for m in (100, 1000)],
        [(at(200), "u", "txt", False)],
    )
    got = jobs.run_available(stream, jobs.sessions("path")).orderBy("session_start").collect()
    assert [(r.path, r.session_start, r.session_end, r.num_events) for r in got] == [
        ("u", at(0), at(420), 4),
        ("u", at(1000), at(1120), 1),
        ("v", at(5000), at(5120), 1),
    ]


def test_a_later_run_takes_only_new_files(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    for name in ("a.txt", "b.wav"):
        (landing / name).write_bytes(b"1")
    for arrived in ({"a.txt", "b.wav"}, {"a.txt", "b.wav", "c.json"}):
        files = jobs.file_arrivals(spark, str(landing)).select("path")
        got = [r.path.split("/")[-1] for r in jobs.run_available(files, path=out).collect()]
        assert sorted(got) == sorted(arrived)
        (landing / "c.json").write_bytes(b"1")


def test_a_resumed_run_without_news_returns_the_totals(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    (landing / "a.txt").write_bytes(b"123")
    for _ in range(2):
        files = jobs.file_arrivals(spark, str(landing))
        rows = jobs.run_available(files, jobs.arrival_counts(), out).collect()
        assert [(r.ext, r.num_files, r.total_bytes) for r in rows] == [("txt", 1, 3)]


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_windows_close_once_and_state_stays_small(spark, tmp_path, two_partitions):
    """50 micro-batches of an hour each; every tenth brings a row of long ago."""
    batches = [
        [(at(60 * i), "a", "txt", False), (at(60 * i + 30), "b", "wav", i % 2 == 0), (None, "x", "txt", True)]
        + ([(at(60 * (i - 9)), "late", "txt", True)] if i % 10 == 9 else [])
        for i in range(50)
    ]
    folder, out = str(tmp_path / "s"), str(tmp_path / "out")
    stream = arrivals(spark, folder, *batches)
    job = jobs.error_rate_by_window("1 hour", "1 hour")
    progress = jobs.advance(stream, job, out)
    assert len(progress) >= 50
    # Two types, and the hours that the watermark has not passed.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 3 * 2
    found = jobs.results(stream, job, out)
    closed, opened, late = (
        {(r.window_us // 3_600_000_000 * 60, r.file_type): (r.batches, r.failed_batches) for r in rows.collect()}
        for rows in (found.closed, found.open, found.late)
    )
    start = int(at(0).replace(tzinfo=dt.UTC).timestamp()) // 60
    expected = {(start + 60 * i, t): (1, int(t == "wav" and i % 2 == 0)) for i in range(50) for t in ("txt", "wav")}
    assert closed | opened == expected
    assert not closed.keys() & opened.keys() and found.closed.count() == len(closed)
    assert late == {(start + 60 * i, "txt"): (1, 1) for i in (0, 10, 20, 30, 40)}
    totals = job.totals(found)
    assert totals.agg({"batches": "sum"}).first()[0] == 105
    assert totals.where("batches = 2 and failed_batches = 1 and err_rate = 0.5").count() == 5


def test_sessions_are_written_once(spark, tmp_path, two_partitions):
    bursts = [(0, "u"), (100, "u"), (1000, "u"), (1100, "v"), (2000, None), (3000, "w"), (3050, "w")]
    batches = [[(at(m), u, "txt", False)] for m, u in bursts]
    stream = arrivals(spark, str(tmp_path / "s"), *batches, [(at(110), "u", "txt", False)])
    job, out = jobs.sessions("path"), str(tmp_path / "out")
    jobs.advance(stream, job, out)
    found = jobs.results(stream, job, out)

    def rows(df):
        base = int(at(0).replace(tzinfo=dt.UTC).timestamp())
        minutes = [(r.key, *((us // 1_000_000 - base) // 60 for us in (r.start_us, r.end_us)), r.num_events) for r in df.collect()]
        return sorted(minutes, key=lambda r: (str(r[0]), r[1]))

    assert rows(found.closed) == [(None, 2000, 2120, 1), ("u", 0, 220, 2), ("u", 1000, 1120, 1), ("v", 1100, 1220, 1)]
    assert rows(found.open) == [("w", 3000, 3170, 2)]
    assert rows(found.late) == [("u", 110, 230, 1)]
    got = {(r.path, r.session_start, r.session_end, r.num_events) for r in job.totals(found).collect()}
    assert got == {
        ("u", at(0), at(230), 3),
        ("u", at(1000), at(1120), 1),
        ("v", at(1100), at(1220), 1),
        (None, at(2000), at(2120), 1),
        ("w", at(3000), at(3170), 2),
    }


@pytest.mark.parametrize("seed", range(20))
def test_bursts_of_parts_merge_to_those_of_all(seed):
    rng = random.Random(seed)
    events = [(rng.choice(["a", "b", None, ""]), rng.randrange(400)) for _ in range(rng.randint(1, 60))]
    frame = pd.DataFrame(
        {
            "key": pd.Series([k for k, _ in events], dtype=object),
            "start_us": [t for _, t in events],
            "end_us": [t + 10 for _, t in events],
            "num_events": 1,
        }
    )
    cut = rng.randint(0, len(frame))
    parts = [state.merge_bursts(p) for p in (frame[:cut], frame[cut:]) if len(p)]
    expected = []
    for key in {k for k, _ in events}:
        for t in sorted(t for k, t in events if k == key):
            if expected and expected[-1][0] == key and t < expected[-1][2]:
                expected[-1][2:] = [t + 10, expected[-1][3] + 1]
            else:
                expected.append([key, t, t + 10, 1])
    for merged in (state.merge_bursts(frame), state.merge_bursts(pd.concat(parts))):
        got = [[None if pd.isna(k) else k, *map(int, r)] for k, *r in merged.itertuples(index=False)]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_repetitions_within_a_time(spark, tmp_path, two_partitions):
    stream = arrivals(
        spark,
        str(tmp_path / "s"),
        [(at(0), "a", "txt", False), (at(1), "a", "txt", False)],
        [(at(30), "a", "txt", False), (at(9000), "b", "txt", False)],
        [(at(9001), "c", "txt", False)],
        [(at(9002), "a", "txt", False), (at(9003), "b", "txt", False)],
    )
    job = jobs.first_deliveries(["path"], within="1 hour")
    progress = jobs.advance(stream.select("ts", "path"), job, str(tmp_path / "out"))
    got = jobs.results(stream.select("ts", "path"), job, str(tmp_path / "out")).closed
    assert sorted((r.path, r.ts) for r in got.collect()) == [("a", at(0)), ("a", at(9002)), ("b", at(9000)), ("c", at(9001))]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 3  # the first "a" is forgotten


def test_keys_are_kept_without_reading_earlier_rows(spark, tmp_path, two_partitions):
    stream = arrivals(spark, str(tmp_path / "s"), *[[(at(i), f"f{i % 7}", "txt", False), (at(i), f"g{i}", "txt", False)] for i in range(12)])
    job, out = jobs.first_deliveries(["path"]), str(tmp_path / "out")
    progress = [p for p in jobs.advance(stream.select("path"), job, out) if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [2] * 12
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [2] * 7 + [1] * 5
    assert jobs.results(stream.select("path"), job, out).closed.count() == 19


def test_only_the_last_totals_are_kept(spark, tmp_path):
    landing, out = tmp_path / "in", tmp_path / "out"
    landing.mkdir()
    for i in range(4):
        (landing / f"{i}.txt").write_bytes(b"12")
        files = jobs.file_arrivals(spark, str(landing))
        (row,) = jobs.run_available(files, jobs.arrival_counts(), str(out)).collect()
        assert (row.ext, row.num_files, row.total_bytes) == ("txt", i + 1, 2 * i + 2)
    assert len(list((out / "rows").glob("batch_id=*"))) == 2


@pytest.fixture(scope="module", params=["one file", "seven files"])
def split_tables(request, spark, tmp_path_factory):
    """The smallest tables, whole or spread over files at random."""
    if request.param == "one file":
        return SMALL
    folder = tmp_path_factory.mktemp("split")
    for name in TABLES:
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        parts = 7 if rows.count() > 50 else 1
        rows.repartition(parts).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "name", ["stream_inventory", "stream_error_rate", "stream_sessions", "stream_dedup"]
)
def test_results_do_not_depend_on_the_files(spark, monkeypatch, two_partitions, split_tables, name):
    if split_tables != SMALL:
        whole = jobs.table_arrivals
        monkeypatch.setattr(jobs, "table_arrivals", lambda s, f, n: whole(s, f, n, max_files=1))
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = compare.rows_of_spark(entry_point.queries()[name](spark, split_tables))
    assert found == compare.rows_of_sql(con, entry_point.oracle_sql()[name])
    assert spark.conf.get("spark.sql.session.timeZone") == zone
