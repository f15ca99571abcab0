"""Archive and shards: exact round trips and what their contracts fix."""

import hashlib
import zlib
from collections import defaultdict

import compare
import duckdb
import pyarrow.parquet as pq
import pytest

from assetflow.llm import sharding, warc
from assetflow.shared import new_path


@pytest.mark.parametrize("which", ["edge", "empty", "sf0.001"])
def test_archive_equals_sql(spark, edge_dir, empty_dir, which):
    sf_dir = {"edge": edge_dir, "empty": empty_dir}.get(which, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
    assert compare.rows_of_spark(warc.op3_archive(spark, sf_dir)) == compare.rows_of_sql(con, warc.sql())


@pytest.fixture(scope="module")
def archive(spark, edge_dir):
    path = new_path(spark, "test-archive")
    warc.write_archive(spark.read.parquet(f"{edge_dir}/pages.parquet"), path, "page_id", "url", "html")
    return path


def test_payloads_are_stored_once(spark, edge_dir, archive):
    html = pq.read_table(f"{edge_dir}/pages.parquet")["html"].to_pylist()
    digests = [r.digest for r in spark.read.parquet(f"{archive}/payloads").select("digest").collect()]
    assert sorted(digests) == sorted({hashlib.sha256((h or "").encode()).hexdigest() for h in html})


def test_records_come_back_byte_by_byte(spark, edge_dir, archive):
    html = pq.read_table(f"{edge_dir}/pages.parquet")["html"].to_pylist()
    rows = warc.read_archive(spark, archive).collect()
    assert sorted(r.payload for r in rows) == sorted((h or "").encode() for h in html)
    for r in rows:
        fields, http, payload = warc.parse_record(bytes(r.record))
        assert fields["WARC-Type"] == r.record_type
        assert int(fields["Content-Length"]) == len(http) + len(payload)
        assert payload == (b"" if r.record_type == "revisit" else r.payload)
        assert http.endswith(b"Content-Length: %d\r\n\r\n" % len(r.payload))


def test_files_hold_the_same_records(spark, archive, tmp_path):
    target = f"file://{tmp_path}/files"
    warc.export_files(spark, archive, target)
    again = warc.read_files(spark, f"{target}/*.gz").collect()
    assert sorted(bytes(r.record) for r in again) == sorted(bytes(r.record) for r in warc.read_archive(spark, archive).collect())


def test_a_changed_payload_is_noticed(spark):
    path = new_path(spark, "broken")
    warc.write_archive(spark.createDataFrame([(1, "http://a/", "x" * 200)], "i long, u string, p string"), path, "i", "u", "p")
    other = new_path(spark, "other")
    warc.write_archive(spark.createDataFrame([(1, "http://a/", "y" * 200)], "i long, u string, p string"), other, "i", "u", "p")
    digest = spark.read.parquet(f"{path}/payloads").first().digest
    swapped = spark.read.parquet(f"{other}/payloads").selectExpr(f"'{digest}' as digest", "frame")
    swapped.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, path).collect()


def shards_of(rows):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    return shards


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "edge"])
def test_shards_hold_all_rows_and_near_equal_bytes(spark, edge_dir, sf_dir):
    sf_dir = edge_dir if sf_dir == "edge" else sf_dir
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = sharding.op6_kd_shards(spark, sf_dir).collect()
    expected = [
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        for i, t in zip(table["doc_id"], table["text"], strict=True)
    ]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(expected, key=str)
    shards = shards_of(rows)
    goal, largest = sum(e[1] for e in expected) / 24, max(e[1] for e in expected)
    for number in range(24):
        own = shards[number]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - goal) <= 1.5 * largest
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_no_rows_to_shard(spark, empty_dir):
    assert sharding.op6_kd_shards(spark, empty_dir).count() == 0


def test_equal_rows_do_not_hold_a_shard_together(spark):
    rows = spark.createDataFrame([(1, 100, "a")] * 4000 + [(i, 100, "b") for i in range(2000)], "doc_id long, size long, lang string")
    shards = shards_of(sharding.kd_shards(rows.repartition(4), ["lang", "doc_id"], 8).collect())
    sizes = [len(shards[n]) for n in range(8)]
    assert sum(sizes) == 6000 and max(sizes) - min(sizes) < 60


def test_first_cut_is_a_median_of_the_widest_dimension(spark):
    rows = spark.createDataFrame([(i, 10 + (90 if i < 100 else 0), 5) for i in range(1000)], "x long, size long, y long")
    shards = shards_of(sharding.kd_shards(rows, ["y", "x"], 2).collect())
    left = sorted(r.x for r in shards[0])
    assert left == list(range(len(left)))  # y is the same everywhere
    assert abs(sum(r.size for r in shards[0]) - 9500) <= 100


def test_ids_of_any_characters_come_back(spark, tmp_path):
    ids = ["a:b", "a", "", None, "x>y", "100%", "a b+c", "!", "é\n", "-5"]
    rows = [(i, None, "same " * 40) for i in ids] + [("z", None, "z " * 80), ("y:1", "http://a b/", "z " * 80)]
    path = new_path(spark, "test-archive")
    warc.write_archive(spark.createDataFrame(rows, "i string, u string, p string"), path, "i", "u", "p")
    found = warc.read_archive(spark, path).collect()
    assert sorted(map(str, (r.id for r in found))) == sorted(map(str, [*ids, "z", "y:1"]))
    by_id = {r.id: r for r in found}
    assert by_id[""].record_type == "response" and by_id["a:b"].refers_to == "" and by_id[None].refers_to == ""
    assert by_id["z"].refers_to == "y:1" and by_id["y:1"].uri == "http://a%20b/"
    warc.export_files(spark, path, str(tmp_path / "out"))
    again = warc.read_files(spark, f"{tmp_path}/out/*.gz").collect()
    assert sorted(map(str, (r.id for r in again))) == sorted(map(str, (r.id for r in found)))


def test_a_lost_payload_is_an_error(spark):
    path, cut = new_path(spark, "test-archive"), new_path(spark, "test-archive")
    warc.write_archive(spark.createDataFrame([(1, "x" * 200), (2, "y" * 200)], "i long, p string").selectExpr("i", "null as u", "p"), path, "i", "u", "p")
    spark.read.parquet(f"{path}/heads").write.parquet(f"{cut}/heads")
    spark.read.parquet(f"{path}/payloads").limit(1).write.parquet(f"{cut}/payloads")
    with pytest.raises(Exception, match="lost the payload"):
        warc.read_archive(spark, cut).collect()


def test_strings_with_a_common_beginning_are_split_by_value(spark):
    rows = [(i, 10, "https://" + ("aaa" if i % 2 else "zzz"), i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "_row long, size long, source string, `_tie` int")
    found = sharding.kd_shards(df, ["source"], 2).collect()
    assert {(r.source, r.shard) for r in found} == {("https://aaa", 0), ("https://zzz", 1)}
    assert sorted((r["_row"], r["_tie"]) for r in found) == [(i, i % 5) for i in range(4000)]


def test_shards_keep_columns_of_any_name(spark):
    names = ["_row", "_leaf", "_part", "_place", "_n", "_dim0", "_val0", "_given", "a.b", "_shard"]
    rows = [(i % 7, *range(len(names)), f"old{i}", None if i % 3 else "s") for i in range(300)]
    schema = ", ".join(["size long", *[f"`{n}` int" for n in names], "slot string", "text string"])
    found = sharding.kd_shards(spark.createDataFrame(rows, schema), ["text", "a.b"], 5)
    assert found.columns == ["size", *names, "text", "shard", "slot"]
    got = found.collect()
    assert len(got) == 300 and all(r[n] == i for r in got for i, n in enumerate(names))
    for shard in range(5):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_ranks_number_the_distinct_values_in_order(spark):
    values = [f"k{i * 7919 % 5000:04}" for i in range(5000)] * 2 + [None, ""]
    got = sharding._ranks(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()
    assert sorted((r["rank"], r["value"]) for r in got) == list(enumerate(sorted({v for v in values if v is not None})))
