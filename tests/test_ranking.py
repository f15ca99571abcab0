import random

import pytest
from pyspark.sql import functions as F

from assetflow.operators import ranking


@pytest.fixture(params=["broadcast", "windows"])
def route(request, monkeypatch):
    if request.param == "windows":
        monkeypatch.setattr(ranking, "MAX_BROADCAST_ROWS", 0)


def rows_with_a_hot_key(n, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [None, "b", "c", "d"]
    return [(rng.choice(keys), i, rng.randint(-5, 9)) for i in rng.sample(range(10 * n), n)]


def expected(rows, keyed=True):
    result, seen = {}, {}
    for key, pos, value in sorted(rows, key=lambda r: r[1]):
        group = key if keyed else ""
        count, total = seen.get(group, (0, 0))
        seen[group] = count + 1, total + value
        result[pos] = seen[group]
    return result


def test_rank_within_keys(spark, route):
    rows = rows_with_a_hot_key(3000, 1)
    df = spark.createDataFrame(rows, "key string, pos long, value long")
    got = ranking.rank_rows(df, ["key"], ["pos"], "rn").collect()
    assert {r.pos: r.rn for r in got} == {p: c for p, (c, _) in expected(rows).items()}
    assert set(got[0].asDict()) == {"key", "pos", "value", "rn"}


def test_rank_over_everything(spark, route):
    rows = rows_with_a_hot_key(2000, 2)
    df = spark.createDataFrame(rows, "key string, pos long, value long")
    got = ranking.rank_rows(df, [], ["pos"], "rn").collect()
    assert {r.pos: r.rn for r in got} == {p: c for p, (c, _) in expected(rows, False).items()}


@pytest.mark.parametrize("keys", [["key"], []])
def test_running_totals(spark, keys):
    rows = rows_with_a_hot_key(3000, 3)
    df = spark.createDataFrame(rows, "key string, pos long, value long")
    got = ranking.running_totals(df, keys, ["pos"], {"n": F.lit(1), "total": F.col("value")}).collect()
    assert {r.pos: (r.n, r.total) for r in got} == expected(rows, bool(keys))


def test_hot_key_spans_partitions(spark):
    rows = [("hot", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, pos long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge the small partitions
    try:
        sorted_rows = ranking.range_sorted(df, ["key"], ["pos"])
        assert sorted_rows.select(ranking.PART).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, pos long")
    assert ranking.rank_rows(df, ["key"], ["pos"], "rn").collect() == []
    assert ranking.running_totals(df, [], ["pos"], {"n": F.lit(1)}).collect() == []
