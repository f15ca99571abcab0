import duckdb
import numpy as np
import pytest
from compare import rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from assetflow.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string"


def rows():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(size=12).tolist(), int(rng.integers(4)), "clash") for i in range(400)]
    same = out[7][1]
    out += [(1000 + i, same, 1 + i % 2, None) for i in range(150)]  # a group of equal vectors
    out += [out[50], out[50], (50, same, 2, "x"), (100, [0.0] * 12, 0, "x")]  # repeated ids and rows
    out += [
        (2000, None, 1, None),
        (2001, [], 1, None),
        (2002, [None, 1.0], 1, None),
        (2003, [float("nan")] * 12, 1, None),
        (2004, [float("-inf")] * 12, 1, None),
        (2050, same, None, None),
        (None, same, 3, None),
        (2007, same[:5], 9, None),
        (2008, [*same, 0.5, -1.5], 2, None),
    ]
    return out


def table(spark, folder, data):
    df = spark.createDataFrame(data, SCHEMA)
    df.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_edge_cases_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    folder = table(spark, tmp_path, rows())
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 1500)  # many blocks of anchors and of rows
    found = rows_of_spark(hardneg.op11_hard_negatives(spark, folder))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
    assert found == rows_of_sql(con, hardneg.sql())
    assert len(found[1]) > 50


def test_an_empty_table(spark, tmp_path):
    assert hardneg.op11_hard_negatives(spark, table(spark, tmp_path, [])).collect() == []


def test_anchors_without_a_partner(spark):
    df = spark.createDataFrame([(50, [1.0], 1, "a"), (51, [1.0], 2, "b")], SCHEMA)
    assert hardneg.mine(df, F.col("vec_id") == 50).collect() == []
    assert hardneg.mine(df, F.lit(False)).collect() == []


def test_a_norm_whose_scores_would_not_fit_takes_no_part(spark):
    big, small = [3.0e8, 1.0], [1.0, 1.0]
    data = [(50, small, 1, ""), (1, small, 1, ""), (2, big, 1, ""), (3, [1.0, 0.5], 2, "")]
    got = hardneg.mine(spark.createDataFrame(data, SCHEMA), F.col("vec_id") == 50).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 3, 131072, 98304)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (37, 70, 51), (64, 64, 64), (5, 0, 4), (33, 17, 90)])
def test_products_are_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
    assert (hardneg.strassen(a, b) == a @ b).all()


def test_sums_that_wrap_around_on_the_way(monkeypatch):
    monkeypatch.setattr(hardneg, "LEAF", 1)
    a = np.full((4, 4), 2**30)
    a[::2] *= -1
    assert (hardneg.strassen(a, a.T) == a @ a.T).all()


def test_merged_heaps_are_the_heap_of_all():
    rng = np.random.default_rng(8)
    keys, scores = rng.integers(0, 5, 600), rng.integers(-3, 3, 600)
    places = rng.permutation(600)
    whole = hardneg.Heaps(5, 4)
    whole.offer(keys, scores, places)
    parts = hardneg.Heaps(5, 4)
    for i in range(0, 600, 37):
        parts.offer(keys[i : i + 37], scores[i : i + 37], places[i : i + 37])
    best = [
        sorted((-s, p) for k, s, p in zip(keys, scores, places, strict=True) if k == key)[:4]
        for key in range(5)
    ]
    for heaps in (whole, parts):
        got = [[] for _ in range(5)]
        for k, s, p in zip(heaps.keys, heaps.scores, heaps.places, strict=True):
            got[k].append((-s, p))
        assert got == best
        assert list(heaps.least) == [-b[-1][0] for b in best]
