import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from assetflow import shared
from assetflow.functions import text
from assetflow.operators import organize


def test_staged_tables_are_in_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_dir(spark) == folder
    staged = shared.stage(spark.range(5).withColumn("x", F.lit("a")))
    assert staged.count() == 5
    assert staged.inputFiles()[0].startswith(f"file://{folder}/assetflow/")


def test_at_most(spark):
    assert shared.at_most(spark.range(3), 3)
    assert not shared.at_most(spark.range(4), 3)


def test_join_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, l int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, r int")
    got = shared.join_on(left, F.broadcast(right), ["k"], "left").collect()
    assert sorted((r.l, r.k, r.r) for r in got) == [(1, None, 10), (2, "a", 20), (3, "b", None)]


@pytest.mark.parametrize("function", [organize._copy_batches, text._canonical])
def test_task_functions_do_not_need_the_package(function, tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(function))
    code = "import pickle, sys; print(callable(pickle.load(open(sys.argv[1], 'rb'))))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    result = subprocess.run(
        [sys.executable, "-c", code, str(tmp_path / "f")], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert result.stdout.strip() == "True", result.stderr
