"""Shared storage and size checks used by the operators.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``: any
executor can read them back, and a lost executor costs no recomputation. Only a local
session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is a few narrow columns, so this is at most some tens of MB.
MAX_BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, visible to the driver and all executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="assetflow-"))
    return sc.getCheckpointDir().rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/assetflow/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; results that were not written yet need it."""
    file_system, hadoop_path = _file_system(spark, _own_dir(spark))
    file_system.delete(hadoop_path, True)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that later steps no longer read."""
    file_system, hadoop_path = _file_system(spark, path)
    file_system.delete(hadoop_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on the file system it belongs to."""
    file_system, hadoop_path = _file_system(spark, path)
    return file_system.exists(hadoop_path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that holds few."""
    file_system, hadoop_path = _file_system(spark, path)
    return [f.getPath().getName() for f in file_system.listStatus(hadoop_path)]


def is_folder(spark: SparkSession, path: str) -> bool:
    file_system, hadoop_path = _file_system(spark, path)
    return file_system.getFileStatus(hadoop_path).isDirectory()


def qualified_path(spark: SparkSession, path: str) -> str:
    """``path`` the way Spark lists it, with its scheme."""
    file_system, hadoop_path = _file_system(spark, path)
    return file_system.makeQualified(hadoop_path).toString()


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; each partition sends on its count only."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast when the row count allows; otherwise leave the join to Spark."""
    return F.broadcast(df) if at_most(df, MAX_BROADCAST_ROWS) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all task slots, for Python work that costs more than its bytes.

    Adaptive execution would merge small partitions and run such work in a few tasks.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *keys)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; keeps the left side's key columns.

    A broadcast hint belongs on ``right`` before the call and survives the renaming.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])
