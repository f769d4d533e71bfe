"""Spark settings the package relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "keyweave",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    ``shuffle_partitions`` stays unset on a cluster so that the cluster's own value
    (or adaptive coalescing from a high initial number) applies.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(name, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Where none is named, a local master uses its machine's temporary folder; on a cluster that folder
    isn't shared, so this raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^-].*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"keyweave-{context.applicationId}")


# Paths written by each scope that is open, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A scope that removes the tables ``cut_lineage`` writes inside it, once its results are stored elsewhere.

    DataFrames made inside can't be computed afterwards.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            place = hadoop.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Lost executors then cost nothing but the running stage, a table used several times is
    computed once, and later joins know its real size. The table stays until the folder is cleared, or until the
    enclosing ``intermediates`` scope ends.
    """
    path = os.path.join(checkpoint_folder(df.sparkSession), "keyweave", uuid.uuid4().hex)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame; cheap, and an over-estimate after joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
