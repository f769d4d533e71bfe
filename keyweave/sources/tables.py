"""Read stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table; filters and column choice reach the scan.

    With ``spread`` a table stored in no more splits than there are cores is spread over
    them, for work that is heavy per row. Larger tables are left as they are stored.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() <= cores:
        return df.repartition(cores)
    return df
