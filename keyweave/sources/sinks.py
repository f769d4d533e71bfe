"""Write results: tables as Parquet, pairs as CSV, catalog and graph as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, dataset_id: str) -> str:
    """Replace the table of one dataset."""
    path = f"{folder}/t_{dataset_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Measured pairs as CSV part files, each with a header and a byte-order mark."""
    first = pairs.columns[0]
    marked = pairs.withColumnRenamed(first, "\ufeff" + first)
    marked.sortWithinPartitions(F.col("match_rate").desc(), F.col("matched").desc()).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """Catalog entries, nodes or edges as JSON lines with every field present."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
