"""Equi-joins of pre-aggregated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_join(keyed: list[DataFrame], how: str = "inner", key: str = "k", out_key: str = "key") -> DataFrame:
    """Join every source to the first on its key.

    Inputs are already aggregated, so each holds at most one row per key and group; with
    adaptive execution Spark broadcasts the small ones and sort-merges (splitting skewed
    partitions) otherwise. NULL keys are expected to be gone.
    """
    joined, *others = keyed
    for other in others:
        joined = joined.join(other, key, how)
    columns = [c for df in keyed for c in df.columns if c != key]
    return joined.select(F.col(key).alias(out_key), *[F.col(f"`{c}`") for c in columns])


def tag_keys(keyed: list[DataFrame], aliases: list[str], key: str = "k") -> DataFrame:
    """All keys of all sources as one long table ``(alias, k)``, NULL keys included."""
    parts = [
        df.select(F.lit(alias).alias("alias"), F.col(key).alias("k")) for alias, df in zip(aliases, keyed)
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def key_membership(tagged: DataFrame, aliases: list[str]) -> DataFrame:
    """One row per key with a bit per source that holds it (one shuffle on the key)."""
    bit = F.lit(0)
    for position, alias in enumerate(aliases):
        bit = F.when(F.col("alias") == alias, F.lit(1 << position)).otherwise(bit)
    return tagged.groupBy("k").agg(F.bit_or(bit).alias("members"))
