"""Set operations on key tables ``(alias, k)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.operators.joins import key_membership
from keyweave.operators.sorting import top_k_per_group


def distinct_keys(df: DataFrame, key: Column, name: str = "k") -> DataFrame:
    """Distinct non-NULL keys of a source."""
    return df.select(key.alias(name)).where(F.col(name).isNotNull()).distinct()


def intersect_keys(tagged: DataFrame, aliases: list[str]) -> DataFrame:
    """Keys held by every source: one grouping instead of a chain of joins."""
    everywhere = (1 << len(aliases)) - 1
    members = key_membership(tagged, aliases)
    return members.where(F.col("k").isNotNull() & (F.col("members") == everywhere)).select("k")


def keys_outside(tagged: DataFrame, aliases: list[str]) -> DataFrame:
    """Per source, the keys it holds that some other source lacks: ``(alias, k)``."""
    everywhere = (1 << len(aliases)) - 1
    members = key_membership(tagged, aliases).where(F.col("k").isNotNull() & (F.col("members") != everywhere))
    holders = [
        F.when(F.col("members").bitwiseAND(F.lit(1 << i)) != 0, F.lit(alias)) for i, alias in enumerate(aliases)
    ]
    return members.select(F.explode(F.array_compact(F.array(*holders))).alias("alias"), "k")


def symmetric_difference(tagged: DataFrame, left: str, right: str) -> DataFrame:
    """Keys held by exactly one of two sources."""
    members = key_membership(tagged, [left, right])
    return members.where(F.col("k").isNotNull() & F.col("members").isin(1, 2)).select("k")


def union_best(parts: list[DataFrame], identity: list[str], score: str, tie_breakers: list[str]) -> DataFrame:
    """Union of candidate lists keeping the best-scored copy of each item."""
    everything = reduce(lambda a, b: a.unionByName(b), parts)
    order = [F.col(score).desc_nulls_last(), *[F.col(name).asc_nulls_last() for name in tie_breakers]]
    return top_k_per_group(everything, identity, order, 1).drop("rank")
