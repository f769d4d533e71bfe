"""Ordering, limits and top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.functions.casts import nulls_last
from keyweave.plans.spec import Order


def order_rows(df: DataFrame, orders: tuple[Order, ...], tie_breakers: list[str] | None = None) -> DataFrame:
    """Sort with NULLs last both ways; tie-breakers make a following limit repeatable."""
    named = {order.name for order in orders}
    extra = [nulls_last(name) for name in tie_breakers or [] if name not in named]
    return df.orderBy(*[nulls_last(o.name, o.descending) for o in orders], *extra)


def top_k_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group.

    The rank filter sits directly on the window, so Spark keeps only ``k`` rows per group
    in every task before the shuffle: a group may hold any share of the table.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
