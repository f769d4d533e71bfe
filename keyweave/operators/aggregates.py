"""Metrics of one source, grouped by key and extra columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.casts import metric_double
from keyweave.operators.filters import resolve_column
from keyweave.plans.spec import Metric

_NUMERIC = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def metric(df: DataFrame, item: Metric) -> Column:
    """One aggregate column. Numeric aggregates read text after removing commas."""
    if item.column == "*":
        return F.count(F.lit(1)).alias(item.name)
    name = resolve_column(df, item.column)
    column = F.col(f"`{name}`")
    if item.agg == "count":
        return F.count(column).alias(item.name)
    if item.agg == "count_distinct":
        return F.count_distinct(column).alias(item.name)
    if item.agg == "count_if":
        return F.count_if(column.cast("string") == F.lit(item.value)).alias(item.name)
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    number = column.cast("double") if numeric else metric_double(column)
    return _NUMERIC[item.agg](number).alias(item.name)


def aggregate(df: DataFrame, metrics: tuple[Metric, ...], by: list[Column] | None = None) -> DataFrame:
    """Hash aggregate: Spark combines partially on every task before the shuffle."""
    computed = [metric(df, item) for item in metrics]
    return df.groupBy(*by).agg(*computed) if by else df.agg(*computed)


def conditional_percent(condition: Column) -> Column:
    """Share of rows that satisfy a condition, in percent with one decimal."""
    hits = F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))
    return F.round(F.lit(100.0) * hits / F.count(F.lit(1)), 1)
