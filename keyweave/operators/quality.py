"""Result accounting: null rate, dropped keys, stop gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.operators.joins import key_membership
from keyweave.operators.sorting import top_k_per_group
from keyweave.session import cut_lineage

# Thresholds of the stop gate (fixed values).
MAXIMUM_NULL_RATE = 0.2
MINIMUM_MATCH_RATE = 0.5
MINIMUM_ROW_RETENTION = 0.5

DROPPED_KEYS_SHOWN = 30


def null_stats(df: DataFrame) -> DataFrame:
    """One row: ``row_count``, ``column_count`` and ``null_rate`` (4 decimals, NaN is a value)."""
    columns = df.columns
    filled = reduce(lambda a, b: a + b, [F.count(F.col(f"`{c}`")) for c in columns])
    totals = df.agg(F.count(F.lit(1)).alias("row_count"), filled.alias("_filled"))
    cells = F.col("row_count") * len(columns)
    rate = F.when(cells > 0, F.round((cells - F.col("_filled")) / cells, 4)).otherwise(F.lit(0.0))
    return totals.select("row_count", F.lit(len(columns)).alias("column_count"), rate.alias("null_rate"))


def dropped_detail(tagged: DataFrame, aliases: list[str]) -> DataFrame:
    """Per source: which keys fell out of the join and why.

    ``tagged`` is the long table ``(alias, k)``. Keys are grouped once into membership
    bits; every figure is a sum over them, and the listed keys are a bounded top-k, so no
    task ever holds all keys of a source.
    """
    everywhere = (1 << len(aliases)) - 1
    members = cut_lineage(key_membership(tagged, aliases))
    held = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(a).alias("alias")) for i, a in enumerate(aliases)]))
    sources = members.select("k", "members", held.alias("source")).select(
        F.col("source.position").alias("position"), F.col("source.alias").alias("alias"), "k", "members"
    )
    per_source = (
        sources.groupBy("position", "alias")
        .agg(
            F.count_if(F.col("k").isNotNull() & _holds()).alias("own"),
            F.count_if(F.col("k").isNotNull() & (F.col("members") == everywhere)).alias("matched"),
            F.max(F.when(F.col("k").isNull() & _holds(), 1).otherwise(0)).alias("blank"),
        )
    )
    shown = (
        top_k_per_group(
            sources.where(F.col("k").isNotNull() & _holds() & (F.col("members") != everywhere)),
            ["alias"],
            [F.col("k").asc()],
            DROPPED_KEYS_SHOWN,
        )
        .groupBy("alias")
        .agg(F.array_sort(F.collect_list("k")).alias("dropped_keys"))
    )
    keys = F.col("own") + F.col("blank")
    lost = F.col("own") - F.col("matched")
    return per_source.join(shown, "alias", "left").select(
        "position",
        "alias",
        keys.alias("keys"),
        "matched",
        F.when(keys > 0, F.round(F.col("matched") / keys, 3)).otherwise(F.lit(0.0)).alias("match_rate"),
        (lost + F.col("blank")).alias("dropped"),
        F.coalesce("dropped_keys", F.array().cast("array<string>")).alias("dropped_keys"),
        F.when(F.col("blank") > 0, "missing_normalized_key")
        .when(lost > 0, "unmatched_normalized_key")
        .alias("reason_code"),
    )


def _holds() -> Column:
    return F.expr("shiftright(members, position) & 1") == 1


def lowest_match(detail: DataFrame) -> DataFrame:
    """The first source with the lowest match rate (one row, NULLs when there is no join)."""
    best = F.min(F.struct("match_rate", "position", "title"))
    return detail.agg(best.alias("low")).select(
        F.col("low.match_rate").alias("lowest_match"), F.col("low.title").alias("lowest_title")
    )


def stop_signal(stats: DataFrame) -> DataFrame:
    """The first reason not to trust a result, per row of ``stats``.

    Reads ``row_count``, ``null_rate`` and, where present, ``baseline``, ``lowest_match``,
    ``lowest_title`` and ``allow_partial``; adds ``reason``, ``observed``, ``threshold``
    and ``title`` (all NULL when the result is clean).
    """

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in stats.columns else F.lit(None).cast(kind)

    baseline, match = optional("baseline", "bigint"), optional("lowest_match", "double")
    partial = F.coalesce(optional("allow_partial", "boolean"), F.lit(False))
    kept = F.col("row_count") / F.when(baseline > 0, baseline)
    reason = (
        F.when(F.col("row_count") == 0, "empty_result")
        .when(kept < MINIMUM_ROW_RETENTION, "row_drop")
        .when(~partial & (match < MINIMUM_MATCH_RATE), "match_rate")
        .when(F.col("null_rate") > MAXIMUM_NULL_RATE, "null_rate")
    )
    observed = {"empty_result": F.lit(0.0), "row_drop": kept, "match_rate": match, "null_rate": F.col("null_rate")}
    threshold = {
        "empty_result": 1.0,
        "row_drop": MINIMUM_ROW_RETENTION,
        "match_rate": MINIMUM_MATCH_RATE,
        "null_rate": MAXIMUM_NULL_RATE,
    }

    def pick(values: dict) -> Column:
        chosen = F.lit(None).cast("double")
        for name, value in values.items():
            chosen = F.when(F.col("reason") == name, value).otherwise(chosen)
        return chosen

    title = F.when(F.col("reason") == "match_rate", optional("lowest_title", "string"))
    return (
        stats.withColumn("reason", reason)
        .withColumn("observed", pick(observed))
        .withColumn("threshold", pick(threshold))
        .withColumn("title", title)
    )
