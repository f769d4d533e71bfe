"""Column profiles and the catalog built from them.

Tables are profiled in long form ``(dataset_id, column, column_pos, pos, value)``. Values
are counted once per distinct value; every later figure is a sum over those counts, so a
value holding any share of a column is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.keys import Gazetteer
from keyweave.functions.roles import NAME_CONFIDENCE, role_by_name, role_by_shares, value_tests
from keyweave.operators.sorting import top_k_per_group

COLUMN_KEY = ["dataset_id", "column"]

# Columns that carry no information of their own (fixed values).
BOOKKEEPING = ("spm_row", "ts_row", "no", "innerTableRowNum", "collection_dt")


def unpivot_text(df: DataFrame, dataset_id: str | Column, position: str | Column, columns: list[str]) -> DataFrame:
    """A wide table as long text rows; NULL becomes the text ``nan`` as in a text load."""
    owner = F.lit(dataset_id) if isinstance(dataset_id, str) else dataset_id
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(at).alias("column_pos"),
                F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")).alias("value"),
            )
            for at, name in enumerate(columns)
        ]
    )
    place = F.col(position) if isinstance(position, str) else position
    return df.select(owner.alias("dataset_id"), place.alias("pos"), F.inline(cells))


def value_counts(long: DataFrame) -> DataFrame:
    """Occurrences and first position of every distinct value of every column."""
    return long.groupBy(*COLUMN_KEY, "column_pos", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )


def _filled() -> Column:
    return (F.col("value") != "") & (F.lower("value") != "nan")


def column_profile(counts: DataFrame) -> DataFrame:
    """Null rate, distinct count and the three most common values of every column."""
    totals = counts.groupBy(*COLUMN_KEY, "column_pos").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(_filled(), F.col("n"))), F.lit(0)).alias("filled"),
        F.count_if(_filled()).alias("distinct_sample"),
    )
    common = (
        top_k_per_group(
            counts.where(_filled()), COLUMN_KEY, [F.col("n").desc(), F.col("first_pos").asc(), F.col("value").asc()], 3
        )
        .groupBy(*COLUMN_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).getField("value").alias("samples"))
    )
    return totals.join(common, COLUMN_KEY, "left").select(
        *COLUMN_KEY,
        "column_pos",
        "rows",
        F.round(1 - F.col("filled") / F.greatest("rows", F.lit(1)), 3).alias("null_rate"),
        "distinct_sample",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


def column_roles(counts: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Role of every column: its name decides, else the shares of its values.

    ``counts`` are value counts, or the long rows themselves with ``n`` = 1: sums are partial either way, and
    rows need no shuffle of every distinct value.
    """
    used = (F.col("value") != "") & (F.col("value") != "nan")
    tests = value_tests("value", gazetteer)
    sums = {role: F.sum(F.when(used & test, F.col("n")).otherwise(0)).alias(f"_{role}") for role, test in tests.items()}
    totals = counts.groupBy(*COLUMN_KEY, "column_pos").agg(
        F.sum(F.when(used, F.col("n")).otherwise(0)).alias("_filled"), *sums.values()
    )
    filled = F.col("_filled")
    shares = {role: F.col(f"_{role}") / F.when(filled > 0, filled) for role in tests}
    by_values = role_by_shares(shares, filled)
    by_name = role_by_name("column")
    return totals.select(
        *COLUMN_KEY, "column_pos", by_name.alias("_name"), by_values.alias("_values")
    ).select(
        *COLUMN_KEY,
        "column_pos",
        F.coalesce("_name", "_values.role").alias("role"),
        F.when(F.col("_name").isNotNull(), NAME_CONFIDENCE).otherwise(F.col("_values.confidence")).alias("role_confidence"),
    )


def profile(long: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Profile and role of every column, over whole tables."""
    counts = value_counts(long)
    roles = column_roles(counts, gazetteer)
    kept = column_profile(counts).join(roles.drop("column_pos"), COLUMN_KEY, "left")
    by_name = role_by_name("column")
    return kept.withColumn("role", F.coalesce("role", by_name, F.lit("text"))).withColumn(
        "role_confidence", F.coalesce("role_confidence", F.when(by_name.isNotNull(), NAME_CONFIDENCE).otherwise(0.0))
    )


def column_lists(profiles: DataFrame) -> DataFrame:
    """Region, time and numeric columns of every dataset, in column order."""
    role = F.col("role")

    def names(condition: Column) -> Column:
        found = F.collect_list(F.when(condition, F.struct("column_pos", "column")))
        return F.array_sort(found).getField("column")

    return profiles.groupBy("dataset_id").agg(
        names(role.startswith("region") | (role == "sido")).alias("region_columns"),
        names(role.isin("year", "date")).alias("time_columns"),
        names(role == "numeric").alias("numeric_columns"),
    )


def dataset_ids(operations: DataFrame) -> DataFrame:
    """Which catalog entry a loaded table belongs to.

    ``operations`` holds ``(dataset_id, position, operation, ...)``; every operation claims
    ``dataset_operation`` (the last one wins) and the first of a dataset its bare id.
    """
    operation_id = F.regexp_replace("operation", "[^A-Za-z0-9]", "")
    named = operations.withColumn("table_id", F.concat_ws("_", "dataset_id", operation_id))
    last = top_k_per_group(named, ["table_id"], [F.col("position").desc()], 1).drop("rank")
    first = top_k_per_group(operations, ["dataset_id"], [F.col("position").asc()], 1).drop("rank")
    return last.unionByName(first.withColumn("table_id", F.col("dataset_id")))


def catalog(profiles: DataFrame, operations: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """One entry per table: metadata of its operation plus its columns.

    Columns are described by ``definitions`` and by the ``fields`` of the table's operation, where ``operations``
    holds them; a table that has definitions of its own takes none from the operation.
    """
    tables = dataset_ids(operations)
    if "fields" in operations.columns:
        told = field_definitions(tables)
        if definitions is not None:
            told = told.join(definitions.select("dataset_id").distinct(), "dataset_id", "left_anti")
            told = told.unionByName(definitions.select(*told.columns))
        definitions = told
    if definitions is not None:
        described = merge_definitions(profiles, definitions)
    else:
        described = profiles.withColumn("desc", F.lit(""))
    columns = described.groupBy("dataset_id").agg(
        F.max("rows").alias("rows"),
        F.array_sort(
            F.collect_list(
                F.struct("column_pos", F.col("column").alias("name"), "role", "desc", "null_rate", "samples")
            )
        ).alias("columns"),
        F.max(F.col("desc") != "").alias("has_definitions"),
    )
    meta = tables.select(
        F.col("table_id").alias("dataset_id"),
        F.col("dataset_id").alias("parent_dataset_id"),
        *[c for c in operations.columns if c not in ("dataset_id", "position", "operation", "fields")],
    )
    entries = columns.join(column_lists(profiles), "dataset_id").join(meta, "dataset_id", "left")
    return entries.withColumn("parent_dataset_id", F.coalesce("parent_dataset_id", "dataset_id"))


def field_definitions(tables: DataFrame) -> DataFrame:
    """``(dataset_id, item, desc)`` from the ``fields`` of each table's operation; of equal names the first counts."""
    fields = tables.select(F.col("table_id").alias("dataset_id"), F.posexplode("fields").alias("at", "f"))
    named = fields.where(F.col("f.name") != "")
    return named.groupBy("dataset_id", F.col("f.name").alias("item")).agg(F.min_by("f.desc", "at").alias("desc"))


def merge_definitions(profiles: DataFrame, definitions: DataFrame) -> DataFrame:
    """Add the description of each column from ``(dataset_id, item, desc)``.

    Lookups in order: exact name, underscores as spaces, lower case, lower-case last part.
    A column meets its few spellings in one equi-join; the earliest lookup wins.
    """
    name = F.col("column")
    lookups = [
        (False, name),
        (False, F.replace(name, F.lit("_"), F.lit(" "))),
        (True, F.lower(name)),
        (True, F.lower(F.substring_index(name, "_", -1))),
    ]
    spellings = F.array(
        *[
            F.struct(F.lit(step).alias("step"), F.lit(fold).alias("fold"), item.alias("item"))
            for step, (fold, item) in enumerate(lookups)
        ]
    )
    wanted = profiles.select(*COLUMN_KEY, F.inline(spellings))
    exact = definitions.select("dataset_id", "item", "desc", F.lit(False).alias("fold"))
    lower = definitions.groupBy("dataset_id", F.lower("item").alias("item")).agg(F.max("desc").alias("desc"))
    known = exact.unionByName(lower.withColumn("fold", F.lit(True))).where(F.col("desc") != "")
    found = (
        wanted.join(known, ["dataset_id", "item", "fold"])
        .groupBy(*COLUMN_KEY)
        .agg(F.min_by("desc", "step").alias("desc"))
    )
    return profiles.join(found, COLUMN_KEY, "left").withColumn("desc", F.coalesce("desc", F.lit("")))


def catalog_totals(entries: DataFrame) -> DataFrame:
    """Datasets, columns, and how many datasets have region, time or described columns."""
    return entries.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum(F.size("columns")).cast("bigint").alias("columns"),
        F.count_if(F.size("region_columns") > 0).alias("with_region"),
        F.count_if(F.size("time_columns") > 0).alias("with_time"),
        F.count_if("has_definitions").alias("with_definitions"),
    )


def service_totals(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Datasets, columns, rows, joinable pairs and datasets with a region key."""
    sizes = entries.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum(F.size("columns")).cast("bigint").alias("columns"),
        F.sum("rows").alias("rows"),
        F.count_if(F.exists(F.map_values("region_keys"), lambda k: k.isNotNull())).alias("with_region_key"),
    )
    pairs = edges.agg(F.floor(F.count(F.lit(1)) / 2).alias("joinable_pairs"))
    return sizes.withColumn("joinable_pairs", pairs.scalar())


# What a card says of a dataset, and how many columns it names (fixed values).
CARD_TEXTS = ("title", "description", "provider", "category", "keywords")
CARD_TIMES, CARD_NUMBERS = 3, 8


def dataset_cards(entries: DataFrame, edges: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Summary of every dataset: what it is, sizes, columns by role, joinable count, close neighbours.

    Of ``CARD_TEXTS`` those that the entries hold are shown.
    """
    joinable = edges.groupBy(F.col("a").alias("dataset_id")).agg(F.count(F.lit(1)).alias("joinable_count"))
    near = neighbours.groupBy(F.col("a").alias("dataset_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "other", "level", "match_rate"))).alias("neighbours")
    )
    return (
        entries.join(joinable, "dataset_id", "left")
        .join(near, "dataset_id", "left")
        .select(
            "dataset_id",
            *[c for c in CARD_TEXTS if c in entries.columns],
            "rows",
            F.size("columns").alias("n_columns"),
            F.slice("time_columns", 1, CARD_TIMES).alias("time_columns"),
            F.slice("numeric_columns", 1, CARD_NUMBERS).alias("numeric_columns"),
            F.coalesce("joinable_count", F.lit(0)).alias("joinable_count"),
            "columns",
            F.coalesce(F.col("neighbours.other"), F.array().cast("array<string>")).alias("neighbours"),
        )
    )
