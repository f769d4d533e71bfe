"""Inputs derived from the test tables, written once as SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave import Gazetteer, SourceTable
from keyweave.functions.keys import CITY_CODES, CITY_NAMES, ENGLISH_NAMES
from keyweave.sources.tables import read_table

GAZETTEER = Gazetteer()

# Cities the generated addresses name, and the code of each; the merged county has neither an English name nor an address here.
_CITIES = [name for name in CITY_NAMES if name in ENGLISH_NAMES.values()]
PLACES = ",".join(_CITIES)
CODES = ",".join(min(code for code, city in CITY_CODES.items() if city == name) for name in _CITIES)
TOWNS = ",".join(["금호읍", "오천읍", "풍산읍", "장량동", "화북면"])


def read(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", spread)


def pick(words: str, number: str, count: int) -> str:
    return f"split_part('{words}', ',', cast(({number}) % {count} as int) + 1)"


def place(i: str) -> str:
    return pick(PLACES, i, 22)


def town(i: str) -> str:
    return pick(TOWNS, i, 5)


def address(i: str) -> str:
    """A messy place text for an id: full address, stem, codes, town, or nothing usable."""
    return (
        f"case {i} % 6"
        f" when 0 then '경상북도 ' || {place(i)} || ' 북구 중앙로 ' || {i}"
        f" when 1 then substr({place(i)}, 1, length({place(i)}) - 1) || '북구'"
        f" when 2 then {pick(CODES, i, 22)}"
        f" when 3 then {pick(CODES, i, 22)} || '10100'"
        f" when 4 then {place(i)} || ' ' || {town(i)} || ' ' || {i}"
        f" else case {i} % 18 when 5 then '' when 11 then 'nan' else '미상' end end"
    )


def city_of(i: str) -> str:
    """The city key an address must normalize to."""
    return f"case when {i} % 6 < 5 then {place(i)} end"


def town_of(i: str) -> str:
    """The town key an address must normalize to."""
    return (
        f"case {i} % 6 when 3 then {place(i)} || '|' || {pick(CODES, i, 22)} || '101'"
        f" when 4 then {place(i)} || '|' || {town(i)} end"
    )


def dirty(i: str, value: str) -> str:
    """A text column in which some values are not plain numbers."""
    return (
        f"case {i} % 10 when 0 then '' when 1 then ' 12 ' when 2 then '1,234'"
        f" when 3 then '1d' else cast({value} as varchar(40)) end"
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as messy text: address, dirty balance, yes/no flag."""
    return read(spark, folder, "customer").select(
        "*",
        F.expr(address("c_custkey")).alias("c_address"),
        F.expr(dirty("c_custkey", "c_acctbal")).alias("c_balance"),
        F.expr("case when c_acctbal > 5000 then 'Y' else 'N' end").alias("c_rich"),
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").select(
        "*",
        F.expr(address("s_suppkey")).alias("s_address"),
        F.expr(dirty("s_suppkey", "s_acctbal")).alias("s_balance"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders", spread=True).select("*", F.expr(address("o_orderkey")).alias("o_address"))


# The same derived tables for the SQL side; *_city and *_town are the expected keys.
CUSTOMERS = (
    f"(select *, {address('c_custkey')} as c_address, {city_of('c_custkey')} as c_city,"
    f" {town_of('c_custkey')} as c_town, {dirty('c_custkey', 'c_acctbal')} as c_balance,"
    " case when c_acctbal > 5000 then 'Y' else 'N' end as c_rich from customer)"
)
SUPPLIERS = (
    f"(select *, {address('s_suppkey')} as s_address, {city_of('s_suppkey')} as s_city,"
    f" {town_of('s_suppkey')} as s_town, {dirty('s_suppkey', 's_acctbal')} as s_balance from supplier)"
)
ORDERS = (
    f"(select *, {address('o_orderkey')} as o_address, {city_of('o_orderkey')} as o_city,"
    f" {town_of('o_orderkey')} as o_town from orders)"
)


def sql_double(column: str) -> str:
    """The number a text column holds (no separators removed)."""
    return f"try_cast({column} as double)"


def sql_metric(column: str) -> str:
    return f"try_cast(replace({column}, ',', '') as double)"


def tables(spark: SparkSession, folder: str) -> dict[str, SourceTable]:
    """The tables a spec may name in the registered queries."""
    return {
        "customer": SourceTable(customers(spark, folder), "Customers"),
        "supplier": SourceTable(suppliers(spark, folder), "Suppliers"),
        "orders": SourceTable(orders(spark, folder), "Orders"),
        "part": SourceTable(read(spark, folder, "part"), "Parts"),
        "lineitem": SourceTable(read(spark, folder, "lineitem"), "Line items"),
        "events": SourceTable(read(spark, folder, "events"), "Events"),
        "nation": SourceTable(nations(spark, folder), "Nations"),
    }


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with their two-level key ``region|nation``."""
    region = read(spark, folder, "region")
    nation = read(spark, folder, "nation")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name", F.concat_ws("|", "r_name", "n_name").alias("n_path")
    )


NATIONS = (
    "(select n_nationkey, n_name, r_name, r_name || '|' || n_name as n_path"
    " from nation join region on n_regionkey = r_regionkey)"
)
