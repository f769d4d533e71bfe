"""Filters compare numbers as they are written."""

from decimal import Decimal

from keyweave.operators.filters import predicate
from keyweave.plans.spec import Filter
from keyweave.plans.suggest import suggested_metrics
from pyspark.sql import functions as F

BIG = 9007199254740993  # not a double


def kept(df, op, value):
    return sorted(r[0] for r in df.where(predicate(df, Filter("id", op, value))).collect())


def test_whole_numbers_beyond_doubles(spark):
    df = spark.createDataFrame([(BIG - 1,), (BIG,), (BIG + 1,)], "id long")
    for value in (BIG, str(BIG), f" {BIG}.0 "):
        assert kept(df, "=", value) == [BIG]
        assert kept(df, "!=", value) == [BIG - 1, BIG + 1]
        assert kept(df, ">", value) == [BIG + 1]
        assert kept(df, "<=", value) == [BIG - 1, BIG]
    assert kept(df, "in", (str(BIG), str(BIG + 1))) == [BIG, BIG + 1]
    assert kept(df, "<", 10**30) == [BIG - 1, BIG, BIG + 1]
    assert kept(df, "=", "many") == []


def test_decimals_and_doubles(spark):
    prices = spark.createDataFrame([(Decimal("1.10"),), (Decimal("1.11"),)], "id decimal(10,2)")
    assert kept(prices, "=", "1.1") == [Decimal("1.10")]
    doubles = spark.createDataFrame([(0.5,), (2.0,), (1e300,)], "id double")
    assert kept(doubles, ">=", "2") == [2.0, 1e300] and kept(doubles, "=", 0.5) == [0.5] and kept(doubles, "=", "1e300") == [1e300]


def test_averaged_names_in_any_case(spark):
    names = ["AVG_TEMP", "PM10", "UnitPrice", "total_cnt"]
    rows = [(name, 0, name, "numeric", []) for name in names]
    columns = spark.createDataFrame(rows, "dataset_id string, column_pos int, name string, role string, samples array<string>")
    found = {r.dataset_id: r["agg"] for r in suggested_metrics(columns, F.lit("a")).where("metric_pos = 1").collect()}
    assert found == {"AVG_TEMP": "avg", "PM10": "avg", "UnitPrice": "avg", "total_cnt": "sum"}
