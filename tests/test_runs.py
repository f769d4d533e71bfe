"""Running specs: joins, statistics, drop report, gate, filters, stored runs."""

import json

import pytest
from pyspark.sql import functions as F

from keyweave import SourceTable, run_spec
from keyweave.operators.filters import filter_result
from keyweave.operators.quality import stop_signal
from keyweave.plans.spec import SpecError
from keyweave.plans.stored import payload_schema, run_stored, stage_report


@pytest.fixture(scope="module")
def tables(spark):
    left = [("포항시 장량동", "1,000", "Y"), ("포항시 장량동", "", "N"), ("경주시 황성동", "x", "Y"), ("없음", "5", "N")]
    right = [("포항 1", "10"), ("구미시", "20"), ("구미", "nan")]
    return {
        "left": SourceTable(spark.createDataFrame(left, "Addr string, cost string, flag string"), "Left"),
        "right": SourceTable(spark.createDataFrame(right, "addr string, cost string"), "Right"),
    }


def source(alias, dataset, name, column="addr", level="sgg", **more):
    return {"alias": alias, "dataset_id": dataset, "key": {"column": column, "level": level}, "metrics": [{"name": name, "agg": "count"}], **more}


def test_join_and_accounting(tables):
    run = run_spec({"sources": [source("a", "left", "n"), source("b", "right", "m")]}, tables)
    assert [tuple(r) for r in run.result.collect()] == [("포항시", 2, 1)]
    detail = {r.alias: r for r in run.dropped_detail.collect()}
    assert (detail["a"].keys, detail["a"].matched, detail["a"].match_rate, detail["a"].dropped) == (3, 1, 0.333, 2)
    assert detail["a"].dropped_keys == ["경주시"] and detail["a"].reason_code == "missing_normalized_key"
    assert (detail["b"].keys, detail["b"].match_rate, detail["b"].reason_code) == (2, 0.5, "unmatched_normalized_key")
    signal = run.gate().first()
    assert (signal.reason, signal.observed, signal.title) == ("match_rate", 0.333, "Left")


def test_left_join_allows_partial_match_but_counts_nulls(tables):
    run = run_spec({"sources": [source("a", "left", "n"), source("b", "right", "m")], "join": "left"}, tables)
    assert run.stats.first().null_rate == round(1 / 6, 4)
    assert run.gate().first().reason is None


def test_metrics_read_numbers_after_commas(tables):
    metrics = [{"name": "s", "agg": "sum", "column": "cost"}, {"name": "c", "agg": "count", "column": "cost"}, {"name": "y", "agg": "count_if", "column": "flag"}]
    rows = run_spec({"sources": [source("a", "left", "n", metrics=metrics)], "order_by": [{"name": "s", "desc": True}]}, tables).result.collect()
    assert [tuple(r) for r in rows] == [("포항시", 1000.0, 2, 1), ("경주시", None, 1, 1)]


def test_nan_is_counted_as_value_but_leaves_as_null(tables):
    spec = {"sources": [source("b", "right", "m", metrics=[{"name": "s", "agg": "sum", "column": "cost"}])]}
    run = run_spec(spec, tables)
    assert {r.k: r.s for r in run.result.collect()} == {"포항시": 10.0, "구미시": None}
    assert run.stats.first().null_rate == 0.0


def test_columns_resolve_without_case_and_unknown_ones_fail(tables):
    assert run_spec({"sources": [{"alias": "a", "dataset_id": "left", "columns": ["ADDR"]}]}, tables).result.columns == ["Addr"]
    with pytest.raises(SpecError):
        run_spec({"sources": [source("a", "left", "n", column="nowhere")]}, tables)
    with pytest.raises(SpecError):
        run_spec({"sources": [source("a", "unknown", "n")]}, tables)


@pytest.mark.parametrize(
    "rows, baseline, match, null_rate, partial, reason",
    [
        (0, None, None, 0.0, False, "empty_result"),
        (4, 10, None, 0.0, False, "row_drop"),
        (1, None, 0.4, 0.0, False, "match_rate"),
        (1, None, 0.488, 0.0, True, None),
        (1, None, 0.488, 0.21, True, "null_rate"),
        (1, None, None, 0.21, False, "null_rate"),
        (1, 0, 0.5, 0.2, False, None),
    ],
)
def test_gate_cases(spark, rows, baseline, match, null_rate, partial, reason):
    schema = "row_count bigint, baseline bigint, lowest_match double, null_rate double, allow_partial boolean"
    stats = spark.createDataFrame([(rows, baseline, match, null_rate, partial)], schema)
    assert stop_signal(stats).first().reason == reason


def test_hierarchical_result_filter(spark):
    df = spark.createDataFrame([("포항시|송라면", 3), ("경주시|황성동", 4), ("포항시민", 5)], "key string, n int")
    schema = {"properties": {"region": {"column": "key"}}}
    assert [r.n for r in filter_result(df, {"region": "포항시"}, schema).collect()] == [3]
    assert [r.n for r in filter_result(df, {"region": ["포항시", "경주시"], "n": 4}, schema).collect()] == [4]
    assert filter_result(df, {"n": "4"}).count() == 0
    for bad in ({"other": "x"}, {"n": None}):
        with pytest.raises(SpecError):
            filter_result(df, bad, schema)


STORED = {
    "spec": {"sources": [source("a", "left", "n", level="emd")]},
    "request": {"filters": {"k": "포항시"}},
    "schema": {"type": "object", "properties": {"k": {"column": "k"}, "count": {"column": "n"}}},
}


def test_stored_run(tables):
    run = run_stored(json.dumps(STORED), {}, tables)
    assert [json.loads(r.output) for r in run.rows.collect()] == [{"k": "포항시|장량동", "count": 2}]
    assert run.signal.first().reason is None
    other = run_stored(STORED, {"request": {"filters": {"k": "없는시"}}}, tables)
    assert other.signal.first().reason == "empty_result"
    with pytest.raises(SpecError):
        run_stored(STORED, {"limit": 5}, tables)
    with pytest.raises(SpecError):
        run_stored(STORED, {"request": {"filters": {"k": [["x"]]}}}, tables)
    with pytest.raises(SpecError):
        run_stored({"spec": None}, {}, tables)


def test_schema_precedence():
    assert payload_schema({"properties": {}}, {"a": 1}) == {"properties": {}}
    assert payload_schema({}, {"a": 1}) == {"a": 1} and payload_schema(None, {}) is None


def test_stage_report_skips_after_a_stop(tables):
    report = {r.stage: r for r in stage_report({"sources": [source("a", "left", "n"), source("b", "right", "m")]}, tables).collect()}
    assert report["a"].status == "ok" and report["operation"].reason == "match_rate" and report["output"].status == "skipped"


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"), F.lit("y").alias("c")).write.parquet(path)
    table = SourceTable(spark.read.parquet(path))
    spec = {"sources": [{"alias": "s", "dataset_id": "t", "key": {"column": "a"}, "filters": [{"column": "b", "op": "=", "value": "x"}]}]}
    plan = run_spec(spec, {"t": table}).unlimited._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(b,x)" in plan and "IsNotNull(a)" in plan and "ReadSchema: struct<a:string,b:string>" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    from keyweave.operators.sorting import top_k_per_group

    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    assert "WindowGroupLimit" in plan_of(top_k_per_group(df, ["g"], [F.col("id").desc()], 2))


def test_computed_keys_are_evaluated_once(tables):
    plan = plan_of(run_spec({"sources": [source("a", "left", "n"), source("b", "right", "m")]}, tables).unlimited)
    scans = [line for line in plan.splitlines() if "regexp_extract" in line]
    assert len(scans) == 2 and not any("Filter" in line for line in scans)


def test_one_row_tables_are_subqueries(tables):
    run = run_spec({"sources": [source("a", "left", "n"), source("b", "right", "m")]}, tables)
    plan = plan_of(run.gate())
    assert "NestedLoop" not in plan and "Cartesian" not in plan
