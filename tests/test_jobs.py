"""Recommended jobs can be run, and vectors of any shape can be searched."""

import json

from keyweave import SourceTable, run_spec
from keyweave.operators import search
from keyweave.plans.spec import parse_spec
from keyweave.plans.suggest import job_specs
from workloads.jobs import job_recommend

FOLDER = "/root/testdata/sf0.001"


def test_recommended_specs_parse(spark):
    rows = job_recommend(spark, FOLDER).collect()
    assert rows
    for row in rows:
        spec = parse_spec(json.loads(row.spec))
        assert len(spec.sources) >= 2 and {s.key.level for s in spec.sources} == {row.level}


def test_a_recommended_spec_runs(spark):
    jobs = spark.createDataFrame(
        [
            (1, 1, "raw", "a", "farms", "town", [(0, "count", "*", None), (1, "sum", "cows", None)]),
            (1, 1, "raw", "b", "shops", "place", [(0, "count", "*", None), (2, "count_if", "open", "Y")]),
            (2, 1, "raw", "a", "farms", None, [(0, "count", "*", None)]),
        ],
        "question_id int, rank int, level string, alias string, dataset_id string, key_column string,"
        " metrics array<struct<metric_pos: int, agg: string, column: string, value: string>>",
    )
    (row,) = job_specs(jobs).collect()
    tables = {
        "farms": SourceTable(spark.createDataFrame([("A", 3), ("A", 4), ("B", 5)], "town string, cows int"), "Farms"),
        "shops": SourceTable(spark.createDataFrame([("A", "Y"), ("A", "N"), ("C", "Y")], "place string, open string"), "Shops"),
    }
    (result,) = run_spec(json.loads(row.spec), tables).result.collect()
    assert result.asDict() == {"key": "A", "a_count": 2, "a_sum_cows": 7, "b_count": 2, "b_open_Y": 1}


def test_missing_and_ragged_vectors_count_as_zero(spark):
    documents = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0, 5.0]), (4, [0.6, None]), (5, [-1.0, 0.0])], "doc_id int, vector array<double>"
    )
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "question_id int, vector array<double>")
    found = {r.doc_id: r.cosine for r in search.cosine_top(asked, documents, 10).collect()}
    assert found == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: -1.0}
    assert search.unsound_vectors(documents, asked).first().replaced == 3


def test_keys_of_recommended_joins_are_found_once_per_cell(spark, monkeypatch):
    from keyweave.plans import suggest

    stored = []
    keep = suggest.cut_lineage
    monkeypatch.setattr(suggest, "cut_lineage", lambda df: stored.append(df) or keep(df))
    long = spark.createDataFrame([("x", 1, "addr", "포항시 1"), ("x", 2, "addr", "없음"), ("x", 1, "n", "5")], "dataset_id string, row_id long, column string, value string")
    metrics = "array<struct<metric_pos:int,agg:string,column:string,value:string>>"
    jobs = spark.createDataFrame([(1, 1, "sgg", "a", "x", "addr", [(0, "count", "*", None), (1, "sum", "n", None)])], f"question_id int, rank int, level string, alias string, dataset_id string, key_column string, metrics {metrics}")
    rows = suggest.run_join_jobs(jobs, long, suggest.Gazetteer()).collect()
    assert [(r.key, r.metrics) for r in rows] == [("포항시", {"a_count": 1.0, "a_sum_n": 5.0})]
    keyed = next(df for df in stored if "row_id" in df.columns)
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in line and "CASE" in line for line in plan.splitlines() for step in ("Filter", "Join"))
