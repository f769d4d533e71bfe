"""The registered queries, the SQL for some, and the pipeline."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyweave.llm.queries import ORACLES, QUERIES
from workloads.compare import duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    found = QUERIES[name](spark, FOLDER)
    expected = duck(FOLDER).execute(f"select {', '.join(found.columns)} from ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(expected) and expected


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op8_packing", "op12_clusters")])
def test_one_row_per_document(spark, name):
    ids = Counter(r["doc_id"] for r in QUERIES[name](spark, FOLDER).collect())
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()
    assert ids == Counter(r["doc_id"] for r in given)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == columns and 0 < after.count() <= before
        kept = set(map(tuple, after.collect()))
        assert kept <= set(map(tuple, docs.collect()))
        docs, before = after, after.count()
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("kind", ["nasty", "empty"])
def test_pipeline_stages_take_odd_rows(spark, request, kind):
    """Null ids and texts, empty and long texts, repeated rows, clashing columns, and an empty table."""
    docs = request.getfixturevalue(kind)
    given = Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, FOLDER)
        rows = Counter(map(tuple, found.collect()))
        if name == "packing":
            assert bool(rows) == bool(given)
            continue
        assert found.columns == docs.columns and rows <= given, name
        if name == "exact_dedup":
            texts = [r[1] or "" for r in rows.elements()]
            assert sorted(texts) == sorted({r[1] or "" for r in given})


def test_pipeline_stages_hand_python_small_batches(spark, documents):
    setting = corpus_pipeline.BATCH_SETTING
    given = spark.conf.get(setting)
    wide = documents.select("doc_id", F.repeat("text", 200).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    try:
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
        stage = corpus_pipeline.small_batches(lambda spark, docs, folder: docs.mapInArrow(sizes, "size long"))
        assert max(r["size"] for r in stage(spark, wide, "").collect()) < 16 << 20
    finally:
        spark.conf.set(setting, given)
