"""The queries of this package: each operator over its whole table, and the SQL for some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyweave.llm import (
    byte_bpe,
    centroid_clustering,
    exact_dedup,
    fingerprints,
    licenses,
    line_dedup,
    minhash,
    oracles,
    packing,
    quality,
    resampling,
    secret_scan,
    token_count,
    toxicity,
)
from keyweave.llm.common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.score(docs, toxicity.learn(docs, labels))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(documents(spark, folder), extend=True)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.sample(docs, quality.learn(docs, labels))


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(documents(spark, folder))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return byte_bpe.round_trip(docs, _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, folder))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare(documents(spark, folder))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), _vocabulary("word_bpe_49k.json"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


def op10_token_count(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return token_count.count_tokens(docs, _vocabulary("byte_bpe_50k.json"), _pattern(), limit=1024)


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(documents(spark, folder))


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clustering.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return resampling.resample(docs, resampling.learn(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_minhash": op4_minhash,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_token_count": op10_token_count,
    "op11_secrets": op11_secrets,
    "op12_clusters": op12_clusters,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": """
        select doc_id,
               max(doc_id) over w as keep_id,
               count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents
        window w as (partition by coalesce(text, ''))
    """,
    "op11_secrets": oracles.secrets(),
    "op12_clusters": oracles.clusters(),
    "op13_resampling": oracles.resampling(),
}
