"""A corpus pipeline of five stages: each takes what its predecessor kept.

``run`` writes each stage's documents to the shared folder and reads them again for the next.
Stages lower the session's limit of bytes in a batch handed to Python and leave it so, as their results are computed later.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from keyweave.llm import exact_dedup, minhash, packing, quality, toxicity
from keyweave.llm.common import cut_lineage, documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Spark fills a batch for Python up to this many bytes (64 MB unless set); executor and worker hold several at a time.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def small_batches(stage: Stage) -> Stage:
    """A stage that hands rows to Python in batches of about ``BATCH_BYTES``."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones, scores below 0.5."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, _labels(spark, sf_dir)))


@small_batches
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The Gumbel sample of all documents to which the n-gram models give weight."""
    return quality.resample(docs, quality.learn(docs, _labels(spark, sf_dir)), fraction=1.0)


@small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the largest id, of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicate(docs)


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# Learned models, signatures and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
