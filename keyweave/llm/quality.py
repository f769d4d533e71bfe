"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Texts are bags of hashed unigrams and bigrams of words and marks. The raw model counts the n-grams of all
documents, the target model those of labelled good ones; both are smoothed bags of ``BUCKETS``
hashed n-grams. A document's log weight is the mean log ratio of target to raw probability
over its n-grams. Documents below a threshold, placed between the labelled good and bad rows,
weigh nothing; of the others a sample of given size without replacement is the top k by log weight
plus Gumbel noise, which is drawn from a hash of the document.

The target model and the threshold use at most about ``MOST_LABELS`` labelled rows; raw counts cover
all documents. The k-th key is found by counting, never by sorting all keys in one place.

Definitions: a null text counts as empty; texts without n-grams have log weight 0, as nothing speaks
against them; rows without a doc_id take part and are never learned from; several labels of one
document count as good only if all are; equal rows get equal keys and are taken or left together at the
k-th key, so the sample may exceed k by ties; without labelled rows of both kinds nothing is rejected;
an empty table gives an empty result. ``resample`` carries all columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import Recent, cut_lineage, in_slices, texts_of

BUCKETS = 1 << 14
MOST_LABELS = 20_000
SMOOTHING = 1.0
SHRINK = 8.0  # n-grams that speak for the average, so that very short texts are not judged by a word
CACHED_TOKENS = 200_000
SEED = 17

# A word, or a run of one mark with its length; white space is left out.
TOKEN = re.compile(r"\w+|([^\w\s])\1*")


class TokenHash(Recent):
    """Hash of a token: of words, of their first letters and case, so that unseen words count as well."""

    def __init__(self) -> None:
        super().__init__(CACHED_TOKENS)

    def __missing__(self, token: str) -> int:
        value = self.older.get(token)
        if value is None:
            value = xxhash.xxh32_intdigest(token)
        self.keep(token, value)
        return value


class Grams:
    """Counts of hashed n-grams in a task."""

    def __init__(self) -> None:
        self.hashes = TokenHash()

    def buckets(self, text: str) -> np.ndarray:
        tokens = [m.group() for m in TOKEN.finditer(text)]
        one = np.fromiter(map(self.hashes.__getitem__, tokens), np.uint64, len(tokens))
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        both = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two])
        return ((both ^ (both >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(rows: DataFrame) -> np.ndarray:
    """N-gram counts of all rows: each task sends one count per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in in_slices(batches):
            for text in texts_of(batch.column("text")):
                total += np.bincount(grams.buckets(text), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for row in counted.collect():  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


@dataclass
class Model:
    """Log ratios of target to raw probability per bucket, and the least mean ratio that is accepted."""

    ratios: np.ndarray
    threshold: float

    def log_weight(self, grams: Grams, text: str) -> float:
        buckets = grams.buckets(text)
        return float(self.ratios[buckets].sum() / (len(buckets) + SHRINK))


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS))


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Where the shares of good rows below and bad rows above are least in sum; good rows count tenfold."""
    if len(good) == 0 or len(bad) == 0:
        return -math.inf
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmin(10 * lost + passed)])


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model:
    """A model from all documents and those that ``labels`` (doc_id, quality) covers.

    Rows with crc32(doc_id) mod 5 = 0 are left out of the labelled ones, for tests.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(
            F.col("doc_id").isNotNull()
            & F.col("quality").isin(0, 1)
            & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        )
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    share = min(1.0, most_labels / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = _counts(rows)
    # about most_labels rows of two numbers: bounded by the parameter
    labelled = rows.join(F.broadcast(picked), "doc_id").select("text", "quality")
    target = _counts(labelled.filter("quality = 1"))
    if not target.any():
        return Model(np.zeros(BUCKETS), -math.inf)
    model = Model(_log_probabilities(target) - _log_probabilities(raw), -math.inf)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in in_slices(batches):
            weights = [model.log_weight(grams, t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(weights, pa.float64()), batch.column("quality")], ["weight", "quality"]
            )

    found = labelled.mapInArrow(weigh, "weight double, quality int").collect()
    by_kind = {q: np.array([r["weight"] for r in found if r["quality"] == q]) for q in (0, 1)}
    model.threshold = _threshold(by_kind[1], by_kind[0])
    return model


def _gumbel(keys: list[str]) -> np.ndarray:
    """Standard Gumbel noise, a function of each key."""
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(k, seed=SEED) for k in keys), np.uint64, len(keys))
    uniform = ((hashed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(uniform))


def _weighed(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log_weight, accepted, key; the key of rejected documents is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in in_slices(batches):
            texts = texts_of(batch.column("text"))
            weights = np.array([model.log_weight(grams, t) for t in texts])
            ids = batch.column("doc_id").to_pylist()
            noise = _gumbel([str(i) if i is not None else t for i, t in zip(ids, texts)])
            accepted = weights >= model.threshold
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(weights),
                    pa.array(accepted),
                    pa.array(weights + noise, mask=~accepted),
                ],
                ["doc_id", "log_weight", "accepted", "key"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, log_weight double, accepted boolean, key double")


def _kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column ``key``, by counting in ever finer bins."""
    low, high, above, bins = -64.0, 128.0, 0, 4096
    inside = keys.filter(F.col("key").isNotNull())
    for _ in range(5):
        width = (high - low) / bins
        if width < 1e-12:
            break
        place = F.least(F.greatest(F.floor((F.col("key") - low) / width), F.lit(0)), F.lit(bins - 1))
        counted = (
            inside.filter((F.col("key") >= low) & (F.col("key") < high))
            .groupBy(place.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for row in sorted(counted, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high = low + row["bin"] * width, low + (row["bin"] + 1) * width
                break
            above += row["n"]
        else:
            return low
    return low


def sample(docs: DataFrame, model: Model, fraction: float = 0.5) -> DataFrame:
    """One row per document: doc_id, log_weight, kept, key, sampled.

    ``kept`` holds where the weight isn't zero. ``sampled`` marks the Gumbel top k of those, where k
    is ``fraction`` of them.
    """
    weighed = cut_lineage(_weighed(docs, model))
    k = int(weighed.filter("accepted").count() * fraction + 0.5)
    least = _kth_largest(weighed, k) if k and fraction < 1 else -math.inf if k else math.inf
    return weighed.select(
        "doc_id",
        "log_weight",
        F.col("accepted").alias("kept"),
        "key",
        (F.col("accepted") & (F.col("key") >= F.lit(least))).alias("sampled"),
    )


def resample(docs: DataFrame, model: Model, fraction: float = 1.0) -> DataFrame:
    """The documents of a Gumbel top-k sample, with all their columns.

    At fraction 1 the sample is all documents of non-zero weight, whatever the noise.
    """
    least = -math.inf
    if fraction < 1:
        weighed = cut_lineage(_weighed(docs, model))
        k = int(weighed.filter("accepted").count() * fraction + 0.5)
        least = _kth_largest(weighed, k) if k else math.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in in_slices(batches):
            texts = texts_of(batch.column(batch.schema.get_field_index("text")))
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            weights = np.array([model.log_weight(grams, t) for t in texts])
            keys = weights + _gumbel([str(i) if i is not None else t for i, t in zip(ids, texts)])
            yield batch.filter(pa.array((weights >= model.threshold) & (keys >= least)))

    return docs.mapInArrow(run, docs.schema)
