"""Target-distribution importance resampling over hashed word n-grams, by an Aho-Corasick dictionary.

A dictionary of delimiter-bounded words is compiled into an Aho-Corasick automaton; each word
carries its CRC-32 and its length in bytes as payload. One scan of a text emits the payloads of its
words in order. The CRC of a run of words follows from its parts' payloads alone: appending
``n`` bytes multiplies a CRC by x**(8n) in the CRC's field and adds that of the appended
part, so runs of up to ``longest`` words are composed from neighbouring payloads without touching the text
again. A run's CRC modulo ``buckets`` is its bucket.

The dictionary holds the most frequent words of a documented, bounded sample (``SAMPLE_ROWS``
documents, ``DICTIONARY`` words). It only saves time: wherever the scan leaves a gap between delimiters, the
words in the gap get their payload directly, so every word of every text is counted, and results don't depend on
the dictionary.

Bucket counts of raw and target texts are summed per task before they are shuffled; at most ``buckets`` rows reach the
driver, which makes the table of gains. A second scan sums the gains per document and adds Gumbel noise
keyed by the document's id. The drawn documents get ranks by a range sort, whose ranges are numbered
by their sizes, so no task sees more than its range.

Definitions: a null or empty text has no words, weight 0, and isn't drawn when ``least_words`` is above 0; texts of any
length are scanned whole; a null doc_id is hashed as the empty text and is last among equal scores; repeated rows
are scored, ranked and drawn each; rows equal in score and id share nothing but take neighbouring
ranks; with an empty target or raw table its counts are 0; an empty table of documents gives an empty result; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.llm.common import cut_lineage, partitions, slices, texts_of

# Bounds of the dictionary: sampled documents (in expectation), and words kept.
SAMPLE_ROWS = 4096
DICTIONARY = 50_000
# Bytes of text that a task looks at together.
SLICE = 4 << 20

# A-Z in lower case; all other ASCII characters but digits and a-z delimit words.
_FOLD = {c: (chr(c).lower() if chr(c).isalnum() else " ") for c in range(128)}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text: str) -> str:
    """The text with delimiters as spaces and A-Z in lower case."""
    return text.translate(_FOLD)


def _advance_table() -> np.ndarray:
    """How a zero byte moves each byte of a CRC register: one step of the CRC's table-driven form."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


class Composer:
    """CRCs of joined byte strings from the parts' CRCs and lengths, for many pairs at a time."""

    def __init__(self) -> None:
        step = _advance_table()
        # powers[j][b]: what the operator "append 2**j zero bytes" makes of bit b of a CRC
        bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
        self.powers = [(bits >> np.uint32(8)) ^ step[bits & np.uint32(255)]]

    @staticmethod
    def _apply(operator: np.ndarray, crcs: np.ndarray) -> np.ndarray:
        out = np.zeros_like(crcs)
        for b in range(32):
            out ^= np.where((crcs >> np.uint32(b)) & np.uint32(1), operator[b], np.uint32(0))
        return out

    def join(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of first + second, where ``second`` has ``length`` bytes."""
        moved, j = first.copy(), 0
        while len(length) and int(length.max()) >> j:
            if j == len(self.powers):
                self.powers.append(self._apply(self.powers[-1], self.powers[-1]))
            at = np.flatnonzero((length >> j) & 1)
            moved[at] = self._apply(self.powers[j], moved[at])
            j += 1
        return moved ^ second


class Scanner:
    """Emits the payloads of a text's words."""

    def __init__(self, words: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        payloads = []
        for word in words:
            data = word.encode()
            self.automaton.add_word(f" {word} ", len(payloads))
            payloads.append((zlib.crc32(data), len(data), len(word)))
        if words:
            self.automaton.make_automaton()
        table = np.array(payloads or [(0, 0, 0)], dtype=np.int64)
        self.crcs, self.sizes, self.lengths = table[:, 0].astype(np.uint32), table[:, 1], table[:, 2]
        self.known = bool(words)
        self.composer = Composer()

    def payloads(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, bytes) of each word in order."""
        padded = f" {folded(text)} "
        hits = self.automaton.iter(padded) if self.known else ()
        flat = np.fromiter(chain.from_iterable(hits), dtype=np.int64).reshape(-1, 2)
        which = flat[:, 1]
        crcs, sizes, ends = self.crcs[which], self.sizes[which], flat[:, 0]
        starts = ends - self.lengths[which]  # of the word itself, whose delimiter stands at ends
        # gaps between emitted words that hold more than one delimiter may hold further words
        lefts = np.concatenate([np.zeros(1, np.int64), ends])
        rights = np.concatenate([starts, np.full(1, len(padded) - 1)])
        at, extra = [], []
        for g in np.flatnonzero(rights - lefts > 1).tolist():
            for word in padded[lefts[g] : rights[g]].split(" "):
                if word:
                    data = word.encode("utf-8", "surrogatepass")
                    at.append(g)
                    extra.append((zlib.crc32(data), len(data)))
        if extra:
            more = np.array(extra, dtype=np.int64)
            crcs = np.insert(crcs, at, more[:, 0].astype(np.uint32))
            sizes = np.insert(sizes, at, more[:, 1])
        return crcs, sizes

    def buckets(self, text: str, longest: int, buckets: int) -> tuple[np.ndarray, int]:
        """(bucket of each run of 1 to ``longest`` words, number of words)."""
        crcs, sizes = self.payloads(text)
        out, runs = [crcs], crcs
        space = np.uint32(zlib.crc32(b" "))
        for n in range(1, min(longest, len(crcs))):
            # a run of n words, a space, and the word after it
            tail = self.composer.join(np.full(len(crcs) - n, space), crcs[n:], sizes[n:])
            runs = self.composer.join(runs[: len(crcs) - n], tail, sizes[n:] + 1)
            out.append(runs)
        return np.concatenate(out).astype(np.int64) % buckets, len(crcs)


def dictionary(docs: DataFrame, target: DataFrame, words: int = DICTIONARY, rows: int = SAMPLE_ROWS) -> list[str]:
    """The most frequent words of a bounded sample of the documents (by a hash of the id) and of the target texts."""
    every = max(1, math.ceil(docs.count() / rows))
    some = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % every == 0).select("text")
    texts = some.union(target.where(F.crc32(F.coalesce("text", F.lit(""))) % max(1, math.ceil(target.count() / rows)) == 0).select("text"))
    found = (
        texts.select(F.explode(F.regexp_extract_all(_lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
        # long words are rare, and would make the dictionary's size unbounded
        .where(F.length("word") <= 64)
        .groupBy("word")
        .count()
        .orderBy(F.desc("count"), "word")
        .limit(words)
    )
    return [r["word"] for r in found.collect()]


def _lower(name: str) -> Column:
    import string

    return F.translate(F.coalesce(name, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Model:
    """The dictionary's words and the gain of each bucket."""

    words: list[str]
    gains: np.ndarray
    longest: int


def _counts(rows: DataFrame, words, longest: int, buckets: int) -> np.ndarray:
    """How many features of the texts fall in each bucket."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words.value)
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = [scanner.buckets(text, longest, buckets)[0] for text in texts_of(part.column("text"))]
                sums += np.bincount(np.concatenate(found), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in found.collect():
        out[row["bucket"]] = row["n"]
    return out


def learn(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> Model:
    """The gains of buckets: how much likelier a feature is in the target texts than in all documents."""
    words = dictionary(docs, target)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    raw = _counts(docs, shared, longest, buckets)
    aim = _counts(target, shared, longest, buckets)
    all_raw, all_aim = int(raw.sum()), int(aim.sum())
    gains = [
        math.floor(1000 * math.log(float(t + 1) * float(all_raw + buckets) / (float(s + 1) * float(all_aim + buckets))))
        for s, t in zip(raw.tolist(), aim.tolist())
    ]
    return Model(words, np.array(gains, dtype=np.int64), longest)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, in floored thousandths, from a hash of its id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, model: Model, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of each document."""
    buckets = len(model.gains)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scanner = Scanner(known.words)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                facts = []
                for text in texts_of(part.column("text")):
                    found, words = scanner.buckets(text, known.longest, buckets)
                    facts.append((len(found), words, int(known.gains[found].sum())))
                table = np.array(facts, dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(table[:, i]) for i in range(3))],
                    ["doc_id", "n_features", "n_words", "weight"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_features long, n_words long, weight long"
    )
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Number rows from 1 in an order, as ``rank``: ranges are sorted apart and offset by the sizes of those before."""
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                [*names, "_range", "_place"],
            )
            at += n

    spark = rows.sparkSession
    shape = T.StructType(rows.schema.fields).add("_range", T.IntegerType()).add("_place", T.LongType())
    placed = cut_lineage(
        rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(number, shape)
    )
    # one row per range
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_range int, _start long")
    return placed.join(F.broadcast(offsets), "_range").select(
        *names, (F.col("_start") + F.col("_place") + 1).alias("rank")
    )


def resample(docs: DataFrame, model: Model, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every document with its score; the drawn ones, a percentage of those with enough words, with their rank."""
    rows = cut_lineage(score(docs, model, seed))
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    chosen = ranked(rows.where(enough), *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return chosen.union(rest).select("doc_id", "n_features", "weight", "score", "rank")
