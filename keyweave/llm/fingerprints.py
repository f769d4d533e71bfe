"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. On each level runs of one symbol are named first, so neighbours differ;
deterministic coin tossing (the lowest bit in which a symbol differs from its left neighbour, and
its value) then shrinks the labels to a few values, and phrases begin at their local maxima. A
phrase's name is a hash of its symbols and is a symbol of the next level. Boundaries depend on a
few neighbours only, so equal substrings get equal names inside, at whatever offset they stand.
The fingerprint is a one-permutation MinHash of the names of all levels from the second up (about
ten characters and more) and of the name of the whole where the text is shorter.

``compare`` walks all documents in descending order of doc_id. Ids are cut into ranges of about equal
size; each range is sorted by itself and ends with a copy of the first document of the next.

Definitions: a null text counts as empty, and all empty texts have one fingerprint (of empty slots,
likeness 1 to each other, 0 to others); null doc_ids come last; rows of one doc_id follow each
other in descending order of text; one document alone is its own next one; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import partitions, texts_of

SLOTS = 128
FIRST_LEVEL = 2
MOST_LEVELS = 40
CHARS_PER_STEP = 1 << 20
NO_ID = -(1 << 63)

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)

_EMPTY = 256  # a slot without a name
_PAIRS = [f"{value:02x}" for value in range(256)] + ["--"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing; neighbours that differ get labels that differ."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = ~labels[first]
    other = labels ^ before
    place = np.bitwise_count((other & (~other + labels.dtype.type(1))) - labels.dtype.type(1))
    return (2 * place + ((labels >> place.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)).astype(
        np.uint8
    )


def _named(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the blocks of symbols that begin at ``starts``."""
    lengths = np.diff(starts, append=len(symbols))
    place = (np.arange(len(symbols)) - np.repeat(starts, lengths)).astype(np.uint64)
    salted = _mix(symbols + (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return _mix(np.add.reduceat(salted, starts))


def _runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name runs of one symbol by it and their length; returns symbols and first places of texts."""
    begins = np.ones(len(symbols), dtype=bool)
    begins[1:] = symbols[1:] != symbols[:-1]
    begins[first] = True
    starts = np.flatnonzero(begins)
    if len(starts) == len(symbols):
        return symbols, first
    lengths = np.diff(starts, append=len(symbols)).astype(np.uint64)
    kept = symbols[starts]
    repeated = lengths > 1
    kept[repeated] = _mix(kept[repeated] ^ (lengths[repeated] * np.uint64(0xA24BAED4963EE407)))
    # two named runs may meet by chance of the hash only
    return kept, np.searchsorted(starts, first)


def levels(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level its number, the names of all phrases and the text (by place) each belongs to.

    Empty texts have no names. The last level of a text is the one with a single name.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owners = np.flatnonzero(sizes)
    if len(owners) == 0:
        return
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = (np.cumsum(sizes) - sizes)[owners]
    for level in range(1, MOST_LEVELS):
        symbols, first = _runs(symbols, first)
        labels = _toss(symbols, first)
        for _ in range(3):
            labels = _toss(labels, first)
        begins = np.zeros(len(symbols), dtype=bool)
        begins[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
        # a text's last symbol has no neighbour to the right, whatever text comes next
        begins[np.append(first[1:], len(symbols)) - 1] = False
        begins[first] = True
        # the symbol after a text's first one stays with it
        second = first + 1
        begins[second[second < len(symbols)]] &= np.isin(second[second < len(symbols)], first)
        starts = np.flatnonzero(begins)
        symbols = _named(symbols, starts)
        first = np.searchsorted(starts, first)
        counts = np.diff(first, append=len(symbols))
        yield level, symbols, np.repeat(owners, counts)
        long = counts > 1
        if not long.any():
            return
        if not long.all():
            keep = np.repeat(long, counts)
            symbols, owners, counts = symbols[keep], owners[long], counts[long]
            first = np.cumsum(counts) - counts


def sketches(texts: list[str]) -> np.ndarray:
    """The fingerprints of texts as rows of slots: 0 to 255, or 256 where no name fell."""
    least = np.full(len(texts) * SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for level, names, owner in levels(texts):
        if level < FIRST_LEVEL:  # only those of texts that end here
            alone = np.bincount(owner, minlength=len(texts))[owner] == 1
            names, owner = names[alone], owner[alone]
        hashed = _mix(names + np.uint64(level))
        slot = owner * SLOTS + (hashed & np.uint64(SLOTS - 1)).astype(np.int64)
        np.minimum.at(least, slot, hashed >> np.uint64(7))
    out = (_mix(least) & np.uint64(255)).astype(np.int64)
    out[least == np.iinfo(np.uint64).max] = _EMPTY
    return out.reshape(len(texts), SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common names, from 0 to 1; 1 for equal fingerprints."""
    either = (a != _EMPTY) | (b != _EMPTY)
    equal = (a == b) & either
    share = equal.sum(axis=1) / np.maximum(either.sum(axis=1), 1)
    chance = 1 / 256
    out = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    out[(a == b).all(axis=1)] = 1.0
    return out


def text_form(sketch: np.ndarray) -> str:
    return "".join(map(_PAIRS.__getitem__, sketch.tolist()))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            forms = [text_form(s) for part in _steps(texts) for s in sketches(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(forms, pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _steps(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= CHARS_PER_STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


def _ranged(rows: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """The rows with the number of their range of ids, ranges in descending order."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.approxQuantile("sort_id", shares, 0.25 / ranges) if shares else []
    cuts = np.unique(np.array(bounds, dtype=np.float64))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("sort_id").to_numpy().astype(np.float64)
            place = len(cuts) - np.searchsorted(cuts, ids, side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place.astype(np.int32))], [*batch.schema.names, "range"]
            )

    return rows.mapInArrow(number, "doc_id long, text string, sort_id long, range int"), len(cuts) + 1


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with the next one; rows come sorted, a range's last is a copy to look at only."""

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        texts = [text for _, text, _, _ in rows]
        own = sketches(texts)
        edited = [_edited(a, b) for a, b in zip(texts, texts[1:])]
        changed = sketches(edited) if edited else own[:0]
        near_edited = likeness(own[:-1], changed)
        near_next = likeness(own[:-1], own[1:])
        picked = [i for i, row in enumerate(rows[:-1]) if not row[3]]
        columns = [
            [rows[i][0] for i in picked],
            [len(texts[i]) for i in picked],
            [hashlib.sha256(edited[i].encode()).hexdigest() for i in picked],
            [text_form(own[i]) for i in picked],
            [text_form(changed[i]) for i in picked],
            [float(near_edited[i]) for i in picked],
            [float(near_next[i]) for i in picked],
        ]
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "border")]
        for row in zip(*columns):
            held.append(row)
            size += len(row[1])
            if size >= CHARS_PER_STEP and len(held) > 1:
                yield compared(held)
                held, size = held[-1:], len(row[1])
    if len(held) > 1:
        yield compared(held)


def compare(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near text, edited text and next text are.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the
    next document, in descending order of doc_id; after the last comes the first.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("sort_id"),
    )
    ranges = ranges or partitions(docs.sparkSession)
    ranged, _ = _ranged(rows, ranges)
    firsts = sorted(
        ((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.max("sort_id").alias("first")).collect())
    )  # one row per range
    if not firsts:
        return ranged.select("doc_id", "text", "range", F.lit(False).alias("border")).mapInArrow(_walk, RESULT)
    following = [(part, firsts[(i + 1) % len(firsts)][1]) for i, (part, _) in enumerate(firsts)]
    # one row per range: their number is that of the shuffle partitions
    targets = docs.sparkSession.createDataFrame(following, "target int, target_id long")
    borders = (
        ranged.filter(F.col("sort_id").isin([first for _, first in firsts]))
        .join(F.broadcast(targets), F.col("sort_id") == F.col("target_id"))
        .groupBy("target")
        .agg(F.max("text").alias("text"))
        .select(
            F.lit(None).cast("long").alias("doc_id"),
            "text",
            F.lit(NO_ID).alias("sort_id"),
            F.col("target").alias("range"),
            F.lit(True).alias("border"),
        )
    )
    return (
        ranged.withColumn("border", F.lit(False))
        .unionByName(borders)
        .repartition(ranges, "range")
        .sortWithinPartitions("range", "border", F.desc("sort_id"), F.desc("text"))
        .select("doc_id", "text", "range", "border")
        .mapInArrow(_walk, RESULT)
    )
