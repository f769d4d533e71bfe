"""Helpers the operators share: reading documents, whitespace segments, bounded id filters."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.session import cut_lineage as cut_lineage

# The code points with the Unicode property White_Space.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A run of white space with the run of other characters after it. No token of the tokenizers
# used here spans the boundary between a non-white and a white character.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

BLOOM_BITS = 1 << 24


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def segments(text: str) -> list[str]:
    return SEGMENT.findall(text)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text, to bound a task's memory."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(
        pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64
    )
    run = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(start, end - start)


def _give_back() -> None:
    """Return memory that is no longer used to the system, where the C library offers it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# What a worker keeps from task to task, by the operator's name.
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What this worker keeps for an operator's tasks, made when first asked for."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def fresh(batches: Iterator[pa.RecordBatch], name: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a task. Python workers are used again: what other operators' tasks left is given back first."""
    for other in [n for n in _held if n != name]:
        del _held[other]
    _give_back()
    yield from batches
    _give_back()


def in_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of about ``most`` bytes of text, so that few texts are Python objects at a time."""
    for batch in fresh(batches):
        yield from slices(batch, text, most)


class Recent(dict):
    """A dictionary of the recently used keys, of at most twice ``most`` entries.

    Keys are looked up at a plain dictionary's speed. When it is full it becomes the
    older half; keys met again move from there to the new one.
    """

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.older: dict = {}

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def recall(self, keys: set) -> list:
        """Those of the keys that aren't known; known ones are at hand afterwards."""
        if len(self) + len(keys) > self.most:
            self.older = dict(self)
            self.clear()
        unknown = []
        for key in keys.difference(self):
            value = self.older.get(key)
            if value is None:
                unknown.append(key)
            else:
                self[key] = value
        return unknown


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each 64-bit key."""
    k = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    most = np.uint64(BLOOM_BITS - 1)
    return k & most, (k >> np.uint64(32)) & most


class IdFilter:
    """A filter of fixed size over a set of ids: never misses a member, may pass others.

    It only thins rows out before an exact join, so results don't depend on it; at any
    number of ids it takes ``BLOOM_BITS`` bits on the driver and in each task.
    """

    def __init__(self, ids: DataFrame) -> None:
        """``ids`` has one long column; nulls are left out."""
        name = ids.columns[0]

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                both = np.concatenate(_bits(keys))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((both >> np.uint64(6)).astype(np.int64)),
                        pa.array((np.uint64(1) << (both & np.uint64(63))).view(np.int64)),
                    ],
                    ["word", "bits"],
                )

        words = (
            ids.select(F.col(name).cast("long"))
            .mapInArrow(positions, "word long, bits long")
            .groupBy("word")
            .agg(F.bit_or("bits").alias("bits"))
            .toArrow()
        )
        table = np.zeros(BLOOM_BITS >> 6, dtype=np.uint64)
        at = words.column("word").to_numpy()
        table[at] = words.column("bits").to_numpy().view(np.uint64)
        self.shared = ids.sparkSession.sparkContext.broadcast(table)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether each id may be a member."""
        table = self.shared.value
        out = np.ones(len(keys), dtype=bool)
        for at in _bits(keys):
            out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def members(self, column: pa.Array) -> np.ndarray:
        """Whether each id may be a member; nulls certainly aren't."""
        known = np.asarray(column.is_valid())
        return self.passes(column.fill_null(0).to_numpy(zero_copy_only=False)) & known

    def split(self, rows: DataFrame, key: str, members: bool) -> DataFrame:
        """The rows that may be members, or those that certainly aren't; null ids certainly aren't."""

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maybe = self.members(batch.column(batch.schema.get_field_index(key)))
                yield batch.filter(pa.array(maybe if members else ~maybe))

        return rows.mapInArrow(keep, rows.schema)
