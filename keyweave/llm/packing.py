"""Packing documents into sequences by fitted length patterns.

Tasks turn documents into pieces of at most ``capacity`` tokens and number the pieces of each
length. Only the histogram of lengths, at most ``capacity`` counts, reaches the driver. There few-document
patterns (lengths that fill a sequence) are enumerated, their repeat counts are fitted to the histogram
by non-negative least squares and rounded, and what is left over is packed best fit, longest
first, on counts. The result is a list of runs: "ranks r to r+n of length l go to sequences s to
s+n at offset o". Tasks look their pieces up in it, so no task needs another's documents.

Definitions: a null text counts as empty and has the end token alone; repeated rows are packed each;
a null doc_id is kept as null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm.common import WHITE, Recent, cut_lineage, fresh, held, slices, texts_of

CAPACITY = 2048
CACHED_WORDS = 100_000
CACHED_PARTS = 150_000
PARTS_AT_ONCE = 64
BYTES_PER_STEP = 1 << 20
FITTING_ROUNDS = 300
SECOND_CHOICES = 24

# No token of a tokenizer that drops white space spans it.
WORD = re.compile(f"[^{WHITE}]+")
# Texts of letters and marks that normalisation leaves alone, also in lower case, and the pattern of the
# tokenizer's file that splits lower case into parts, for these letters (fixed values).
PLAIN = re.compile("[\\t-\\r -\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e]*")
# What is not of letters is found by its first character; the rest stands between white space.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
NUMBER = "0-9²³¹¼½¾"
LETTER = "a-zA-ZªµºÀ-ÖØ-öø-\u02af\u2c65\u2c66"
NOT_LETTERS = re.compile(
    rf"[^{LETTER}{WHITE}](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<![{NUMBER}])[^{LETTER}{WHITE}{NUMBER}]*)?"
)


def parts_of(text: str) -> list[str]:
    """The matches of ``PART`` in a plain text."""
    return NOT_LETTERS.sub(r" \g<0> ", text).split()


Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


class WordIds(Recent):
    """Token ids of words, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        super().__init__(CACHED_WORDS)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts = Recent(CACHED_PARTS)
        # the same model for parts, which need neither normalising nor cutting
        self.of_parts = Tokenizer(self.tokenizer.model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        # tokens that end a part, which tell the parts of one text from each other
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ending = [i for token, i in self.tokenizer.get_vocab(False).items() if suffix and token.endswith(suffix)]
        self.ends = np.zeros(max(ending, default=0) + 2, dtype=bool)
        self.ends[ending] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part: many at a time as one text, as the tokenizer takes most of its time for each text."""
        out: list[bytes] = []
        groups = [parts[at : at + PARTS_AT_ONCE] for at in range(0, len(parts), PARTS_AT_ONCE)]
        coded = self.of_parts.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, code in zip(groups, coded):
            ids = np.array(code.ids, "<u4")
            cuts = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                joined, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out.extend([joined[low:high] for low, high in zip(cuts, cuts[1:])])
            else:
                out.extend(self.encode(group))
        return out

    def documents(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; parts and words not met lately are encoded together.

        A plain text is cut into parts in lower case, of which there are few; any other text into words.
        """
        cut: list[list[str]] = []
        parts: set[str] = set()
        words: set[str] = set()
        plain = [PLAIN.fullmatch(text) is not None and "<|" not in text for text in texts]
        for text, simple in zip(texts, plain):
            cut.append(parts_of(text.lower()) if simple else WORD.findall(text))
            (parts if simple else words).update(cut[-1])
        for known, found, encode in ((self.parts, parts, self.encode_parts), (self, words, self.encode)):
            unknown = known.recall(found)
            known.update(zip(unknown, encode(unknown)))
        return [b"".join(map((self.parts if s else self).__getitem__, c)) for c, s in zip(cut, plain)]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"packing:{path}"
        words = held(name, lambda: WordIds(path))
        end = np.array([end_id], dtype="<u4").tobytes()
        task, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for batch in fresh(batches, name):
            columns: list[list] = [[] for _ in range(6 + with_ids)]
            documents = (
                pair
                for part in slices(batch, "text", BYTES_PER_STEP)
                for pair in zip(part.column("doc_id").to_pylist(), words.documents(texts_of(part.column("text"))))
            )
            for doc_id, ids in documents:
                ids += end
                for number, low in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[low : low + 4 * capacity]
                    length = len(piece) // 4
                    row = (doc_id, number, low // 4, length, zlib.crc32(piece), ranks[length])
                    ranks[length] += 1
                    for column, value in zip(columns, row):
                        column.append(value)
                    if with_ids:
                        columns[6].append(np.frombuffer(piece, "<u4").astype(np.int32))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task_rank", "ids"]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            task_ids = pa.array(np.full(len(columns[0]), task), pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, task_ids], [*names[: len(arrays)], "task"])

    return run


def _patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns of few documents: every first length, several second ones, then the longest that fits."""
    found = set()
    for first in lengths:
        room = capacity - first
        fitting = bisect.bisect_right(lengths, min(room, first))
        picks = set(range(max(0, fitting - SECOND_CHOICES // 2), fitting))
        picks.update(np.linspace(0, fitting - 1, SECOND_CHOICES).astype(int).tolist() if fitting else [])
        for pick in picks:
            pattern, rest = [first, lengths[pick]], room - lengths[pick]
            while len(pattern) < 8 and (at := bisect.bisect_right(lengths, min(rest, pattern[-1]))):
                pattern.append(lengths[at - 1])
                rest -= lengths[at - 1]
            if rest <= capacity // 64:
                found.add(tuple(pattern))
    return sorted(found)


def _fit(patterns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Repeat counts of the patterns: non-negative least squares by multiplicative steps."""
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.fromiter((x for p in patterns for x in p), np.int64)
    target = histogram.astype(float)
    wanted = np.bincount(column, target[length], len(patterns))
    counts = np.full(len(patterns), target.sum() / max(1, len(length)))
    for _ in range(FITTING_ROUNDS):
        made = np.bincount(length, counts[column], len(histogram))
        counts *= wanted / np.maximum(np.bincount(column, made[length], len(patterns)), 1e-9)
    return counts


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs that place every piece, and the number of sequences. Lengths are 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros_like(left)  # ranks given out
    runs: list[Run] = []
    sequences = 0
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, count)

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), n, sequence, offset))
        used[length] += n
        left[length] -= n

    if left[capacity]:
        n = int(left[capacity])
        put(capacity, n, 0, 0)
        sequences = n
    lengths = np.flatnonzero(left).tolist()
    patterns = _patterns(lengths, capacity)
    if patterns:
        counts = _fit(patterns, left)
        for at in np.argsort(-counts, kind="stable").tolist():
            pattern = patterns[at]
            most = min(int(left[x]) // pattern.count(x) for x in pattern)
            n = min(int(counts[at] + 0.5), most)
            if n <= 0:
                continue
            offset = 0
            for length in pattern:
                put(length, n, sequences, offset)
                offset += length
            if offset < capacity:
                open_runs[capacity - offset].append((sequences, n))
            sequences += n
    rooms = sorted(open_runs)
    for length in np.flatnonzero(left)[::-1].tolist():
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):  # nothing has room: start sequences with as many as fit
                each = capacity // length
                n = max(1, int(left[length]) // each)
                each = min(each, int(left[length]))
                for i in range(each):
                    put(length, n, sequences, i * length)
                room, first = capacity - each * length, sequences
                sequences += n
            else:
                room = rooms[at]
                first, n = open_runs[room].pop()
                if (rest := n - int(left[length])) > 0:
                    n -= rest
                    open_runs[room].append((first + n, rest))
                if not open_runs[room]:
                    rooms.pop(at)
                put(length, n, first, capacity - room)
                room -= length
            if room:
                if not open_runs[room]:
                    bisect.insort(rooms, room)
                open_runs[room].append((first, n))
    return runs, sequences


def _places(runs: list[Run]) -> Callable:
    """Tasks that look up sequence and offset by length and rank."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fresh(batches):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(table[at, 4])],
                [*kept, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Documents end with ``end_id``; those of more than ``capacity`` tokens are cut into pieces of that
    length and a last shorter one.
    """
    own = "doc_id long, piece int, start long, length long, ids_crc32 long, task_rank long"
    ids = ", ids array<int>" if with_ids else ""
    pieces = cut_lineage(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _pieces(path, capacity, end_id, with_ids), f"{own}{ids}, task long"
        )
    )
    counts = cut_lineage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    # a piece's rank among those of its length: those of earlier tasks, and its rank in its own
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("first") + F.col("task_rank")).alias("rank"),
    )
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}"
    return ranked.mapInArrow(_places(runs), f"{schema}, sequence_id long, offset long")
