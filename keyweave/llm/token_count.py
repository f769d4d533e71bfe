"""Token counts from a lazily compiled finite-state transducer.

The byte-level BPE of a word is read from left to right by a deterministic transducer. Its state
holds the longest suffix of the bytes read that begins some token, and for each place in it
the last token of the prefix ending there with its count relative to the present one. A
transition appends the one token that ends at the new byte and may stand after the last token
of the prefix before it (two tokens may be neighbours if contracting their bytes gives just these
two), and is annotated with the change of the count. Transitions are compiled when first
taken and kept, so words run at a dictionary step per byte.

Texts are read in chunks. A chunk's map is (head, count, tail): the counts of its inner segments do not
depend on the state it is entered in, since no token spans the boundary of a segment; head and tail
are the open ends. Maps compose associatively, so chunks are combined pairwise in a tree.

Definitions: a null text counts as empty: 0 bytes, 0 tokens; null doc_ids and repeated rows are kept as
they are; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import Recent, segments, texts_of

CHUNK = 1 << 14
CACHED_SEGMENTS = 600_000
CACHED_LENGTH = 64
MOST_STATES = 300_000
NEVER = 1 << 60

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class State:
    """Where a word's prefix stands; ``next`` maps a byte to (state, change of the count)."""

    __slots__ = ("suffix", "lasts", "counts", "next")

    def __init__(self, suffix: bytes, lasts: tuple, counts: tuple) -> None:
        self.suffix, self.lasts, self.counts = suffix, lasts, counts
        self.next: dict[int, tuple[State, int]] = {}


class Transducer:
    """Counts the tokens of words; compiled from a vocabulary and its merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]], single: set[bytes]) -> None:
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {t: t for t in single} | {a + b: a + b for a, b in merges}
        self.prefixes = {token[:n] for token in self.tokens for n in range(1, len(token) + 1)}
        self.born = {a + b: i for i, (a, b) in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        self.lefts: dict[bytes, list] = {}
        self.rights: dict[bytes, list] = {}
        self.neighbours: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(b"", (None,), (0,))
        self.states = {(b"", (None,), (0,)): self.start}

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The parts at an end of a token while it is contracted: part, rank of birth, rank of end."""
        found, ends = [], NEVER
        while True:
            born = self.born.get(token, -1)
            found.append((token, born, ends))
            if born < 0:
                return found
            token, ends = self.parts[token][side], born

    def may_follow(self, last: bytes, token: bytes) -> bool:
        """Whether contracting the bytes of both gives just these two tokens.

        It does unless a part at the end of ``last`` and one at the start of ``token`` stand
        there together when their own pair's turn comes; of equal ranks the leftmost goes first.
        """
        pair = (last, token)
        known = self.neighbours.get(pair)
        if known is None:
            if len(self.neighbours) > MOST_STATES:
                self.neighbours.clear()
            rights, lefts = self.rights.get(last), self.lefts.get(token)
            if rights is None:
                rights = self.rights[last] = self.spine(last, 1)
            if lefts is None:
                lefts = self.lefts[token] = self.spine(token, 0)
            known = True
            for x, born_x, end_x in rights:
                for y, born_y, end_y in lefts:
                    turn = self.rank.get((x, y))
                    if turn is not None and max(born_x, born_y) < turn < end_x and turn <= end_y:
                        known = False
            self.neighbours[pair] = known
        return known

    def compile(self, state: State, byte: int) -> tuple[State, int]:
        read = state.suffix + bytes([byte])
        for length in range(len(read), 0, -1):
            token = self.tokens.get(read[-length:])
            if token is not None:
                last = state.lasts[-length]
                if last is None or self.may_follow(last, token):
                    break
        change = state.counts[-length] + 1
        # only places where a token may still begin are remembered
        begins = [n for n in range(len(read), 0, -1) if read[-n:] in self.prefixes]
        keep = begins[0] if begins else 0
        history = (*state.lasts, token)
        numbers = (*state.counts, change)
        lasts, counts = [...] * (keep + 1), [0] * (keep + 1)
        for n in (*begins, 0):
            lasts[keep - n], counts[keep - n] = history[-n - 1], numbers[-n - 1] - change
        lasts, counts = tuple(lasts), tuple(counts)
        suffix = read[len(read) - keep :]
        key = (suffix, lasts, counts)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(suffix, lasts, counts)
        state.next[byte] = (target, change)
        return target, change

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        state, total = self.start, 0
        for byte in word:
            step = state.next.get(byte)
            state, change = step if step is not None else self.compile(state, byte)
            total += change
        return total


class Counter(Recent):
    """Token counts of segments; a segment is split into words and run when first met."""

    def __init__(self, transducer: Transducer, pattern: str, special: list[str]) -> None:
        super().__init__(CACHED_SEGMENTS)
        self.transducer = transducer
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, segment: str) -> int:
        n = self.older.get(segment)
        if n is None:
            n = sum(self.transducer.count(word.encode()) for word in self.pattern.findall(segment))
        if len(segment) <= CACHED_LENGTH:
            self.keep(segment, n)
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); the count is None where the chunk has no boundary inside: all is head."""
        parts = segments(chunk)
        if len(parts) < 2:
            return chunk, None, ""
        return parts[0], sum(map(self.__getitem__, parts[1:-1])), parts[-1]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]):
        if a[1] is None and b[1] is None:
            return self.joined(a[0] + b[0])
        if a[1] is None:
            head = segments(a[0] + b[0])
            return head[0], b[1] + sum(map(self.__getitem__, head[1:])), b[2]
        if b[1] is None:
            tail = segments(a[2] + b[0])
            return a[0], a[1] + sum(map(self.__getitem__, tail[:-1])), tail[-1]
        middle = sum(map(self.__getitem__, segments(a[2] + b[0])))
        return a[0], a[1] + middle + b[1], b[2]

    def joined(self, text: str) -> tuple[str, int | None, str]:
        """The map of two chunks without a boundary inside; there may be one between them."""
        parts = segments(text)
        return (text, None, "") if len(parts) < 2 else (parts[0], 0, parts[-1])

    def count_piece(self, text: str) -> int:
        if len(text) <= CHUNK:
            return sum(map(self.__getitem__, segments(text)))
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[2 * len(pairs) :]
        head, count, tail = maps[0]
        if count is None:
            return sum(map(self.__getitem__, segments(head)))
        return self[head] + count + self[tail]

    def count_text(self, text: str) -> int:
        """Special strings count one and end the piece before them."""
        if self.special is None or not (found := self.special.findall(text)):
            return self.count_piece(text)
        return len(found) + sum(map(self.count_piece, self.special.split(text)))


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    """The counter of this worker process, for a byte-level vocabulary file."""
    if (path, pattern) not in _COUNTERS:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        spelled = lambda s: bytes(map(letters.__getitem__, s))
        merges = [
            tuple(map(spelled, m if isinstance(m, list) else m.split(" "))) for m in model["model"]["merges"]
        ]
        special = [t["content"] for t in model["added_tokens"]]
        single = {bytes([b]) for b in range(256)}
        _COUNTERS[path, pattern] = Counter(Transducer(merges, single), pattern, special)
    return _COUNTERS[path, pattern]


def _tasks(path: str, pattern: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            counts = pa.array(map(own.count_text, texts_of(batch.column("text"))), pa.int64())
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes.cast(pa.int64()), counts, pc.greater(counts, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """Tokens of every text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_tasks(path, pattern, limit), RESULT)
