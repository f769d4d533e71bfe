"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

A text is cut into segments (white space and the characters up to the next white space), a
boundary no token spans. Each task encodes the distinct pretokens of the segments it has not seen
yet: token-position rows join the merge table, and a recursive query contracts every word's
leftmost minimum-rank pair until no pair of neighbours is a token. Decoding is an ordered
aggregation over the token positions of a word. Documents are then read off segment by
segment.

Definitions: a null text counts as empty and has no tokens; a null doc_id is kept as null;
repeated rows give repeated results; an empty table gives an empty result; further columns are
not read. A run without white space may be of any length: pretokens of more than ``LONG_WORD``
bytes are contracted by a heap instead of rows, as one contraction per round would take a round for
each of their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import Recent, segments, slices, texts_of

LONG_WORD = 96
WORDS_PER_QUERY = 50_000
CACHED_SEGMENTS = 600_000
BYTES_PER_STEP = 4 << 20

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Contract until fixpoint. Rows are token positions: k is the word's number times 128 plus the place of
# the token in the word. A step has the rows of the words that still had a pair of neighbours that is
# a token; at the place of the leftmost pair of least rank stands the merged token, the row after it
# goes and later rows move up. The last step of each word is decoded by ordered aggregation.
CONTRACT = """
with recursive state(step, k, tok) as (
    select 0, k, tok from start
    union all
    select s.step + 1,
           case when (s.k & 127) > (b.best & 127) then s.k - 1 else s.k end,
           case when (s.k & 127) = (b.best & 127) then b.best >> 7 else s.tok end
    from state s
    join (
        select a.k >> 7 as word, min(m.merged * 128 + (a.k & 127)) as best
        from state a
        join state n on n.k = a.k + 1
        join merges m on m.pair = a.tok * 65536 + n.tok
        group by a.k >> 7
    ) b on b.word = s.k >> 7
    where (s.k & 127) <> (b.best & 127) + 1
)
select s.k >> 7 as word,
       list(s.tok order by s.k) as ids,
       string_agg(t.bytes, '' order by s.k) as decoded
from state s
join (select k >> 7 as word, max(step) as step from state group by k >> 7) e
  on s.k >> 7 = e.word and s.step = e.step
join tokens t on t.tok = s.tok
group by s.k >> 7
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    """Encodes words with one DuckDB connection; ``words`` maps words to ids and decoded bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        pairs = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        known = pa.table(
            {
                "pair": pa.array([a * 65536 + b for a, b, _ in pairs], pa.int64()),
                "merged": pa.array([m for _, _, m in pairs], pa.int64()),
            }
        )
        self.db.register("given", known)
        self.db.execute("create table merges as select * from given")
        self.db.register(
            "spelled",
            pa.table(
                {
                    "tok": pa.array(list(ranks.values()), pa.int64()),
                    "bytes": [token.hex() for token in ranks],
                }
            ),
        )
        self.db.execute("create table tokens as select * from spelled")
        self.merges = {(a, b): m for a, b, m in pairs}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # ids of a segment, joined by spaces; only segments that their ids decode to get in
        self.cache = Recent(CACHED_SEGMENTS)

    def contract_long(self, word: bytes) -> list[int]:
        """The leftmost minimum-rank contraction of one long word, by a heap of pairs."""
        ids: list[int | None] = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        heap = [
            (self.merges[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in self.merges
        ]
        heapq.heapify(heap)
        while heap:
            merged, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else len(ids)
            if j >= len(ids) or self.merges.get((ids[i], ids[j])) != merged:
                continue  # one of the two has changed since
            ids[i], ids[j] = merged, None
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if 0 <= a and b < len(ids) and (ids[a], ids[b]) in self.merges:
                    heapq.heappush(heap, (self.merges[ids[a], ids[b]], a))
        return [t for t in ids if t is not None]

    def encode_words(self, words: list[str]) -> dict[str, tuple[str, bytes]]:
        """Ids joined by spaces and decoded bytes of each distinct word."""
        out: dict[str, tuple[str, bytes]] = {}
        rows: list[tuple[str, bytes]] = []
        for word in words:
            spelled = word.encode("utf-8")
            whole = self.ranks.get(spelled)
            if whole is not None:
                out[word] = (str(whole), self.bytes_of[whole])
            elif len(spelled) > LONG_WORD:
                ids = self.contract_long(spelled)
                decoded = b"".join(map(self.bytes_of.__getitem__, ids))
                out[word] = (" ".join(map(str, ids)), decoded)
            else:
                rows.append((word, spelled))
        for low in range(0, len(rows), WORDS_PER_QUERY):
            part = rows[low : low + WORDS_PER_QUERY]
            sizes = np.fromiter((len(spelled) for _, spelled in part), np.int64, len(part))
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            letters = np.frombuffer(b"".join(spelled for _, spelled in part), np.uint8)
            start = pa.table(
                {
                    "k": np.repeat(np.arange(len(part)), sizes) * 128 + place,
                    "tok": self.single[letters],
                }
            )
            self.db.register("start", start)
            for i, ids, decoded in self.db.execute(CONTRACT).fetchall():
                out[part[i][0]] = (" ".join(map(str, ids)), bytes.fromhex(decoded))
            self.db.unregister("start")
        return out

    def learn(self, new: list[str]) -> None:
        """Add segments to the cache."""
        pieces = [self.pattern.findall(segment) for segment in new]
        known = self.encode_words(list({word for words in pieces for word in words}))
        for segment, words in zip(new, pieces):
            parts = [known[word] for word in words]
            self.cache[segment] = " ".join(p[0] for p in parts)
            if b"".join(p[1] for p in parts) != segment.encode():
                raise ValueError(f"the vocabulary doesn't give back {segment!r}")

    def documents(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, digest of the ids and digest of the decoded bytes of each text."""
        cut = [segments(text) for text in texts]
        self.learn(self.cache.recall(set().union(*cut)))
        for parts in cut:
            ids = " ".join(map(self.cache.__getitem__, parts))
            decoded = "".join(parts).encode()  # what each segment's ids were decoded to
            yield (
                ids.count(" ") + (ids != ""),
                hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(decoded).hexdigest(),
            )


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _tasks(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", BYTES_PER_STEP):
                counts, ids, decoded = zip(*own.documents(texts_of(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(ids, pa.string()),
                        pa.array(decoded, pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_tasks(path, pattern), RESULT)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The ids themselves: doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", BYTES_PER_STEP):
                ids = []
                for text in texts_of(part.column("text")):
                    cut = segments(text)
                    own.learn(own.cache.recall(set(cut)))
                    ids.append([int(i) for s in cut for i in own.cache[s].split()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts from rows of doc_id, ids: doc_id, text. Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            rows = pa.table(
                {
                    "doc": pa.array(range(batch.num_rows), pa.int64()),
                    "ids": batch.column("ids"),
                }
            )
            own.db.register("coded", rows)
            texts = own.db.execute(
                """
                select string_agg(t.bytes, '' order by p.pos)
                from coded c
                left join (select doc, unnest(ids) as tok, generate_subscripts(ids, 1) as pos from coded) p
                  on p.doc = c.doc
                left join tokens t on t.tok = p.tok
                group by c.doc order by c.doc
                """
            ).fetchall()
            own.db.unregister("coded")
            decoded = [bytes.fromhex(h or "").decode("utf-8", "replace") for (h,) in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(decoded, pa.string())], ["doc_id", "text"]
            )

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
