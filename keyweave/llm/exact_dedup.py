"""Exact deduplication by a Golomb-coded exchange of fingerprints.

Each scan task (a sender) sorts the distinct 64-bit fingerprints of its texts and sends every
owner its range as one Golomb-Rice coded message. Owners decode the messages of all senders,
find fingerprints held by more than one text (rows without an id send theirs too) and answer each message with a bitmap. Senders
read the bitmaps against their own sorted lists and so learn which of their documents are
suspects. Only suspects are shuffled with their texts, grouped by the text itself, so
that equality is decided on bytes.

Definitions: a null text counts as empty; of equal texts the row with the largest doc_id
stays (a null doc_id is the smallest, and stays only among nulls); of repeated rows of one
doc_id ``groups`` reports each as a member and ``deduplicate`` keeps one. An empty table gives
an empty result. Further columns are carried by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import IdFilter, cut_lineage, partitions, in_slices, texts_of

KEYS_PER_SENDER_MESSAGE = 1 << 20


def golomb_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted unsigned 64-bit values: count, shift, then the gaps.

    A gap is its quotient by 2**shift in unary (ones and a zero) and its remainder in
    ``shift`` bits. The shift is the bit length of the mean gap, so quotients are short.
    """
    n = len(values)
    head = np.array([n], dtype="<u4").tobytes()
    if n == 0:
        return head
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // n
    shift = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    rests = gaps & np.uint64((1 << shift) - 1)
    lengths = quotients + 1
    ends = np.cumsum(lengths)
    unary = np.ones(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 0
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    binary = ((rests[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    head += np.array([shift, len(unary)], dtype="<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(binary).tobytes()


def golomb_decode(message: bytes) -> np.ndarray:
    n = int(np.frombuffer(message, "<u4", 1)[0])
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    shift, unary_bits = (int(x) for x in np.frombuffer(message, "<u4", 2, 4))
    unary_bytes = (unary_bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(message, np.uint8, unary_bytes, 12), count=unary_bits)
    quotients = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    rests = np.zeros(n, dtype=np.uint64)
    if shift:
        binary = np.unpackbits(
            np.frombuffer(message, np.uint8, -1, 12 + unary_bytes), count=n * shift
        ).reshape(n, shift)
        for place in range(shift):
            rests = (rests << np.uint64(1)) | binary[:, place].astype(np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(shift)) | rests, dtype=np.uint64)


def _senders(owners: int):
    """Tasks that turn their rows into one coded message for each owner, with their own ids kept."""
    width = (1 << 64) // owners + 1

    def messages(keys: np.ndarray, ids: np.ndarray, known: np.ndarray, part: int) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, ids, known = keys[order], ids[order], known[order]
        distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
        bounds = [min(o * width, (1 << 64) - 1) for o in range(owners + 1)]
        cuts = np.searchsorted(distinct, np.array(bounds, dtype=np.uint64), side="left")
        cuts[-1] = len(distinct)
        ends = np.append(first, len(keys))
        rows = []
        for owner in np.flatnonzero(np.diff(cuts)).tolist():
            low, high = cuts[owner], cuts[owner + 1]
            rows.append(
                (
                    (TaskContext.get().partitionId() << 20) + part,
                    owner,
                    golomb_encode(distinct[low:high] - np.uint64(bounds[owner])),
                    np.packbits(counts[low:high] > 1).tobytes(),
                    counts[low:high].astype("<u4").tobytes(),
                    ids[ends[low] : ends[high]].astype("<i8").tobytes(),
                    None if known[ends[low] : ends[high]].all() else np.packbits(known[ends[low] : ends[high]]).tobytes(),
                )
            )
        names = ["sender", "owner", "message", "repeated", "counts", "ids", "known"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], names
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        held = part = 0
        for batch in in_slices(batches):
            texts = texts_of(batch.column(1))
            keys.append(np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)))
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            known.append(np.asarray(batch.column(0).is_valid(), dtype=bool))
            held += len(texts)
            if held >= KEYS_PER_SENDER_MESSAGE:
                yield messages(np.concatenate(keys), np.concatenate(ids), np.concatenate(known), part)
                keys, ids, known, held, part = [], [], [], 0, part + 1
        if held:
            yield messages(np.concatenate(keys), np.concatenate(ids), np.concatenate(known), part)

    return send


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each message, which of its fingerprints anyone else holds too."""
    lists = [golomb_decode(m) for m in group["message"]]
    repeated = [
        np.unpackbits(np.frombuffer(r, np.uint8), count=len(keys)).astype(bool)
        for r, keys in zip(group["repeated"], lists)
    ]
    distinct, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = distinct[counts > 1]
    maps = []
    for keys, again in zip(lists, repeated):
        at = np.searchsorted(shared, keys)
        found = np.zeros(len(keys), dtype=bool)
        inside = at < len(shared)
        found[inside] = shared[at[inside]] == keys[inside]
        maps.append(np.packbits(found | again).tobytes())
    return pd.DataFrame({"sender": group["sender"], "owner": group["owner"], "bitmap": maps})


def _suspect_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sender reads the bitmaps against its own sorted list."""
    for batch in batches:
        for counts, ids, known, bitmap in zip(*(batch.column(i).to_pylist() for i in range(4))):
            sizes = np.frombuffer(counts, "<u4").astype(np.int64)
            marked = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(sizes)).astype(bool)
            rows = np.repeat(marked, sizes)
            if known is not None:  # rows without an id are grouped anyway
                rows &= np.unpackbits(np.frombuffer(known, np.uint8), count=len(rows)).astype(bool)
            found = np.frombuffer(ids, "<i8")[rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(found), pa.int64())], ["suspect_id"])


def suspects(rows: DataFrame, owners: int | None = None) -> DataFrame:
    """Ids (column ``suspect_id``) of the documents whose fingerprint another row has too, be it without an id.

    ``rows`` has the columns ``doc_id`` and ``text``.
    """
    owners = owners or partitions(rows.sparkSession)
    sent = cut_lineage(
        rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _senders(owners),
            "sender long, owner int, message binary, repeated binary, counts binary, ids binary, known binary",
        )
    )
    answers = (
        sent.select("sender", "owner", "message", "repeated")
        .groupBy("owner")
        .applyInPandas(_answer, "sender long, owner int, bitmap binary")
    )
    return cut_lineage(
        sent.join(answers, ["sender", "owner"])
        .select("counts", "ids", "known", "bitmap")
        .mapInArrow(_suspect_ids, "suspect_id long")
    )


def _suspect_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with a suspect id or none at all."""
    maybe = IdFilter(ids).split(docs, "doc_id", members=True)
    marked = ids.select("suspect_id").distinct()
    return maybe.join(marked, maybe["doc_id"] == marked["suspect_id"], "left_semi").unionByName(
        docs.filter(F.col("doc_id").isNull())
    )


def verified(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Groups of suspects with byte-equal texts: sha256, variant text where needed, keep_id, size.

    Suspects are grouped by their text, with partial sums in each task before the shuffle, so
    a text that a third of all rows hold is a few rows here. ``variant`` is null where
    the digest has one text only, else the text.
    """
    grouped = (
        _suspect_rows(rows, ids)
        .groupBy(F.sha2("text", 256).alias("digest"), "text")
        .agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
    )
    grouped = cut_lineage(grouped.filter(F.col("size") > 1))
    clashes = grouped.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    return grouped.join(clashes, "digest").select(
        "digest", "keep", "size", F.when(F.col("texts") > 1, F.col("text")).alias("variant")
    )


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Every row of a doc_id that stays is ``kept``.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    known = verified(rows, suspects(rows))
    several = known.filter(F.col("variant").isNotNull())
    digests = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    if several.isEmpty():
        joined = digests.join(known, digests["text_sha256"] == known["digest"], "left")
    else:  # texts with one digest in common: compare the texts too
        digests = rows.withColumn("text_sha256", F.sha2("text", 256))
        joined = digests.join(
            known,
            (digests["text_sha256"] == known["digest"])
            & (known["variant"].isNull() | (known["variant"] == digests["text"])),
            "left",
        )
    keep = F.when(F.col("digest").isNotNull(), F.col("keep")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without the copies: of each group of equal texts one whole row stays."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ids = suspects(rows)
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    filtered = IdFilter(ids)
    clean = filtered.split(whole, "doc_id", members=False).filter(F.col("doc_id").isNotNull())
    maybe = filtered.split(whole, "doc_id", members=True)
    marked = ids.distinct()
    passed = maybe.join(marked, maybe["doc_id"] == marked["suspect_id"], "left_anti")
    caught = maybe.join(marked, maybe["doc_id"] == marked["suspect_id"], "left_semi").unionByName(
        whole.filter(F.col("doc_id").isNull())
    )
    # the text is grouped as it is; the row that stays is picked while rows are read
    text = F.coalesce(F.col("row").getField("text").cast("string"), F.lit(""))
    kept = caught.groupBy(text.alias("text")).agg(F.max_by("row", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("row"))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return (
        clean.select(*columns).unionByName(passed.select(*columns)).unionByName(kept.select(*columns))
    )
