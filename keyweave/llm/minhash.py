"""Near duplicates by weighted MinHash of word shingles: BagMinHash signatures, bands, verification.

A document is the multiset of its shingles of ``SHINGLE`` words. The signature has one value for each of
``COMPONENTS``: the first arrival among Poisson processes of the multiset's units. The weight axis is cut
into dyadic blocks [0,1), [1,2), [2,4), ...; each shingle and block has one process with the block's
width as its rate, whose points carry a component and a place on the weight axis, and count where the
place is below the shingle's multiplicity. So documents share the points of their common part, and
two components agree with the probability of the weighted Jaccard similarity. Points are drawn in order of
time up to a limit at which nearly all components are taken, all documents of a batch at once; documents with
a component left draw on to twice the limit.

Documents with the same words are one. Signatures are cut into bands; a band's bucket is compared with its
least member, and verified pairs (overlap of the multisets of at least ``SIMILARITY``) link documents.
Where that leaves several components in a bucket, members that may still be near another one (by the
shingles they don't have for themselves) are compared with the most central of them, and those
still apart with each other. So no pair of a bucket is lost that could join two components.

Definitions: words are runs of letters, digits and underscores in lower case; a null text counts as empty; a text
of fewer words than a shingle is one shingle, and texts without words are copies of each other only if
equal; rows without a doc_id have no class and stay; rows of one doc_id share a class and count as one; those of
the least doc_id of a class stay; an empty table gives an empty result. ``deduplicate`` carries all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import IdFilter, Recent, cut_lineage, fresh, slices, texts_of
from keyweave.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
COMPONENTS = BANDS * ROWS
BYTES_PER_STEP = 1 << 19
PAIRS_PER_STEP = 500
CENTRAL_ROUNDS = 2
CACHED_WORDS = 75_000

WORD = re.compile(r"\w+")

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], np.uint64
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(Recent):
    def __init__(self) -> None:
        super().__init__(CACHED_WORDS)

    def __missing__(self, word: str) -> int:
        value = self.older.get(word)
        if value is None:
            value = xxhash.xxh3_64_intdigest(word)
        self.keep(word, value)
        return value


def shingles(texts: list[str], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text (by place) and hash of each shingle, sorted by both, and a digest of each text's words."""
    arrays, digests = [], []
    for text in texts:
        words = WORD.findall(text.lower())
        array = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        digests.append(xxhash.xxh3_128_digest(array.tobytes() if words else b"\0" + text.encode()))
        if 0 < len(words) < SHINGLE:  # one shingle, apart from any of full length
            array = np.concatenate([array, np.full(SHINGLE - len(words), len(words), np.uint64)])
        arrays.append(array)
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    words = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    count = max(0, len(words) - SHINGLE + 1)
    mixed = np.zeros(count, np.uint64)
    for place in range(SHINGLE):
        mixed += _mix(words[place : place + count] + _FACTORS[place]) * _FACTORS[place]
    inside = owner[:count] == owner[SHINGLE - 1 :] if count else np.zeros(0, bool)
    owner, mixed = owner[:count][inside], _mix(mixed[inside])
    order = np.lexsort((mixed, owner))
    return owner[order], mixed[order], digests


def _units(owner: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Processes of the multisets: text, seed, width and lower end of the block, multiplicity."""
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    starts = np.flatnonzero(new)
    weights = np.diff(starts, append=len(hashed)).astype(np.float64)
    owner, hashed = owner[starts], hashed[starts]
    parts = [(owner, hashed, np.ones(len(owner)), np.zeros(len(owner)), weights)]
    low, block = 1.0, 1
    while (more := weights > low).any():
        owner, hashed, weights = owner[more], hashed[more], weights[more]
        seed = _mix(hashed + np.uint64(block * 0x9E3779B97F4A7C15 % (1 << 64)))
        parts.append((owner, seed, np.full(len(owner), low), np.full(len(owner), low), weights))
        low, block = 2 * low, block + 1
    return tuple(np.concatenate(p) for p in zip(*parts))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(owner: np.ndarray, hashed: np.ndarray, texts: int) -> np.ndarray:
    """First arrival times, one row for each text; infinite for texts without shingles."""
    out = np.full(texts * COMPONENTS, np.inf)
    if len(hashed) == 0:
        return out.reshape(texts, COMPONENTS)
    all_units = _units(owner, hashed)
    total = np.bincount(all_units[0], all_units[2], texts)
    limit = COMPONENTS * (np.log(COMPONENTS) + 4) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        text, seed, width, low, weight = (u[todo[all_units[0]]] for u in all_units)
        time = np.zeros(len(text))
        draw = 0
        while len(text):
            draw += 1
            point = _mix(seed + np.uint64(draw * 0xD6E8FEB86659FD93 % (1 << 64)))
            time = time - np.log(_uniform(point)) / width
            due = time <= limit[text]
            text, seed, width, low, weight, time, point = (
                a[due] for a in (text, seed, width, low, weight, time, point)
            )
            other = _mix(point)
            counts = low + _uniform(other) * width < weight
            slot = text[counts] * COMPONENTS + (_mix(other[counts]) % np.uint64(COMPONENTS)).astype(np.int64)
            np.minimum.at(out, slot, time[counts])
        todo &= np.isinf(out.reshape(texts, COMPONENTS)).any(axis=1)
        limit = 2 * limit
    return out.reshape(texts, COMPONENTS)


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    bits = signed.view(np.uint64).reshape(len(signed), BANDS, ROWS)
    keys = np.zeros((len(signed), BANDS), dtype=np.uint64)
    for row in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, row])
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in fresh(batches):
        for part in slices(batch, "text", BYTES_PER_STEP):
            owner, hashed, digests = shingles(texts_of(part.column("text")), hashes)
            keys = band_keys(signatures(owner, hashed, part.num_rows))
            sizes = np.bincount(owner, minlength=part.num_rows)
            ends = pa.array(np.arange(0, (part.num_rows + 1) * BANDS, BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
                ],
                ["doc_id", "digest", "size", "keys"],
            )


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for batch in fresh(batches):
        for part in slices(batch, "text", BYTES_PER_STEP):
            owner, hashed, _ = shingles(texts_of(part.column("text")), hashes)
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
            blobs = [hashed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(blobs, pa.binary())], ["profile_id", "profile"]
            )


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if len(a) == 0 or len(b) == 0:
        return 0.0
    values = np.concatenate([a, b])
    order = np.argsort(values, kind="stable")  # of equal values those of a come first
    values, second = values[order], order >= len(a)
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    of_b = np.add.reduceat(second.astype(np.int64), starts)
    common = int(np.minimum(of_b, np.diff(starts, append=len(values)) - of_b).sum())
    return common / (len(values) - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def profile(value: pa.Scalar) -> np.ndarray:
        return np.frombuffer(value.as_buffer(), np.uint64)  # no copy: hubs stand in many pairs

    for batch in fresh(batches):
        for low in range(0, batch.num_rows, PAIRS_PER_STEP):
            part = batch.slice(low, PAIRS_PER_STEP)
            found = [overlap(profile(x), profile(y)) for x, y in zip(part.column("profile_a"), part.column("profile_b"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"]
            )


def _measured(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity of each pair of document ids."""
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    rows = IdFilter(ids).split(docs, "doc_id", members=True)
    profiles = cut_lineage(
        rows.join(ids, rows["doc_id"] == ids["id"], "left_semi")
        .select("doc_id", "text")
        .mapInArrow(_profiles, "profile_id long, profile binary")
        .dropDuplicates(["profile_id"])
    )
    first = profiles.select(F.col("profile_id").alias("a"), F.col("profile").alias("profile_a"))
    second = profiles.select(F.col("profile_id").alias("b"), F.col("profile").alias("profile_b"))
    return cut_lineage(
        pairs.select("a", "b")
        .join(first, "a")
        .join(second, "b")
        .select("a", "b", "profile_a", "profile_b")
        .mapInArrow(_verified, "a long, b long, similarity double")
    )


def _alike(size_a: str, size_b: str):
    """Sizes at which the similarity can be reached."""
    return F.least(size_a, size_b) >= F.lit(SIMILARITY - 1e-12) * F.greatest(size_a, size_b)


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Verified links (a, b) between documents of different words that join all near duplicates."""
    least = signed.filter("size > 0").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys")
    )
    members = cut_lineage(least.select("id", "size", F.posexplode("keys").alias("band", "key")))
    buckets = members.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n"))
    shared = cut_lineage(
        members.join(buckets.filter("n > 1"), ["band", "key"]).select("band", "key", "id", "size", "hub")
    )
    sizes = shared.select(F.col("id").alias("hub"), F.col("size").alias("hub_size")).distinct()
    pairs = (
        shared.filter("id <> hub")
        .select(F.col("id").alias("a"), F.col("hub").alias("b"), "size")
        .distinct()
        .join(sizes.withColumnRenamed("hub", "b"), "b")
    )
    near = _measured(docs, pairs.filter(_alike("size", "hub_size")))
    linked = near.filter(F.col("similarity") >= SIMILARITY).select("a", "b")
    placed = _unsettled(shared.drop("hub"), linked)
    if placed.isEmpty():
        return linked
    # What a document has in common with another one is at most its shingles that any other document of
    # these buckets has. Heavily edited copies are mostly shingles of their own and drop out by this bound.
    common = _common_sizes(docs, placed.select("id").distinct())
    able = placed.join(common, "id").filter(F.col("common") >= F.lit(SIMILARITY - 1e-12) * F.col("size"))
    able = cut_lineage(able.select("band", "key", "id", "size", "common"))
    tried = near.select("a", "b")
    rest, used = able, None
    for _ in range(CENTRAL_ROUNDS):
        # the member with the least of its own is the likeliest to link all others
        free = rest if used is None else rest.join(used, ["band", "key", "id"], "left_anti")
        central = free.groupBy("band", "key").agg(F.max(F.struct(F.col("common") / F.col("size"), -F.col("id"))).alias("best"))
        hubs = cut_lineage(central.select("band", "key", (-F.col("best.col2")).alias("id")))
        used = hubs if used is None else used.unionByName(hubs)
        found = _measured(docs, _pairs(rest, hubs, linked, tried))
        linked = cut_lineage(linked.unionByName(found.filter(F.col("similarity") >= SIMILARITY).select("a", "b")))
        tried = cut_lineage(tried.unionByName(found.select("a", "b")))
        rest = _unsettled(rest, linked)
        if rest.isEmpty():
            return linked
    # whatever is still apart is compared with each other
    last = _measured(docs, _pairs(rest, rest, linked, tried, members.groupBy("id").agg(_ordered_keys())))
    return linked.unionByName(last.filter(F.col("similarity") >= SIMILARITY).select("a", "b"))


def _ordered_keys():
    """The band keys of a document in order of the bands."""
    return F.transform(F.array_sort(F.collect_list(F.struct("band", "key"))), lambda b: b["key"]).alias("keys")


def _grouped(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members with the label of their component so far."""
    labels = components(linked).select(F.col("id"), F.col("label"))
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _unsettled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components."""
    placed = cut_lineage(_grouped(members, linked))
    mixed = placed.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    kept = placed.join(mixed.filter("low < high").select("band", "key"), ["band", "key"], "left_semi")
    return cut_lineage(kept.drop("label"))


def _pairs(
    left: DataFrame, right: DataFrame, linked: DataFrame, tried: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different components that the bounds leave possible.

    With the ``keys`` of the documents a pair comes from the first band alone in which they agree.
    """
    columns = ("id", "size", "common", "label", *(["keys"] if keys is not None else []))
    grouped = _grouped(left, linked)
    grouped = cut_lineage(grouped if keys is None else grouped.join(keys, "id"))
    one = grouped.select("band", "key", *(F.col(c).alias(f"{c}_a") for c in columns))
    other = right.select("band", "key", "id").join(grouped, ["band", "key", "id"])
    other = other.select("band", "key", *(F.col(c).alias(f"{c}_b") for c in columns))
    needed = (F.col("size_a") + F.col("size_b")) * F.lit(SIMILARITY / (1 + SIMILARITY) - 1e-12)
    possible = (
        (one["band"] == other["band"])
        & (one["key"] == other["key"])
        & (F.col("label_a") != F.col("label_b"))
        & (F.least("common_a", "common_b") >= needed)
    )
    if keys is not None:
        agree = F.zip_with("keys_a", "keys_b", lambda x, y: x == y)
        possible &= (F.col("id_a") < F.col("id_b")) & (F.array_position(agree, True) == one["band"] + 1)
    return cut_lineage(
        one.join(other, possible)
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .distinct()
        .join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti")
    )


def _common_sizes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, common: how many shingles of a document another one of these documents has as well."""
    rows = IdFilter(ids).split(docs, "doc_id", members=True)
    counted = cut_lineage(
        rows.join(ids, rows["doc_id"] == ids["id"], "left_semi")
        .select("doc_id", "text")
        .mapInArrow(_multiplicities, "id long, shingle long, times long")
    )
    several = counted.groupBy("shingle").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    return cut_lineage(
        counted.join(several.select("shingle"), "shingle", "left_semi").groupBy("id").agg(F.sum("times").alias("common"))
    )


def _multiplicities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each document and how often it has them."""
    hashes = WordHash()
    for batch in fresh(batches):
        for part in slices(batch, "text", BYTES_PER_STEP):
            owner, hashed, _ = shingles(texts_of(part.column("text")), hashes)
            if len(hashed) == 0:
                continue
            starts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[owner[starts]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(hashed[starts].view(np.int64)),
                    pa.array(np.diff(starts, append=len(hashed)).astype(np.int64)),
                ],
                ["id", "shingle", "times"],
            )


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size, kept."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    signed = cut_lineage(
        rows.filter(F.col("doc_id").isNotNull()).mapInArrow(
            _signed, "doc_id long, digest binary, size long, keys array<long>"
        )
    )
    found = components(links(rows, signed))
    # copies share a document's class; a document may have rows of several texts
    firsts = signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    several = firsts.filter("copies > 1")
    copies = signed.select("doc_id", "digest").join(several, "digest").select(
        F.col("doc_id").alias("a"), F.col("first").alias("b")
    )
    label = cut_lineage(
        components(copies.unionByName(found.select(F.col("id").alias("a"), F.col("label").alias("b"))))
    )
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"))
    known = label.join(sizes, "label")
    return rows.select("doc_id").join(known, rows["doc_id"] == known["id"], "left").select(
        "doc_id",
        F.coalesce("label", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("label", "doc_id")).alias("kept"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each class, with all their columns."""
    dropped = cut_lineage(classes(docs).filter("not kept").select(F.col("doc_id").alias("dropped_id")))
    found = IdFilter(dropped)
    key = "doc_id"
    clear = found.split(docs, key, members=False)
    maybe = found.split(docs, key, members=True)
    marked = dropped.distinct()
    return clear.unionByName(
        maybe.join(marked, maybe[key].cast("long") == marked["dropped_id"], "left_anti").select(*docs.columns)
    )
