"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyweave.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(lower)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute_force(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    raw = Counter(bucket(f) for _, t in docs for f in features(t, longest)[0])
    aim = Counter(bucket(f) for t in target for f in features(t, longest)[0])
    s, t = sum(raw.values()), sum(aim.values())

    def gain(b):
        return math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))

    rows = []
    for i, text in docs:
        found, words = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(enough[: len(enough) * percent // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def check(spark, docs, target, longest=1, **settings):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    model = rs.learn(df, aim, longest, settings.get("buckets", 10_000))
    got = rs.resample(df, model, settings.get("percent", 10), settings.get("least", 20))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_force(docs, target, longest, **settings)


def texts(rng, count):
    words = ["the", "Of", "É", "été", "漢字", "x1", "2024", "don't", "a_b", "K", "ſ", "😀", "İ"] + [f"w{i}" for i in range(200)]
    gaps = [" ", "  ", "\n", ", ", "--", "\x7f", " "]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("longest", [1, 3])
def test_random_texts(spark, longest):
    rng = random.Random(2)
    docs = list(enumerate(texts(rng, 300)))
    check(spark, docs, texts(rng, 20), longest, buckets=997, percent=30, least=5)


def test_ties_repeats_nulls_and_long_texts(spark):
    docs = [(1, None), (2, ""), (None, "word " * 30), (None, None), (3, "b " * 100_000), (4, "x" * 100_000)]
    docs += [(5, "same words here " * 10)] * 40 + [(None, "word " * 30)]
    check(spark, docs, ["same words", None, ""], percent=50)


def test_empty_tables(spark, nasty, empty):
    check(spark, [(1, "a b")], [], least=1, percent=100)
    aim = spark.createDataFrame([("a b",)], "text string")
    assert rs.resample(empty, rs.learn(empty, aim)).collect() == []
    # clashing names are not read
    assert rs.resample(nasty, rs.learn(nasty, nasty)).count() == nasty.count()


def test_results_do_not_depend_on_the_dictionary():
    rng = random.Random(4)
    for words in ([], ["the", "w1"], ["the", "of", "É", "été", "漢字", "x1", *(f"w{i}" for i in range(100))]):
        scanner, plain = rs.Scanner(words), rs.Scanner([])
        for text in [*texts(rng, 60), "", "w1w1 w1  w1", "the the the"]:
            for longest in (1, 2, 4):
                found, count = scanner.buckets(text, longest, 10_000)
                wanted, n = features(text, longest)
                assert found.tolist() == [zlib.crc32(f.encode()) % 10_000 for f in wanted] and count == n
                assert plain.buckets(text, longest, 10_000)[0].tolist() == found.tolist()


def test_composed_crcs():
    rng = random.Random(9)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.choice((0, 1, 5, 300, 70_000)))) for _ in range(60)]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    joined = rs.Composer().join(first, second, np.array([len(b) for _, b in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("s"), "id")
    got = rs.ranked(rows, F.col("s").desc(), F.col("id").asc()).collect()
    wanted = {(s, i): n for n, (s, i) in enumerate(sorted(((i % 7, i) for i in range(5000)), key=lambda r: (-r[0], r[1])), 1)}
    assert {(r["s"], r["id"]): r["rank"] for r in got} == wanted
