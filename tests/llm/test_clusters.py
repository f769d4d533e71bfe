"""Centroid clustering against measuring every vector against every centroid."""

import hashlib
import math

import numpy as np
import pytest

from keyweave.llm import centroid_clustering as cc


def brute_force(rows, clusters, rounds, dimensions, scale=256, seed=2):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    whole = [tuple(math.floor(scale * x) for x in v) for _, v in kept]
    keys = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, n) for n, (i, v) in enumerate(kept) if i is not None)
    centroids = [whole[n] for *_, n in keys[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for v in whole:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            centroids[k] = tuple(sum(x) // len(members) for x in zip(*members))
    found = [nearest(v) for v in whole]
    total = sum(d for d, _ in found)
    return sorted(
        (
            -1 if i is None else i, k, d, sum(e for e, m in found if m == k), total,
            hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest(),
        )
        for (i, _), (d, k) in zip(kept, found)
    )


def check(spark, rows, clusters, rounds, dimensions):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = cc.cluster(df, clusters, rounds, dimensions).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_force(rows, clusters, rounds, dimensions)


@pytest.mark.parametrize("clusters,dimensions,spread", [(5, 3, 1.0), (12, 8, 0.02), (40, 64, 0.3)])
def test_random_vectors(spark, clusters, dimensions, spread):
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(300, dimensions)) * spread).tolist())]
    check(spark, rows, clusters, 3, dimensions)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] * 2  # many equal vectors and distances
    rows += [(None, [0.5, 0.5]), (None, [1.5, 1.0]), (50, None), (51, []), (52, [1.0]), (53, [1.0, None])]
    rows += [(54, [1.0, float("nan")]), (55, [float("-inf"), 0.0]), (56, [-1e5, 1e5]), (7, [0.5, 1.0])]
    check(spark, rows, 6, 4, 2)


def test_fewer_rows_than_clusters_and_none(spark):
    check(spark, [(1, [0.0, 0.0]), (2, [0.0, 1.0])], 40, 2, 2)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, cluster string, distance string")
    assert cc.cluster(empty, dimensions=2).collect() == []
    only_null = spark.createDataFrame([(None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert cc.cluster(only_null, dimensions=2).collect() == []


def test_clashing_columns(spark):
    rows = [(i, [float(i), 0.0], "x", i, None) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v long, inertia string")
    assert cc.cluster(df, 3, 2, 2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_search_stops_early_and_goes_on_at_equality():
    # two well separated groups of centroids: most are never measured
    centroids = np.array([[i, i, i] for i in range(20)] + [[10_000 + i] * 3 for i in range(20)], dtype=np.int64)
    search = cc.ThresholdSearch(centroids)
    which, distance = search.nearest(np.array([[3, 3, 3], [10_007, 10_007, 10_007]], dtype=np.int64))
    assert which.tolist() == [3, 27] and distance.tolist() == [0, 0]
    assert search.measured < 20
    # equal distance, smaller number met later
    tied = cc.ThresholdSearch(np.array([[2, 2], [0, 0]], dtype=np.int64))
    assert tied.nearest(np.array([[1, 1]], dtype=np.int64))[0].tolist() == [0]


def test_large_components_are_clamped(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in cc.assign(df, np.array([[0, 0]]), 2).collect()}
    assert rows[1]["distance"] == rows[2]["distance"] == cc.MOST_COMPONENT**2
