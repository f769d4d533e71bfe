"""Centroid clustering: rounds of nearest-centroid assignment by the threshold algorithm.

Vectors are assigned with exact whole-number arithmetic. For every dimension the centroids are
sorted by their component. A vector's search enters each list at the vector's own value and walks
outward, always to the nearer of the two neighbours not yet taken. A centroid met for the first time
gets its exact distance. The components' frontiers bound every centroid not met yet from below: once the sum of
the squared frontier distances is strictly more than the best exact distance, no centroid that is
left can be as near, and the search stops. It goes on at equality, since a centroid of a smaller
number at the same distance would win.

Searches of a batch advance together, one step a time, in numpy; those that stopped drop out. A round
sends one partial sum per cluster, dimension and task, so what the driver reads is bounded by clusters times
dimensions. Vectors are read anew each round: nothing is cached, and a lost executor repeats its own tasks only.

Definitions: vectors of another size, and those with a null or non-finite component, are left out, as are
null vectors. ``vec_id`` may repeat (each row counts) or be null (kept, but such rows never
become centroids). Ties between ids' hashes go to the smaller vector. With fewer rows than clusters there
are as many clusters as rows; an empty table gives an empty result. Scaled components are clamped to 2**27 in
size, so that a squared distance over up to 256 dimensions fits a long; sums are decimals until the last. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import cut_lineage

MOST_COMPONENT = 1 << 27
# Rows that are searched together, to bound a task's memory.
ROWS = 4096


def _sound(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, v): the vectors that count, as doubles."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where((F.size(v) == dimensions) & finite).select("vec_id", v.cast("array<double>").alias("v"))


def _scaled(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """Rows of whole components: floor(scale * x)."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return np.clip(np.floor(scale * flat), -MOST_COMPONENT, MOST_COMPONENT).astype(np.int64)


def _first_centroids(kept: DataFrame, clusters: int, seed: int, dimensions: int, scale: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(clusters)
    return _scaled(pa.array([r["v"] for r in rows.collect()], pa.list_(pa.float64())), dimensions, scale)


class ThresholdSearch:
    """Exact nearest centroids by sorted lists per dimension.

    ``nearest`` also counts the centroids whose distances were computed and the steps walked.
    """

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # (dimensions, centroids)
        self.sorted = np.take_along_axis(centroids, self.order.T, axis=0).T
        self.measured = self.steps = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid; ties go to the smaller number."""
        count, dims = vectors.shape
        most = len(self.centroids)
        best = np.full(count, np.iinfo(np.int64).max)
        which = np.full(count, most)
        rows = np.arange(count)  # those still searching
        lanes = np.arange(dims)
        # the next list entries below and above each component
        above = np.empty((count, dims), dtype=np.int64)
        for d in range(dims):
            above[:, d] = np.searchsorted(self.sorted[d], vectors[:, d])
        below = above - 1
        met = np.zeros((count, most), dtype=bool)
        far = np.iinfo(np.int64).max
        for _ in range(most):
            if not len(rows):
                break
            v = vectors[rows]
            low = np.where(below >= 0, v - self.sorted[lanes, np.maximum(below, 0)], far)
            high = np.where(above < most, self.sorted[lanes, np.minimum(above, most - 1)] - v, far)
            down = low <= high
            frontier = np.where(down, low, high)
            taken = self.order[lanes, np.where(down, np.maximum(below, 0), np.minimum(above, most - 1))]
            below -= down
            above += ~down
            seen = np.zeros((len(rows), most), dtype=bool)
            seen[np.arange(len(rows))[:, None], taken] = True
            fresh = seen & ~met
            met |= seen
            at, k = np.nonzero(fresh)
            self.steps += len(rows)
            self.measured += len(at)
            if len(at):
                gaps = v[at] - self.centroids[k]
                exact = np.full((len(rows), most), far)
                exact[at, k] = np.einsum("ij,ij->i", gaps, gaps)
                # the first of equal distances has the smallest number
                nearest = exact.argmin(axis=1)
                distance = exact[np.arange(len(rows)), nearest]
                better = (distance < best[rows]) | ((distance == best[rows]) & (nearest < which[rows]))
                better &= distance < far
                best[rows[better]] = distance[better]
                which[rows[better]] = nearest[better]
            # each list's next entry is at least as far as its last one
            bound = np.einsum("ij,ij->i", frontier, frontier)
            going = (bound <= best[rows]) & ~met.all(axis=1)
            rows, below, above, met = rows[going], below[going], above[going], met[going]
        return which, best


def _searching(
    dimensions: int, scale: int, shared, emit: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], None]
) -> Callable[[Iterator[pa.RecordBatch]], None]:
    def run(batches: Iterator[pa.RecordBatch]) -> None:
        search = ThresholdSearch(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                vectors = _scaled(part.column("v"), dimensions, scale)
                which, distance = search.nearest(vectors)
                emit(part, vectors, which, distance)

    return run


def _moved(kept: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: floor of the mean of each cluster's vectors."""
    clusters, dims = centroids.shape
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * dims for _ in range(clusters)]
        counts = np.zeros(clusters, dtype=np.int64)

        def add(part: pa.RecordBatch, vectors: np.ndarray, which: np.ndarray, _: np.ndarray) -> None:
            counts[:] += np.bincount(which, minlength=clusters)
            for c in np.unique(which).tolist():
                # a part's sums fit a long; the task's are whole Python numbers
                sums[c] = [a + b for a, b in zip(sums[c], vectors[which == c].sum(axis=0).tolist())]

        _searching(dims, scale, shared, add)(batches)
        met = np.flatnonzero(counts).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c in met for _ in range(dims)], pa.int32()),
                pa.array([d for _ in met for d in range(dims)], pa.int32()),
                pa.array([str(x) for c in met for x in sums[c]], pa.string()),
                pa.array([int(counts[c]) for c in met for _ in range(dims)], pa.int64()),
            ],
            ["cluster", "d", "total", "n"],
        )

    found = (
        kept.mapInArrow(partial, "cluster int, d int, total string, n long")
        .groupBy("cluster", "d")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    shared.unpersist()
    after = centroids.copy()
    for row in found:
        after[row["cluster"], row["d"]] = int(row["total"]) // row["n"]
    return after


def fit(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2
) -> np.ndarray:
    """The centroids after some rounds, one row each."""
    if clusters < 1 or not 1 <= dimensions <= 256:
        raise ValueError("clusters must be positive, dimensions from 1 to 256")
    kept = _sound(vectors, dimensions)
    centroids = _first_centroids(kept, clusters, seed, dimensions, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(kept, centroids, scale)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, dimensions: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance): each sound vector's nearest centroid, and the squared distance."""
    kept = _sound(vectors, dimensions)
    if not len(centroids):
        # no rows at all, or none that may be a centroid: nothing to be near to
        return kept.limit(0).selectExpr("vec_id", "cast(null as int) as cluster", "cast(null as long) as distance")
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ThresholdSearch(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                which, distance = search.nearest(_scaled(part.column("v"), dimensions, scale))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").cast(pa.int64()), pa.array(which.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """Per vector: its cluster and distance, sums of distances, and the digest of its centroid."""
    import hashlib

    centroids = fit(vectors, clusters, rounds, dimensions, scale, seed)
    # written once, as both the rows and their sums are needed
    rows = cut_lineage(assign(vectors, centroids, dimensions, scale))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    # one row per cluster
    known = {r["cluster"]: int(r["own"]) for r in sums.collect()}
    total = sum(known.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = rows.sparkSession.createDataFrame(
        [(c, own, total, digests[c]) for c, own in known.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
