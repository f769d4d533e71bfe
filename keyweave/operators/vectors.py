"""Exact search among document vectors, by cells whose bounds tell which documents can't matter.

Documents are dealt to cells by the nearest of some sampled centers. For a question q, a cell with center c and
radius r holds no product above q·c + |q|r. A question first looks at the cells that promise most, which
gives a lower bound of its last wanted value; then it looks at those other cells whose bound reaches it, and at no
more. Cells and questions meet in blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyweave.session import cut_lineage

# At most so many cells, whose centers are held by the driver and every task.
MOST_CELLS = 512
# Bytes of the vectors of a block, and questions that meet it together.
BLOCK_BYTES = 8 << 20
QUESTION_BLOCK = 512


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class Cells:
    """The cells that have documents: their numbers, and what bounds their contents.

    ``top`` is the largest prior; ``parts`` is the number of a cell's blocks.
    """

    numbers: np.ndarray
    centers: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    top: np.ndarray
    parts: np.ndarray


@dataclass(frozen=True)
class VectorIndex:
    """``rows (doc_id, vector, prior, cell, part)`` and the cells they are dealt to."""

    rows: DataFrame
    cells: Cells

    def without_priors(self) -> VectorIndex:
        """The same documents ranked by their vectors alone."""
        return VectorIndex(self.rows.withColumn("prior", F.lit(0.0)), replace(self.cells, top=np.zeros(len(self.cells.top))))


def build(documents: DataFrame, cells: int | None = None) -> VectorIndex:
    """Index ``documents (doc_id, vector, prior)``, whose vectors are equally long and whole."""
    if cells is None:
        cells = min(MOST_CELLS, max(1, round(documents.count() ** 0.5)))
    picked = documents.select("doc_id", "vector").orderBy(F.xxhash64("doc_id"), "doc_id").limit(cells).collect()
    centers = np.array([r["vector"] for r in picked], dtype=np.float64).reshape(len(picked), -1 if picked else 1)
    norms = (centers**2).sum(axis=1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            vectors = matrix(rows["vector"])
            cell = np.argmin(norms - 2 * (vectors @ centers.T), axis=1)
            # measured again, as the expanded form loses digits
            distance = np.sqrt(((vectors - centers[cell]) ** 2).sum(axis=1))
            yield rows.assign(cell=cell.astype(np.int32), distance=distance)

    given = documents.select("doc_id", "vector", F.col("prior").cast("double").alias("prior"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    dealt = cut_lineage(given.mapInPandas(deal, f"{shape}, cell int, distance double"))
    found = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r"), F.max("prior").alias("top"))
    stats = sorted(found.collect(), key=lambda r: r["cell"])  # one row per cell
    used = np.array([r["cell"] for r in stats], dtype=np.int32)
    count = np.array([r["n"] for r in stats], dtype=np.int64)
    parts = -(-count // max(1, BLOCK_BYTES // (8 * max(1, centers.shape[1]))))
    listed = dealt.sparkSession.createDataFrame(list(zip(used.tolist(), parts.tolist())), "cell int, parts long")
    part = F.pmod(F.xxhash64("doc_id"), "parts").cast("int")
    rows = dealt.drop("distance").join(F.broadcast(listed), "cell").withColumn("part", part).drop("parts")
    radius, top = (np.array([r[c] for r in stats], dtype=np.float64) for c in ("r", "top"))
    return VectorIndex(rows, Cells(used, centers[used], radius, count, top, parts))


def best(index: VectorIndex, questions: DataFrame) -> DataFrame:
    """The ``keep`` best documents of each question by ``scale`` times the product of vectors plus the prior.

    ``questions (question_id, vector, scale, keep)``; returns ``(question_id, doc_id, product, value)``. Values
    are compared at twelve digits, then by ``doc_id``. A negative scale seeks the smallest products.
    """
    if not len(index.cells.numbers):
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((questions, "question_id"), (index.rows, "doc_id"))]
        return questions.sparkSession.createDataFrame([], f"question_id {kinds[0]}, doc_id {kinds[1]}, product double, value double")
    scale, keep = F.col("scale").cast("double").alias("scale"), F.col("keep").cast("int").alias("keep")
    questions = cut_lineage(questions.select("question_id", "vector", scale, keep))
    first = cut_lineage(_leading(_scan(index, questions, _places(index.cells, questions, _promising))))
    least = first.groupBy("question_id").agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("n"))
    known = questions.join(least, "question_id", "left")
    floor = F.when(F.col("n") >= F.col("keep"), F.col("least")).otherwise(F.lit(float("-inf")))
    rest = _places(index.cells, known.withColumn("least", floor).drop("n"), _reaching)
    return _leading(first.unionByName(_scan(index, questions, rest))).drop("keep")


def _bounds(cells: Cells, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What each cell promises at its center, and can't exceed, for each question."""
    vectors, scale = matrix(rows["vector"]), rows["scale"].to_numpy()[:, None]
    middle = scale * (vectors @ cells.centers.T) + cells.top
    slack = np.abs(scale) * np.sqrt((vectors**2).sum(axis=1))[:, None] * cells.radius
    return middle, middle + slack * (1 + 1e-9) + 1e-9


def _promising(cells: Cells, rows: pd.DataFrame) -> np.ndarray:
    """The cells that promise most, as many as hold enough documents."""
    middle, _ = _bounds(cells, rows)
    order = np.argsort(-middle, axis=1, kind="stable")
    held_before = np.cumsum(cells.count[order], axis=1) - cells.count[order]
    out = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(out, order, held_before < rows["keep"].to_numpy()[:, None], axis=1)
    return out


def _reaching(cells: Cells, rows: pd.DataFrame) -> np.ndarray:
    """The other cells whose bound reaches the last value found so far."""
    _, most = _bounds(cells, rows)
    return (most >= rows["least"].to_numpy()[:, None]) & ~_promising(cells, rows)


def _places(cells: Cells, questions: DataFrame, choose: Callable[[Cells, pd.DataFrame], np.ndarray]) -> DataFrame:
    """``(question_id, cell)`` for the cells that ``choose`` marks."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for low in range(0, len(rows), QUESTION_BLOCK):
                part = rows.iloc[low : low + QUESTION_BLOCK]
                at, cell = np.nonzero(choose(cells, part))
                yield pd.DataFrame({"question_id": part["question_id"].to_numpy()[at], "cell": cells.numbers[cell]})

    kind = questions.schema["question_id"].dataType.simpleString()
    return questions.mapInPandas(look, f"question_id {kind}, cell int")


def _scan(index: VectorIndex, questions: DataFrame, places: DataFrame) -> DataFrame:
    """The best documents of each question in each block of the cells it looks at."""
    places = cut_lineage(places)
    asked = {r["cell"]: r["n"] for r in places.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
    groups = [(c, p, -(-asked[c] // QUESTION_BLOCK)) for c, p in zip(index.cells.numbers.tolist(), index.cells.parts.tolist()) if c in asked]
    spread = F.broadcast(places.sparkSession.createDataFrame(groups, "cell int, parts int, groups int"))
    left = (
        places.join(spread, "cell")
        .join(questions, "question_id")
        .withColumn("group", F.pmod(F.xxhash64("question_id"), "groups").cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts", "groups")
    )
    right = index.rows.join(spread, "cell").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("parts", "groups")
    names = ["question_id", "doc_id", "product", "value", "keep"]

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({n: [] for n in names})
        d = d.sort_values("doc_id", kind="stable")
        ids, prior = d["doc_id"].to_numpy(), d["prior"].to_numpy()
        product = matrix(q["vector"]) @ matrix(d["vector"]).T
        value = np.round(q["scale"].to_numpy()[:, None] * product + prior, 12)
        found = []
        for question, row, products, keep in zip(q["question_id"], value, product, q["keep"]):
            at = np.arange(len(row))
            if keep < len(row):
                at = np.flatnonzero(row >= np.partition(row, len(row) - keep)[len(row) - keep])
            at = at[np.argsort(-row[at], kind="stable")[:keep]]
            found.append((np.full(len(at), question), ids[at], products[at], row[at], np.full(len(at), keep)))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*found))})

    block = ["cell", "part", "group"]
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((questions, "question_id"), (index.rows, "doc_id"))]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(
        meet, f"question_id {kinds[0]}, doc_id {kinds[1]}, product double, value double, keep int"
    )


def _leading(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.col("value").desc(), F.col("doc_id").asc())
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("keep")).drop("_at")
