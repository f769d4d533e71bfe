"""Workflow graphs: many small graphs of links ``(workflow_id, position, source, target)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.session import cut_lineage

# A workflow of at most so many links is walked as one row; larger ones are walked by joins, round by round.
MOST_LINKS = 256


def _large(links: DataFrame) -> DataFrame:
    """Workflows that are walked by joins: those with many links, or with a link without a position."""
    counted = links.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("n"), F.count("position").alias("placed"))
    return cut_lineage(counted.where((F.col("n") > MOST_LINKS) | (F.col("n") > F.col("placed"))).select("workflow_id"))


def _walk_up(starts: list, targets: list, sources: list) -> list:
    """The starts and every node before them, level by level; a source without a name is told once a level."""
    before: dict = {}
    for target, source in zip(targets, sources):
        if target is not None:
            before.setdefault(target, set()).add(source)
    reached, newest = set(starts), set(starts)
    out = list(reached)
    while newest:
        found = set().union(*(before.get(n, ()) for n in newest if n is not None))
        newest = {n for n in found if n is None or n not in reached}
        reached |= newest
        out += newest
    return out


def _closing(positions: list, sources: list, targets: list) -> list:
    """Why each link can't follow those with smaller positions."""
    onward: dict = {}
    known: set = set()
    out: list = [None] * len(positions)
    waiting: list[int] = []
    for at in sorted(range(len(positions)), key=positions.__getitem__):
        if waiting and positions[waiting[0]] < positions[at]:
            for w in waiting:
                known.add((sources[w], targets[w]))
                if sources[w] != targets[w]:
                    onward.setdefault(sources[w], set()).add(targets[w])
            waiting = []
        waiting.append(at)
        source, target = sources[at], targets[at]
        if source == target:
            out[at] = "self"
        elif (source, target) in known:
            out[at] = "duplicate"
        else:
            seen, open_nodes = {target}, [target]
            while open_nodes and source not in seen:
                fresh = onward.get(open_nodes.pop(), set()) - seen
                seen |= fresh
                open_nodes += fresh
            if source in seen:
                out[at] = "cycle"
    return out


def _per_row(walk):
    def rows(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([walk(*(v or [] for v in row)) for row in zip(*(c.to_pylist() for c in columns))], pa.list_(pa.string()))

    return F.arrow_udf(rows, T.ArrayType(T.StringType()))


def upstream(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Every node from which a start node ``(workflow_id, node)`` can be reached, and itself.

    Links and starts of a workflow meet once and are walked together; workflows with more than ``MOST_LINKS``
    links are walked by joins.
    """
    text = [F.col(c).cast("string").alias(c) for c in ("source", "target")]
    wide = _large(links)
    asked = starts.select("workflow_id", "node")
    steps = links.join(wide, "workflow_id", "left_anti").where("workflow_id is not null").groupBy("workflow_id")
    steps = steps.agg(F.collect_set(F.struct(*text)).alias("steps"))
    begun = asked.join(wide, "workflow_id", "left_anti").groupBy("workflow_id")
    begun = begun.agg(F.collect_list(F.struct(F.col("node").cast("string").alias("node"))).alias("begun"))
    walked = _per_row(_walk_up)(F.col("begun.node"), F.col("steps.target"), F.col("steps.source"))
    kind = starts.schema["node"].dataType
    near = begun.join(steps, "workflow_id", "left").select("workflow_id", F.explode(walked.cast(T.ArrayType(kind))).alias("node"))
    far = _upstream_by_rounds(links.join(wide, "workflow_id", "left_semi"), asked.join(wide, "workflow_id", "left_semi"))
    return near.unionByName(far)


def _upstream_by_rounds(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Breadth-first: each round joins only the newest nodes with the links, so the number of
    rounds is the longest upstream path and cycles end by themselves.
    """
    steps = cut_lineage(links.select("workflow_id", F.col("target").alias("node"), "source").distinct())
    reached = cut_lineage(starts.select("workflow_id", "node").distinct())
    newest = reached
    while True:
        found = newest.join(steps, ["workflow_id", "node"]).select("workflow_id", F.col("source").alias("node"))
        newest = cut_lineage(found.distinct().join(reached, ["workflow_id", "node"], "left_anti"))
        if newest.isEmpty():
            return reached
        reached = reached.unionByName(newest)


def cyclic_core(links: DataFrame) -> DataFrame:
    """The links left after removing, round by round, those no cycle can use.

    A link stays only while some link enters its source and some link leaves its target.
    """
    core = cut_lineage(links.where(F.col("source") != F.col("target")))
    before = core.count()
    while before:
        entered = core.select("workflow_id", F.col("target").alias("source")).distinct()
        left = core.select("workflow_id", F.col("source").alias("target")).distinct()
        core = cut_lineage(
            core.join(entered, ["workflow_id", "source"], "left_semi").join(left, ["workflow_id", "target"], "left_semi")
        )
        after = core.count()
        if after == before:
            break
        before = after
    return core


def _chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths made of one of each table."""
    onward = second.select("workflow_id", F.col("source").alias("target"), F.col("target").alias("end"), F.col("latest").alias("then"))
    return first.join(onward, ["workflow_id", "target"]).select(
        "workflow_id", "source", F.col("end").alias("target"), F.greatest("latest", "then").alias("latest")
    )


def link_rejections(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Why a link could not be added after the links before it: self, duplicate, cycle.

    With ``nodes`` ``(workflow_id, node)`` a link whose ends do not both exist is ``missing_node``.
    A link closes a cycle when its target already reaches its source through earlier
    links. The links of a workflow meet once and are looked through in order; those of workflows with more than
    ``MOST_LINKS`` links are checked by joins.
    """
    wide = _large(links)
    known_ends = links.where("workflow_id is not null and source is not null and target is not null")
    rows = known_ends.join(wide, "workflow_id", "left_anti").groupBy("workflow_id").agg(F.collect_list(F.struct(*links.columns)).alias("link"))
    ends = [F.transform(F.col(f"link.{c}"), lambda v: v.cast("string")) for c in ("source", "target")]
    reasons = _per_row(_closing)(F.col("link.position"), *ends)
    near = rows.select(F.inline(F.arrays_zip("link", reasons.alias("rejection")))).select("link.*", "rejection")
    far = _rejections_by_rounds(links.join(wide, "workflow_id", "left_semi"))
    checked = near.unionByName(far)
    if nodes is None:
        return checked
    known = nodes.select("workflow_id", "node", F.lit(True).alias("_known")).distinct()
    for side in ("source", "target"):
        checked = checked.join(known.withColumnsRenamed({"node": side, "_known": f"_{side}_known"}), ["workflow_id", side], "left")
    missing = F.col("_source_known").isNull() | F.col("_target_known").isNull()
    return checked.select(*links.columns, F.when(missing, "missing_node").otherwise(F.col("rejection")).alias("rejection"))


def _rejections_by_rounds(links: DataFrame) -> DataFrame:
    """The same by joins: paths are kept with the latest link they need, so one closure over the cyclic
    core answers for every position at once.
    """
    core = cyclic_core(links)
    best = core.groupBy("workflow_id", "source", "target").agg(F.min("position").alias("latest"))
    best = fresh = cut_lineage(best)
    while True:
        # only paths of which one part got better in the last round can get better in this one
        longer = _chained(fresh, best).unionByName(_chained(best, fresh))
        grown = best.unionByName(longer).groupBy("workflow_id", "source", "target").agg(F.min("latest").alias("latest"))
        grown = cut_lineage(grown)
        fresh = cut_lineage(grown.join(best, ["workflow_id", "source", "target", "latest"], "left_anti"))
        best = grown
        if fresh.isEmpty():
            break
    back = best.select("workflow_id", F.col("source").alias("target"), F.col("target").alias("source"), "latest")
    first = links.groupBy("workflow_id", "source", "target").agg(F.min("position").alias("first_position"))
    ends = ["workflow_id", "source", "target"]
    checked = links.join(first, ends).join(back, ends, "left")
    rejection = (
        F.when(F.col("source") == F.col("target"), "self")
        .when(F.col("first_position") < F.col("position"), "duplicate")
        .when(F.col("latest") < F.col("position"), "cycle")
    )
    return checked.select(*[F.col(c) for c in links.columns], rejection.alias("rejection"))


def repeated_ids(items: DataFrame, identity: str) -> DataFrame:
    """Ids that occur more than once inside one workflow."""
    return items.groupBy("workflow_id", identity).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
