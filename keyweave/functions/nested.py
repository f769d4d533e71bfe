"""Arrays of nested values: members of JSON objects in document order, walks, one entry per name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBERS = "array<struct<name:string,spec:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def members(json: Column) -> Column:
    """Members of a JSON object as ``array<struct(name, spec)>``, in the order they are written.

    Nested values stay JSON texts, so one level is parsed at a time. Empty for anything else.
    """
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    named = F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec")))
    return F.coalesce(F.when(F.startswith(F.ltrim(json), F.lit("{")), named), F.array().cast(MEMBERS))


def items(json: Column) -> Column:
    """Members of a JSON list as texts; empty for anything else."""
    listed = F.when(F.startswith(F.ltrim(json), F.lit("[")), F.from_json(json, "array<string>"))
    return F.coalesce(listed, F.array().cast("array<string>"))


def one_per_name(entries: Column, last: bool = False) -> Column:
    """Of the entries ``struct(at, name, ...)`` that share a name the first by ``at`` (or the last); ordered by ``at``.

    Neighbours are compared after sorting, so time is that of two sorts.
    """

    def by_name(e: Column) -> Column:
        return F.struct(e["name"].alias("name"), e["at"].alias("at"), e.alias("entry"))

    def alone(own: Column) -> Column:
        at_edge = (lambda i: i == F.size(own) - 1) if last else (lambda i: i == 0)
        step = 1 if last else -1
        return F.filter(own, lambda e, i: at_edge(i) | ~F.get(own, i + step)["name"].eqNullSafe(e["name"]))

    kept = let(F.array_sort(F.transform(entries, by_name)), alone)
    return F.transform(
        F.array_sort(F.transform(kept, lambda e: F.struct(e["at"].alias("at"), e["entry"].alias("entry")))), lambda e: e["entry"]
    )


def walk(df: DataFrame, roots: Column, below: Callable[[Column], Column], levels: int, into: str) -> DataFrame:
    """Add ``into``: the leaves of trees of JSON texts as ``array<struct(at, name, spec)>``, depth first.

    ``roots`` is an array of ``struct(name, spec)``; ``below`` gives a node's members in the same form.
    A node without any is a leaf, and so is every node once ``levels`` were descended. ``at`` holds the
    places along the way. Each level is a projection: nothing is shuffled.
    """
    start = F.transform(
        F.coalesce(roots, F.array().cast(MEMBERS)),
        lambda n, i: F.struct(F.array(i).alias("at"), n["name"].alias("name"), n["spec"].alias("spec")),
    )
    leaf = "array<struct<at:array<int>,name:string,spec:string>>"
    df = df.withColumns({"_open": start, "_leaves": F.array().cast(leaf)})
    for _ in range(levels):
        df = df.withColumn(
            "_open",
            F.transform(
                "_open",
                lambda n: F.struct(n["at"].alias("at"), n["name"].alias("name"), n["spec"].alias("spec"), below(n["spec"]).alias("inner")),
            ),
        )
        plain = F.transform(
            F.filter("_open", lambda n: F.size(n["inner"]) == 0),
            lambda n: F.struct(n["at"].alias("at"), n["name"].alias("name"), n["spec"].alias("spec")),
        )
        inner = F.flatten(
            F.transform(
                "_open",
                lambda n: F.transform(
                    n["inner"],
                    lambda m, i: F.struct(F.concat(n["at"], F.array(i)).alias("at"), m["name"].alias("name"), m["spec"].alias("spec")),
                ),
            )
        )
        df = df.withColumns({"_leaves": F.concat("_leaves", plain), "_open": inner})
    return df.withColumn(into, F.array_sort(F.concat("_leaves", "_open"))).drop("_open", "_leaves")
