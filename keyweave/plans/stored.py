"""Serve a stored spec and report the stages of a workflow."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.keys import Gazetteer
from keyweave.operators.filters import filter_result, shape_json
from keyweave.operators.quality import null_stats
from keyweave.plans.runner import RunResult, SourceTable, one_row_join, run_spec
from keyweave.plans.spec import Spec, SpecError, parse_spec


@dataclass(frozen=True)
class StoredRun:
    """Rows a request asked for, and the gate over exactly these rows."""

    rows: DataFrame
    stats: DataFrame
    signal: DataFrame
    request: Mapping
    schema: Mapping | None


def payload_schema(requested: Mapping | None, stored: Mapping | None) -> Mapping | None:
    """A non-empty request schema replaces the stored one."""
    return requested or stored or None


def _object(value: object, what: str) -> Mapping:
    if not isinstance(value, Mapping):
        raise SpecError(f"{what} must be an object")
    return value


def _is_filter_value(value: object) -> bool:
    if isinstance(value, (list, tuple)):
        return all(_is_filter_value(v) and not isinstance(v, (list, tuple)) for v in value)
    return isinstance(value, (str, bool)) or (isinstance(value, (int, float)) and value == value and abs(value) != float("inf"))


def run_stored(
    workflow: Mapping | str,
    body: Mapping,
    tables: Mapping[str, SourceTable],
    gazetteer: Gazetteer | None = None,
) -> StoredRun:
    """Run a stored workflow ``{spec, request, schema}`` with the overrides of one request.

    The spec is not re-planned: the stored rows are computed, then the request's filters and
    the gate apply to them.
    """
    stored = json.loads(workflow) if isinstance(workflow, str) else workflow
    unknown = set(_object(body, "request body")) - {"request", "schema"}
    if unknown:
        raise SpecError(f"unknown request fields: {', '.join(sorted(unknown))}")
    if not stored.get("spec"):
        raise SpecError("the workflow holds no spec")
    request = _object(body["request"], "request") if body.get("request") is not None else stored.get("request") or {}
    requested = _object(body["schema"], "schema") if body.get("schema") is not None else None
    schema = payload_schema(requested, stored.get("schema"))
    filters = _object(request.get("filters") or {}, "request filters")
    if not all(_is_filter_value(v) for v in filters.values()):
        raise SpecError("request filters must be texts, numbers, booleans or lists of them")
    run = run_spec(stored["spec"], tables, gazetteer)
    rows = run.result
    stats = run.stats
    if "filters" in request:
        selected = filter_result(run.unlimited, filters, schema)  # before the limit, or rows that exist are missed
        rows = run.rows(selected)
        stats = null_stats(selected)
    signal = run.gate(stats=stats)
    if schema is not None:
        rows = shape_json(rows, schema)
    return StoredRun(rows, stats, signal, request, schema)


def stage_report(raw: Mapping | Spec, tables: Mapping[str, SourceTable], gazetteer: Gazetteer | None = None) -> DataFrame:
    """One row per stage: every source alone, the operation, the output.

    The operation is measured without order against the smallest source; the output takes
    the operation's verdict and adds order and limit. A stage after a stopped one is skipped.
    """
    spec = raw if isinstance(raw, Spec) else parse_spec(raw)
    whole = run_spec(replace(spec, order_by=(), limit=None), tables, gazetteer)
    sources = [
        run_spec(Spec((source,)), tables, gazetteer) for source in spec.sources
    ]
    rows = [
        _stage(run, position, "source", source.alias, run.gate())
        for position, (source, run) in enumerate(zip(spec.sources, sources))
    ]
    previews = sources[0].stats.select("row_count")
    for run in sources[1:]:
        previews = previews.unionByName(run.stats.select("row_count"))
    baseline = previews.agg(F.min("row_count").alias("baseline"))
    verdict = whole.gate(baseline)
    rows.append(_stage(whole, len(sources), "operation", "operation", verdict))
    output = run_spec(spec, tables, gazetteer)
    reason = verdict.select("reason", "observed", "threshold", "title")
    rows.append(_stage(output, len(sources) + 1, "output", "output", one_row_join(output.stats, reason)))
    report = rows[0]
    for row in rows[1:]:
        report = report.unionByName(row)
    stopped = report.agg(F.min(F.when(F.col("reason").isNotNull(), F.col("position"))).alias("_stopped"))
    return (
        one_row_join(report, stopped)
        .withColumn(
            "status",
            F.when(F.col("position") > F.col("_stopped"), "skipped")
            .when(F.col("reason").isNotNull(), "stopped")
            .otherwise("ok"),
        )
        .drop("_stopped")
    )


def _stage(run: RunResult, position: int, kind: str, name: str, verdict: DataFrame) -> DataFrame:
    """Card figures of one stage: rows, columns, empty share, lowest match, verdict."""
    low = F.round(F.col("lowest_match") * 100, 0) if "lowest_match" in verdict.columns else F.lit(None).cast("double")
    return verdict.select(
        F.lit(position).alias("position"),
        F.lit(kind).alias("kind"),
        F.lit(name).alias("stage"),
        "row_count",
        F.lit(len(run.unlimited.columns)).alias("columns"),
        F.round(F.col("null_rate") * 100, 0).alias("null_percent"),
        low.alias("match_percent"),
        "reason",
    )
