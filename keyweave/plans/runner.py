"""Run a spec: every source is filtered, keyed and aggregated before it is joined."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.casts import finite_or_null
from keyweave.functions.keys import Gazetteer
from keyweave.operators.aggregates import aggregate
from keyweave.operators.filters import apply_filters, resolve_column, shape_json
from keyweave.operators.joins import star_join, tag_keys
from keyweave.operators.quality import dropped_detail, lowest_match, null_stats, stop_signal
from keyweave.operators.sorting import order_rows
from keyweave.plans.spec import Metric, Source, Spec, SpecError, parse_spec

_ROWS = "_rows_of_key"


@dataclass(frozen=True)
class SourceTable:
    """A table a spec may name, with the place it belongs to when it covers a single one."""

    df: DataFrame
    title: str = ""
    default_region: str | None = None


def source_frame(source: Source, table: SourceTable, gazetteer: Gazetteer) -> DataFrame:
    """Filter, then key and aggregate (or select raw columns of) one source."""
    df = apply_filters(table.df, source.filters)
    if source.is_raw_select:
        return df.select(*[F.col(f"`{resolve_column(df, c)}`") for c in source.columns])
    groups = [F.col(f"`{resolve_column(df, g)}`") for g in source.group_by]
    if source.key:
        column = F.col(f"`{resolve_column(df, source.key.column)}`")
        groups.insert(0, gazetteer.key(column, source.key.level, table.default_region).alias("k"))
    return aggregate(df, source.named_metrics(), groups)


def keyed_rows(source: Source, table: SourceTable, gazetteer: Gazetteer) -> DataFrame:
    """The aggregated source without its NULL key.

    A raw key is a plain column: its NULL test should reach the scan. For a computed key
    the pushed test would evaluate the whole normalization a second time for every input
    row, so the test is tied to a row count, which keeps it above the aggregate, and the key
    is declared non-NULL so that joins add no test of their own.
    """
    if source.key.level == "raw":
        return source_frame(source, table, gazetteer).where(F.col("k").isNotNull())
    counted = replace(source, metrics=(*source.named_metrics(), Metric(_ROWS, "count")))
    df = source_frame(counted, table, gazetteer).where(F.col("k").isNotNull() | (F.col(_ROWS) < 0))
    return df.withColumn("k", F.coalesce("k", F.lit(""))).drop(_ROWS)


def finite_columns(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by NULL in every floating-point column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            finite_or_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, floating) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


@dataclass(frozen=True)
class RunResult:
    """The DataFrames of one run; nothing is computed until one of them is used."""

    spec: Spec
    tables: tuple[SourceTable, ...]
    keyed: tuple[DataFrame, ...]
    gazetteer: Gazetteer

    @property
    def aliases(self) -> list[str]:
        return [source.alias for source in self.spec.sources]

    @cached_property
    def unlimited(self) -> DataFrame:
        """The whole result before ordering, limit and NaN cleaning."""
        if len(self.keyed) > 1:
            return star_join([self._without_null(i) for i in range(len(self.keyed))], self.spec.join)
        return self._without_null(0) if self.spec.sources[0].key else self.keyed[0]

    def _without_null(self, position: int) -> DataFrame:
        return keyed_rows(self.spec.sources[position], self.tables[position], self.gazetteer)

    def rows(self, df: DataFrame | None = None) -> DataFrame:
        """Rows of the whole result (or of a selection of them) in order, up to the limit if there is one.

        A limited result is always ordered, by the key where the spec names nothing else.
        """
        df = self.unlimited if df is None else df
        by_row = [c for c in ("key", "k") if c in df.columns]
        by_row += [g for s in self.spec.sources if not s.is_raw_select for g in s.group_by if g in df.columns]
        if self.spec.limit is not None and not self.spec.order_by and not by_row:
            raise SpecError("a limit on rows without a key needs order_by")
        if self.spec.order_by or self.spec.limit is not None:
            df = order_rows(df, self.spec.order_by, by_row)
        return finite_columns(df if self.spec.limit is None else df.limit(self.spec.limit))

    @cached_property
    def result(self) -> DataFrame:
        """Ordered, limited and cleaned rows."""
        return self.rows()

    @cached_property
    def stats(self) -> DataFrame:
        """One row: rows returned (after the limit) and null rate of the whole result."""
        whole = null_stats(self.unlimited)
        shown = F.col("row_count") if self.spec.limit is None else F.least("row_count", F.lit(self.spec.limit).cast("bigint"))
        return whole.withColumn("full_row_count", F.col("row_count")).withColumn("row_count", shown)

    @cached_property
    def dropped_detail(self) -> DataFrame:
        """Per source: keys, matches, dropped keys and reason (no rows for one source)."""
        keys = [df.select("k") for df in self.keyed] if len(self.keyed) > 1 else []
        if not keys:
            raise SpecError("a drop report needs at least two sources")
        detail = dropped_detail(tag_keys(keys, self.aliases), self.aliases)
        titles = F.create_map(
            *[F.lit(x) for s, t in zip(self.spec.sources, self.tables) for x in (s.alias, t.title or s.dataset_id)]
        )
        ids = F.create_map(*[F.lit(x) for s in self.spec.sources for x in (s.alias, s.dataset_id)])
        return detail.withColumn("dataset_id", ids[F.col("alias")]).withColumn("title", titles[F.col("alias")])

    def gate(self, baseline: int | DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
        """One row with the stop reason, NULL when the result may continue."""
        checked = (self.stats if stats is None else stats).withColumn("allow_partial", F.lit(self.spec.join == "left"))
        if isinstance(baseline, int):
            checked = checked.withColumn("baseline", F.lit(baseline).cast("bigint"))
        elif baseline is not None:
            checked = one_row_join(checked, baseline)
        if len(self.keyed) > 1:
            checked = one_row_join(checked, lowest_match(self.dropped_detail))
        return stop_signal(checked)

    def output(self, schema: Mapping) -> DataFrame:
        """Result rows with one aligned JSON object each."""
        return shape_json(self.result, schema)


def one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put a global aggregate (one row) next to every row, as scalar subqueries."""
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})


def run_spec(raw: Mapping | Spec, tables: Mapping[str, SourceTable], gazetteer: Gazetteer | None = None) -> RunResult:
    """Validate a spec against the given tables and lay out its DataFrames."""
    spec = raw if isinstance(raw, Spec) else parse_spec(raw)
    gazetteer = gazetteer or Gazetteer()
    missing = [s.dataset_id for s in spec.sources if s.dataset_id not in tables]
    if missing:
        raise SpecError(f"unknown dataset {missing[0]}")
    used = tuple(tables[s.dataset_id] for s in spec.sources)
    keyed = tuple(source_frame(s, t, gazetteer) for s, t in zip(spec.sources, used))
    return RunResult(spec, used, keyed, gazetteer)
