"""The declarative spec: what to read, how to key and measure it, how to combine it.

``parse_spec`` checks a plain dictionary and returns frozen dataclasses; nothing here
touches data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

IDENTIFIER = re.compile(r"[0-9A-Za-z가-힣_]+")
LEVELS = ("sgg", "emd", "raw")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "like", "in")
AGGREGATES = ("count", "sum", "avg", "min", "max", "count_distinct", "count_if")
JOINS = ("inner", "left")
MAX_SOURCES = 4


class SpecError(ValueError):
    """The spec cannot be run as written."""


def identifier(value: object, what: str) -> str:
    if not isinstance(value, str) or not IDENTIFIER.fullmatch(value):
        raise SpecError(f"invalid {what}: {value!r}")
    return value


def _items(value: object, what: str) -> list:
    if value is None:
        return []
    if not isinstance(value, (list, tuple)):
        raise SpecError(f"{what} must be a list")
    return list(value)


def _record(value: object, what: str) -> dict:
    if not isinstance(value, dict):
        raise SpecError(f"{what} must be an object")
    return value


def _choice(value: object, allowed: Iterable[str], what: str) -> str:
    if value not in allowed:
        raise SpecError(f"unknown {what}: {value!r}")
    return value  # type: ignore[return-value]


@dataclass(frozen=True)
class Key:
    column: str
    level: str = "raw"


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str | int | float | tuple[str, ...]


@dataclass(frozen=True)
class Metric:
    name: str
    agg: str
    column: str = "*"
    value: str = "Y"


@dataclass(frozen=True)
class Source:
    alias: str
    dataset_id: str
    key: Key | None = None
    filters: tuple[Filter, ...] = ()
    metrics: tuple[Metric, ...] = ()
    columns: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()

    @property
    def is_raw_select(self) -> bool:
        return bool(self.columns) and not self.metrics

    def named_metrics(self) -> tuple[Metric, ...]:
        """The metrics to compute; a plain row count when none is given."""
        return self.metrics or (Metric(f"{self.alias}_rows", "count"),)


@dataclass(frozen=True)
class Order:
    name: str
    descending: bool = False


@dataclass(frozen=True)
class Spec:
    sources: tuple[Source, ...]
    join: str = "inner"
    order_by: tuple[Order, ...] = ()
    limit: int | None = None

    @property
    def output_columns(self) -> list[str]:
        """Result columns in order: the key, then group columns and metrics per source."""
        names: dict[str, None] = {}
        for source in self.sources:
            if source.is_raw_select:
                names.update(dict.fromkeys(source.columns))
                continue
            if source.key:
                names["key" if len(self.sources) > 1 else "k"] = None
            names.update(dict.fromkeys(source.group_by))
            names.update((metric.name, None) for metric in source.named_metrics())
        return list(names)

    @property
    def join_condition(self) -> dict:
        """A summary of how the sources meet, for reports."""
        levels = dict.fromkeys(s.key.level for s in self.sources if s.key)
        return {
            "mode": self.join if len(self.sources) > 1 else "single",
            "levels": list(levels),
            "sources": [
                {
                    "alias": s.alias,
                    "dataset_id": s.dataset_id,
                    "column": s.key.column if s.key else None,
                    "level": s.key.level if s.key else None,
                }
                for s in self.sources
            ],
        }


def _parse_filter(raw: object) -> Filter:
    item = _record(raw, "filter")
    value = item.get("value")
    if isinstance(value, (list, tuple)):
        if not all(isinstance(part, str) for part in value):
            raise SpecError("filter list must hold strings")
        value = tuple(value)
    elif isinstance(value, bool) or not isinstance(value, (str, int, float)):
        raise SpecError(f"invalid filter value: {value!r}")
    op = _choice(item.get("op", "="), OPERATORS, "filter operator")
    if op in (">", "<", ">=", "<="):
        try:
            float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            raise SpecError(f"{op} needs a number, got {value!r}") from None
    elif isinstance(value, tuple) and op != "in":
        raise SpecError(f"{op} needs one value")
    return Filter(identifier(item.get("column"), "filter column"), op, value)


def _parse_metric(raw: object) -> Metric:
    item = _record(raw, "metric")
    agg = _choice(item.get("agg", "count"), AGGREGATES, "aggregate")
    column = item.get("column", "*")
    if column != "*":
        identifier(column, "metric column")
    elif agg != "count":
        raise SpecError(f"{agg} needs a column")
    name = item.get("name") or f"{agg}_{column}".replace("*", "all")
    return Metric(identifier(name, "metric name"), agg, column, str(item.get("value") or "Y"))


def _parse_source(raw: object, position: int) -> Source:
    item = _record(raw, "source")
    alias = re.sub(r"\W", "", str(item.get("alias") or "")) or f"s{position}"
    key = None
    if item.get("key"):
        raw_key = _record(item["key"], "key")
        level = _choice(raw_key.get("level", "raw"), LEVELS, "key level")
        key = Key(identifier(raw_key.get("column"), "key column"), level)
    return Source(
        alias=alias,
        dataset_id=identifier(str(item.get("dataset_id") or ""), "dataset id"),
        key=key,
        filters=tuple(_parse_filter(f) for f in _items(item.get("filters"), "filters")),
        metrics=tuple(_parse_metric(m) for m in _items(item.get("metrics"), "metrics")),
        columns=tuple(identifier(c, "column") for c in _items(item.get("columns"), "columns")),
        group_by=tuple(identifier(c, "group column") for c in _items(item.get("group_by"), "group_by")),
    )


def parse_spec(raw: object) -> Spec:
    """Check a spec dictionary; raises ``SpecError`` with the first problem found."""
    item = _record(raw, "spec")
    sources = tuple(_parse_source(s, i) for i, s in enumerate(_items(item.get("sources"), "sources")))
    if not 1 <= len(sources) <= MAX_SOURCES:
        raise SpecError(f"a spec needs 1 to {MAX_SOURCES} sources")
    aliases = [source.alias for source in sources]
    if len(set(aliases)) < len(aliases):
        raise SpecError("source aliases must differ")
    limit = item.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise SpecError("limit must be a whole number from 1, or none for all rows")
    orders = []
    for raw_order in _items(item.get("order_by"), "order_by"):
        order = _record(raw_order, "order")
        orders.append(Order(identifier(order.get("name"), "order column"), bool(order.get("desc"))))
    spec = Spec(sources, _choice(item.get("join") or "inner", JOINS, "join"), tuple(orders), limit)
    if len(sources) > 1:
        if any(source.key is None or source.is_raw_select for source in sources):
            raise SpecError("every source needs a key when joining")
        measured = [name for s in sources for name in (*s.group_by, *(m.name for m in s.named_metrics()))]
        if len(set(measured)) < len(measured) or "key" in measured:
            raise SpecError("column names must differ between joined sources")
    unknown = [order.name for order in orders if order.name not in spec.output_columns]
    if unknown:
        raise SpecError(f"order column {unknown[0]!r} is not in the result")
    return spec
