"""What a spec may say, on two invented tables: bakeries and mills."""

import copy

import pytest

from keyweave.plans.spec import SpecError, parse_spec


def bakeries(**other):
    source = {
        "alias": "b",
        "dataset_id": "bakeries",
        "key": {"column": "street", "level": "emd"},
        "metrics": [{"name": "loaves", "agg": "sum", "column": "baked"}],
    }
    return {**source, **other}


def mills(**other):
    return bakeries(alias="m", dataset_id="mills", metrics=[{"name": "sacks", "agg": "avg", "column": "ground"}], **other)


def spec(*sources, **other):
    return {"sources": list(sources or [bakeries()]), **other}


def test_a_single_source_reads_its_key_and_metric():
    parsed = parse_spec(spec(order_by=[{"name": "loaves"}], limit=7))
    assert parsed.output_columns == ["k", "loaves"]
    assert parsed.limit == 7 and not parsed.order_by[0].descending
    assert parsed.join_condition["levels"] == ["emd"]


def test_two_sources_share_a_key_column():
    parsed = parse_spec(spec(bakeries(), mills(), join="left"))
    assert parsed.output_columns == ["key", "loaves", "sacks"]
    assert parsed.join == "left"


def test_no_limit_means_all_rows():
    assert parse_spec(spec()).limit is None
    assert parse_spec(spec(limit=5_000_000)).limit == 5_000_000


@pytest.mark.parametrize("limit", [0, -3, 2.5, "9", True])
def test_odd_limits(limit):
    with pytest.raises(SpecError):
        parse_spec(spec(limit=limit))


@pytest.mark.parametrize(
    "field, value",
    [
        ("dataset_id", "mills where 1=1"),
        ("group_by", ["flour type"]),
        ("key", {"column": "street", "level": "planet"}),
        ("metrics", [{"name": "x", "agg": "median", "column": "baked"}]),
        ("metrics", [{"name": "x", "agg": "max", "column": "*"}]),
        ("filters", [{"column": "baked", "op": "near", "value": 3}]),
        ("filters", [{"column": "baked", "op": "<=", "value": "plenty"}]),
        ("filters", [{"column": "baked", "op": "!=", "value": False}]),
    ],
)
def test_odd_sources(field, value):
    with pytest.raises(SpecError):
        parse_spec(spec(bakeries(**{field: value})))


def test_odd_combinations():
    twins = copy.deepcopy([bakeries(), mills()])
    twins[1]["metrics"][0]["name"] = "loaves"
    for bad in (
        {"sources": None},
        {"sources": []},
        spec(bakeries(), mills(), join="cross"),
        spec(bakeries(), mills(key=None) | {"key": None}),
        spec(*twins),
        spec(order_by=[{"name": "sacks"}]),
    ):
        with pytest.raises(SpecError):
            parse_spec(bad)


def test_names_that_follow_from_the_metric():
    parsed = parse_spec(spec(bakeries(metrics=[{"agg": "count"}, {"agg": "min", "column": "baked"}])))
    assert [m.name for m in parsed.sources[0].metrics] == ["count_all", "min_baked"]
    assert parse_spec(spec(bakeries(metrics=[]))).output_columns == ["k", "b_rows"]
    plain = parse_spec({"sources": [{"alias": "m", "dataset_id": "mills", "columns": ["owner", "ground"]}]})
    assert plain.output_columns == ["owner", "ground"]
