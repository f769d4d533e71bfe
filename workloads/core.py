"""Projection, filters, keys and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave import run_spec
from keyweave.functions.casts import clean, finite_or_null
from keyweave.operators.aggregates import conditional_percent
from keyweave.operators.filters import apply_filters, filter_result, shape_json
from keyweave.operators.graph import keys_by_level
from keyweave.operators.quality import null_stats
from keyweave.plans.runner import one_row_join
from keyweave.plans.spec import Filter
from workloads.inputs import (
    CUSTOMERS,
    GAZETTEER,
    NATIONS,
    ORDERS,
    address,
    city_of,
    customers,
    nations,
    orders,
    place,
    read,
    sql_double,
    sql_metric,
    tables,
    town,
    town_of,
)
from workloads.registry import query


def whole(spark, folder, *sources, **options):
    """All rows of a spec, without the display limit."""
    return run_spec({"sources": list(sources), **options}, tables(spark, folder)).unlimited


# ---- projection


@query("prj_raw_columns", "select p_partkey, p_name, p_brand from part where p_type = 'ECONOMY'")
def prj_raw_columns(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "p",
            "dataset_id": "part",
            "columns": ["P_PARTKEY", "p_name", "p_brand"],
            "filters": [{"column": "p_type", "op": "=", "value": "ECONOMY"}],
        },
    )


@query(
    "prj_shape_json",
    f"""select r_name as region, count(*) as nations,
        '{{"name":"' || r_name || '","n":' || cast(count(*) as varchar) || '}}' as output
        from {NATIONS} group by r_name""",
)
def prj_shape_json(spark, folder):
    counted = nations(spark, folder).groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("nations"))
    return shape_json(
        counted, {"type": "object", "properties": {"name": {"column": "region"}, "n": {"from": "nations"}}}
    )


@query(
    "prj_nan_to_null",
    """select c_custkey, case when c_custkey % 4 in (0, 1) then null else c_acctbal end as balance from customer""",
)
def prj_nan_to_null(spark, folder):
    raw = F.expr("case c_custkey % 4 when 0 then double('nan') when 1 then double('-inf') else c_acctbal end")
    return read(spark, folder, "customer").select("c_custkey", finite_or_null(raw).alias("balance"))


# ---- filters


def filter_query(name, table, columns, item, sql_where, sql_table):
    """A query that keeps the rows of one table passing one filter."""

    def run(spark, folder):
        df = tables(spark, folder)[table].df
        return apply_filters(df, tuple(item) if isinstance(item, list) else (item,)).select(*columns)

    query(name, f"select {', '.join(columns)} from {sql_table} where {sql_where}")(run)


_ORDER = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
_BALANCE = ["c_custkey", "c_balance"]
filter_query("flt_eq", "orders", _ORDER, Filter("o_orderstatus", "=", "F"), "o_orderstatus = 'F'", "orders")
filter_query("flt_ne", "orders", _ORDER, Filter("o_orderstatus", "!=", "F"), "o_orderstatus <> 'F'", "orders")
for _name, _op in (("flt_gt", ">"), ("flt_lt", "<"), ("flt_ge", ">="), ("flt_le", "<=")):
    filter_query(
        _name,
        "customer",
        _BALANCE,
        Filter("c_balance", _op, 1000),
        f"{sql_double('c_balance')} {_op} 1000",
        CUSTOMERS,
    )
filter_query(
    "flt_like", "part", ["p_partkey", "p_name"], Filter("p_name", "like", "%e_ b%"), "p_name like '%e_ b%'", "part"
)
filter_query(
    "flt_in",
    "orders",
    _ORDER,
    Filter("o_orderpriority", "in", ("1-URGENT", "5-LOW")),
    "o_orderpriority in ('1-URGENT', '5-LOW')",
    "orders",
)
filter_query(
    "flt_and",
    "lineitem",
    ["l_orderkey", "l_linenumber", "l_quantity"],
    [Filter("l_returnflag", "=", "A"), Filter("l_quantity", ">=", 30), Filter("l_linestatus", "!=", "O")],
    "l_returnflag = 'A' and l_quantity >= 30 and l_linestatus <> 'O'",
    "lineitem",
)


@query(
    "flt_key_not_null",
    f"select c_city as k, count(*) as customers from {CUSTOMERS} where c_city is not null group by c_city",
)
def flt_key_not_null(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "c",
            "dataset_id": "customer",
            "key": {"column": "c_address", "level": "sgg"},
            "metrics": [{"name": "customers", "agg": "count", "column": "*"}],
        },
    )


_HIER = f"""with r as (select n_path as key, count(*) as customers, sum(c_acctbal) as balance
    from customer join {NATIONS} on c_nationkey = n_nationkey group by n_path)
    select key, customers, round(balance, 2) as balance,
      count(*) over () as row_count, 0.0::double as null_rate from r
    where key = 'AFRICA' or starts_with(key, 'AFRICA|') or key = 'ASIA|NATION_2' or starts_with(key, 'ASIA|NATION_2|')"""


@query("flt_result_hier", _HIER)
def flt_result_hier(spark, folder):
    nation = nations(spark, folder)
    result = (
        read(spark, folder, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_path").alias("key"), "customers", F.round("balance", 2).alias("balance"))
    )
    kept = filter_result(
        result, {"place": ["AFRICA", "ASIA|NATION_2"]}, {"properties": {"place": {"column": "key"}}}
    )
    return one_row_join(kept, null_stats(kept).drop("column_count"))


@query(
    "flt_region_drill",
    f"""select o_town as k, count(*) as orders from {ORDERS}
        where o_address like '%구미%' and o_town is not null group by o_town""",
)
def flt_region_drill(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "o",
            "dataset_id": "orders",
            "key": {"column": "o_address", "level": "emd"},
            "filters": [{"column": "o_address", "op": "like", "value": "%구미%"}],
            "metrics": [{"name": "orders", "agg": "count", "column": "*"}],
        },
    )


# ---- keys


@query(
    "key_clean",
    """select o_orderkey, case o_orderkey % 5 when 0 then null when 1 then null when 2 then null
         when 3 then o_orderpriority else o_orderstatus end as cleaned from orders""",
)
def key_clean(spark, folder):
    raw = F.expr(
        "case o_orderkey % 5 when 0 then ' NaN ' when 1 then ' \\u3000 ' when 2 then 'Null'"
        " when 3 then '\\t' || o_orderpriority || '\\u00a0' else o_orderstatus end"
    )
    return read(spark, folder, "orders").select("o_orderkey", clean(raw).alias("cleaned"))


@query("key_sgg", f"select o_orderkey, o_address, {city_of('o_orderkey')} as city from {ORDERS}")
def key_sgg(spark, folder):
    return orders(spark, folder).select("o_orderkey", "o_address", GAZETTEER.city("o_address").alias("city"))


@query("key_emd", f"select o_orderkey, {town_of('o_orderkey')} as town from {ORDERS}")
def key_emd(spark, folder):
    return orders(spark, folder).select("o_orderkey", GAZETTEER.town("o_address").alias("town"))


@query(
    "key_emd_default",
    f"""select o_orderkey, case when o_orderkey % 4 = 0 and o_custkey % 2 = 0
          then {place('o_custkey')} || '|' || {town('o_orderkey')}
          when o_orderkey % 4 = 0 then null else {town_of('o_orderkey')} end as town from orders""",
)
def key_emd_default(spark, folder):
    text = F.expr(f"case when o_orderkey % 4 = 0 then ' ' || {town('o_orderkey')} else {address('o_orderkey')} end")
    home = F.expr(f"case when o_custkey % 2 = 0 then {place('o_custkey')} end")
    return read(spark, folder, "orders").select("o_orderkey", GAZETTEER.town(text, home).alias("town"))


@query("key_raw", f"select c_address as k, count(*) as customers from {CUSTOMERS} group by c_address")
def key_raw(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "c",
            "dataset_id": "customer",
            "key": {"column": "c_address"},
            "metrics": [{"name": "customers", "agg": "count"}],
        },
    )


@query(
    "key_default_region",
    f"""select s_suppkey, case when s_suppkey % 3 = 0 then {place('s_suppkey')}
          when s_suppkey % 3 = 1 then {place('s_suppkey + 1')} end as region from supplier""",
)
def key_default_region(spark, folder):
    provider = F.expr(f"case when s_suppkey % 3 = 0 then '경상북도 ' || {place('s_suppkey')} else '경상북도' end")
    title = F.expr(f"case when s_suppkey % 3 = 2 then s_name else {place('s_suppkey + 1')} || ' ' || s_name end")
    return read(spark, folder, "supplier").select(
        "s_suppkey", GAZETTEER.default_region(provider, title).alias("region")
    )


@query(
    "key_question_region",
    f"""select c_custkey, case c_custkey % 4 when 3 then null
          when 2 then case c_custkey % 2 when 0 then '포항시' end else {place('c_custkey')} end as region from customer""",
)
def key_question_region(spark, folder):
    asked = F.expr(
        f"case c_custkey % 4 when 0 then c_name || ' ' || {place('c_custkey')} || '?'"
        f" when 1 then substr({place('c_custkey')}, 1, 2) || ' ' || c_name"
        " when 2 then 'Pohang ' || c_mktsegment else c_name end"
    )
    return read(spark, folder, "customer").select("c_custkey", GAZETTEER.question_region(asked).alias("region"))


@query(
    "key_distinct_long",
    f"""select 'sgg' as level, c_city as k from {CUSTOMERS} where c_city is not null group by all
        union all select 'emd', c_town from {CUSTOMERS} where c_town is not null group by all""",
)
def key_distinct_long(spark, folder):
    long = customers(spark, folder).select(
        F.lit("customer").alias("dataset_id"), F.lit("c_address").alias("column"), F.col("c_address").alias("value")
    )
    return keys_by_level(long, GAZETTEER).select("level", "k").distinct()


# ---- aggregates


def aggregate_query(name, metric, sql_expression, rounded=None):
    """One metric per city key of the customers."""

    def run(spark, folder):
        df = whole(
            spark,
            folder,
            {
                "alias": "c",
                "dataset_id": "customer",
                "key": {"column": "c_address", "level": "sgg"},
                "metrics": [{"name": "m", **metric}] if metric else [],
            },
        )
        return df.withColumn("m", F.round("m", rounded)) if rounded is not None else df

    column = "m" if metric else "c_rows"
    expression = f"round({sql_expression}, {rounded})" if rounded is not None else sql_expression
    query(
        name,
        f"select c_city as k, {expression} as {column} from {CUSTOMERS} where c_city is not null group by c_city",
    )(run)


aggregate_query("agg_count_star", {"agg": "count", "column": "*"}, "count(*)")
aggregate_query("agg_count_col", {"agg": "count", "column": "c_balance"}, "count(c_balance)")
aggregate_query("agg_count_distinct", {"agg": "count_distinct", "column": "c_balance"}, "count(distinct c_balance)")
aggregate_query(
    "agg_count_if", {"agg": "count_if", "column": "c_rich", "value": "Y"}, "count(*) filter (where c_rich = 'Y')"
)
aggregate_query("agg_sum", {"agg": "sum", "column": "c_balance"}, f"sum({sql_metric('c_balance')})", 2)
aggregate_query("agg_avg", {"agg": "avg", "column": "c_balance"}, f"avg({sql_metric('c_balance')})", 4)
aggregate_query("agg_min", {"agg": "min", "column": "c_balance"}, f"min({sql_metric('c_balance')})")
aggregate_query("agg_max", {"agg": "max", "column": "c_balance"}, f"max({sql_metric('c_balance')})")
aggregate_query("agg_default_rows", None, "count(*)")


@query(
    "agg_by_key",
    f"""select o_town as k, count(*) as orders, round(sum(o_totalprice), 2) as total
        from {ORDERS} where o_town is not null group by o_town""",
)
def agg_by_key(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "o",
            "dataset_id": "orders",
            "key": {"column": "o_address", "level": "emd"},
            "metrics": [{"name": "orders", "agg": "count"}, {"name": "total", "agg": "sum", "column": "o_totalprice"}],
        },
    ).withColumn("total", F.round("total", 2))


@query(
    "agg_by_key_cols",
    f"""select o_city as k, o_orderstatus, o_orderpriority, count(*) as orders
        from {ORDERS} where o_city is not null group by all""",
)
def agg_by_key_cols(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "o",
            "dataset_id": "orders",
            "key": {"column": "o_address", "level": "sgg"},
            "group_by": ["o_orderstatus", "O_ORDERPRIORITY"],
            "metrics": [{"name": "orders", "agg": "count"}],
        },
    )


@query(
    "agg_by_cols",
    """select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity, max(l_discount) as discount
       from lineitem group by all""",
)
def agg_by_cols(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "l",
            "dataset_id": "lineitem",
            "group_by": ["l_returnflag", "l_linestatus"],
            "metrics": [
                {"name": "n", "agg": "count"},
                {"name": "quantity", "agg": "sum", "column": "l_quantity"},
                {"name": "discount", "agg": "max", "column": "l_discount"},
            ],
        },
    )


@query(
    "agg_global",
    """select count(*) as n, count(distinct l_suppkey) as suppliers, sum(l_quantity) as quantity,
         count(*) filter (where l_returnflag = 'R') as returned from lineitem""",
)
def agg_global(spark, folder):
    return whole(
        spark,
        folder,
        {
            "alias": "l",
            "dataset_id": "lineitem",
            "metrics": [
                {"name": "n", "agg": "count"},
                {"name": "suppliers", "agg": "count_distinct", "column": "l_suppkey"},
                {"name": "quantity", "agg": "sum", "column": "l_quantity"},
                {"name": "returned", "agg": "count_if", "column": "l_returnflag", "value": "R"},
            ],
        },
    )


@query(
    "agg_conditional_pct",
    """select o_orderpriority, count(*) as orders,
         round(100.0 * sum(case when o_orderstatus = 'F' then 1 else 0 end)::double / count(*), 1) as finished_pct
       from orders group by o_orderpriority""",
)
def agg_conditional_pct(spark, folder):
    return (
        read(spark, folder, "orders")
        .groupBy("o_orderpriority")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            conditional_percent(F.col("o_orderstatus") == "F").alias("finished_pct"),
        )
    )
