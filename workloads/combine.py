"""Joins, ordering, set operations, result accounting and spec jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyweave import SourceTable, run_spec
from keyweave.operators.joins import tag_keys
from keyweave.operators.sets import distinct_keys, intersect_keys, keys_outside, symmetric_difference, union_best
from keyweave.operators.sorting import order_rows, top_k_per_group
from keyweave.operators.quality import dropped_detail
from keyweave.session import cut_lineage
from keyweave.plans.spec import Order
from workloads.core import whole
from workloads.inputs import (
    CUSTOMERS,
    GAZETTEER,
    NATIONS,
    ORDERS,
    SUPPLIERS,
    customers,
    nations,
    orders,
    read,
    suppliers,
    tables,
)
from workloads.registry import query


def counted(alias, dataset, column, level, name, **more):
    return {
        "alias": alias,
        "dataset_id": dataset,
        "key": {"column": column, "level": level},
        "metrics": [{"name": name, "agg": "count", "column": "*"}],
        **more,
    }


CUSTOMER_CITY = counted("c", "customer", "c_address", "sgg", "customers")
SUPPLIER_CITY = counted("s", "supplier", "s_address", "sgg", "suppliers")
ORDER_CITY = counted("o", "orders", "o_address", "sgg", "orders")
_C = f"(select c_city as k, count(*) as customers from {CUSTOMERS} group by 1)"
_S = f"(select s_city as k, count(*) as suppliers from {SUPPLIERS} group by 1)"
_O = f"(select o_city as k, count(*) as orders from {ORDERS} group by 1)"
_SP = "(select cast(s_nationkey as varchar) as k, count(*) as suppliers from supplier where s_acctbal > 5000 group by 1)"
_CN = "(select cast(c_nationkey as varchar) as k, count(*) as customers from customer group by 1)"


@query("join_inner2", f"select c.k as key, customers, suppliers from {_C} c join {_S} s on c.k = s.k")
def join_inner2(spark, folder):
    return whole(spark, folder, CUSTOMER_CITY, SUPPLIER_CITY)


RICH_SUPPLIERS = counted(
    "s", "supplier", "s_nationkey", "raw", "suppliers", filters=[{"column": "s_acctbal", "op": ">", "value": 5000}]
)


@query("join_left2", f"select c.k as key, customers, suppliers from {_CN} c left join {_SP} s on c.k = s.k")
def join_left2(spark, folder):
    return whole(spark, folder, counted("c", "customer", "c_nationkey", "raw", "customers"), RICH_SUPPLIERS, join="left")


@query(
    "join_inner3",
    f"""select c.k as key, customers, suppliers, orders from {_C} c join {_S} s on c.k = s.k
        join {_O} o on c.k = o.k""",
)
def join_inner3(spark, folder):
    return whole(spark, folder, CUSTOMER_CITY, SUPPLIER_CITY, ORDER_CITY)


@query(
    "join_left4",
    f"""select o.k as key, orders, customers, suppliers, urgent from
        (select o_town as k, count(*) as orders from {ORDERS} where o_town is not null group by 1) o
        left join (select c_town as k, count(*) as customers from {CUSTOMERS} group by 1) c on o.k = c.k
        left join (select s_town as k, count(*) as suppliers from {SUPPLIERS} group by 1) s on o.k = s.k
        left join (select o_town as k, count(*) as urgent from {ORDERS} where o_orderpriority = '1-URGENT'
          and o_totalprice > 400000 group by 1) u on o.k = u.k""",
)
def join_left4(spark, folder):
    urgent = counted("u", "orders", "o_address", "emd", "urgent")
    urgent["filters"] = [
        {"column": "o_orderpriority", "op": "=", "value": "1-URGENT"},
        {"column": "o_totalprice", "op": ">", "value": 400000},
    ]
    return whole(
        spark,
        folder,
        counted("o", "orders", "o_address", "emd", "orders"),
        counted("c", "customer", "c_address", "emd", "customers"),
        counted("s", "supplier", "s_address", "emd", "suppliers"),
        urgent,
        join="left",
    )


@query(
    "join_fanout",
    f"""select c.k as key, c_mktsegment, customers, o_orderstatus, orders
        from (select c_city as k, c_mktsegment, count(*) as customers from {CUSTOMERS} group by all) c
        join (select o_city as k, o_orderstatus, count(*) as orders from {ORDERS} group by all) o on c.k = o.k""",
)
def join_fanout(spark, folder):
    return whole(
        spark,
        folder,
        {**CUSTOMER_CITY, "group_by": ["c_mktsegment"]},
        {**ORDER_CITY, "group_by": ["o_orderstatus"]},
    )


@query(
    "join_levels",
    f"""select c.k as key, customers, named from {_C} c
        join (select n as k, count(*) as named from (select case when s_suppkey % 2 = 0
          then s_city else s_address end as n from {SUPPLIERS}) group by 1) s on c.k = s.k""",
)
def join_levels(spark, folder):
    named = suppliers(spark, folder).select(
        F.when(F.col("s_suppkey") % 2 == 0, GAZETTEER.city("s_address")).otherwise(F.col("s_address")).alias("s_place")
    )
    used = {**tables(spark, folder), "places": SourceTable(named)}
    return run_spec({"sources": [CUSTOMER_CITY, counted("s", "places", "s_place", "raw", "named")]}, used).unlimited


@query(
    "join_multicol",
    """select o.year, o.mt, orders, shipped from
        (select cast(year(o_orderdate) as varchar) as year, cast(month(o_orderdate) as varchar) as mt,
           count(*) as orders from orders group by all) o
        join (select cast(year(l_shipdate) as varchar) as year, cast(month(l_shipdate) as varchar) as mt,
           count(*) as shipped from lineitem group by all) l on o.year = l.year and o.mt = l.mt""",
)
def join_multicol(spark, folder):
    def monthly(table, column, name):
        parts = [F.year(column).cast("string").alias("year"), F.month(column).cast("string").alias("mt")]
        return read(spark, folder, table).groupBy(*parts).agg(F.count(F.lit(1)).alias(name))

    return monthly("orders", "o_orderdate", "orders").join(monthly("lineitem", "l_shipdate", "shipped"), ["year", "mt"])


@query(
    "join_expr",
    f"""select n.n_path as path, customers, balance from {NATIONS} n
        join (select 'ASIA|NATION_' || cast(c_nationkey as varchar) as e, count(*) as customers,
          max(c_acctbal) as balance from customer group by 1) c on c.e = n.n_path""",
)
def join_expr(spark, folder):
    counts = read(spark, folder, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("balance")
    )
    named = F.concat(F.lit("ASIA|NATION_"), F.col("c_nationkey").cast("string"))
    return nations(spark, folder).join(counts, F.col("n_path") == named).select(
        F.col("n_path").alias("path"), "customers", "balance"
    )


def town_keys(spark, folder):
    """Town keys of orders, customers and suppliers as one long table."""
    parts = [
        orders(spark, folder).select(GAZETTEER.town("o_address").alias("k")).distinct(),
        customers(spark, folder).select(GAZETTEER.town("c_address").alias("k")).distinct(),
        suppliers(spark, folder).select(GAZETTEER.town("s_address").alias("k")).distinct(),
    ]
    return tag_keys(parts, ALIASES)


ALIASES = ["o", "c", "s"]
_TAGGED = f"""tagged as (select 'o' as alias, 0 as position, o_town as k from {ORDERS} group by all
    union all select 'c', 1, c_town from {CUSTOMERS} group by all
    union all select 's', 2, s_town from {SUPPLIERS} group by all),
  common as (select k from tagged where k is not null group by k having count(distinct alias) = 3)"""


@query(
    "join_anti_dropped",
    f"with {_TAGGED} select alias, k from tagged where k is not null and k not in (select k from common)",
)
def join_anti_dropped(spark, folder):
    tagged = town_keys(spark, folder)
    return tagged.where("k is not null").join(intersect_keys(tagged, ALIASES), "k", "left_anti").select("alias", "k")


@query(
    "join_semi_matched",
    f"with {_TAGGED} select c_custkey, c_town as k from {CUSTOMERS} where c_town in (select k from common)",
)
def join_semi_matched(spark, folder):
    keyed = customers(spark, folder).select("c_custkey", GAZETTEER.town("c_address").alias("k"))
    return keyed.join(intersect_keys(town_keys(spark, folder), ALIASES), "k", "left_semi").select("c_custkey", "k")


# ---- ordering


@query(
    "srt_order_by",
    f"""select row_number() over (order by suppliers desc nulls last, customers asc nulls last, key asc nulls last) as pos,
          key, customers, suppliers from
        (select c.k as key, customers, suppliers from {_CN} c left join {_SP} s on c.k = s.k)""",
)
def srt_order_by(spark, folder):
    joined = whole(
        spark, folder, counted("c", "customer", "c_nationkey", "raw", "customers"), RICH_SUPPLIERS, join="left"
    )
    ordered = order_rows(joined, (Order("suppliers", True), Order("customers")), ["key"])
    # a total order over the sorted rows: partition id and offset need no single-task window
    return ranked(ordered, ["key", "customers", "suppliers"])


def ranked(ordered, columns):
    """Positions of globally sorted rows, computed per partition plus the rows before it."""
    # written once: both uses below must see the same partitions
    local = cut_lineage(
        ordered.select(*columns, F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33))
    )
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return local.join(before, "_part").select(
        (F.col("_at") - F.shiftleft(F.col("_part"), 33) + F.col("_before") + 1).cast("bigint").alias("pos"), *columns
    )


@query(
    "srt_limit",
    f"""select o_town as k, count(*) as orders from {ORDERS} where o_town is not null group by 1
        order by orders desc nulls last, k limit 25""",
)
def srt_limit(spark, folder):
    spec = {
        "sources": [counted("o", "orders", "o_address", "emd", "orders")],
        "order_by": [{"name": "orders", "desc": True}],
        "limit": 25,
    }
    return run_spec(spec, tables(spark, folder)).result


@query(
    "srt_topk_score",
    """select l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem
       group by l_partkey order by round(sum(l_extendedprice * (1 - l_discount)), 2) desc, l_partkey limit 20""",
)
def srt_topk_score(spark, folder):
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    scored = read(spark, folder, "lineitem").groupBy("l_partkey").agg(revenue.alias("revenue"))
    return scored.orderBy(F.col("revenue").desc_nulls_last(), "l_partkey").limit(20)


@query(
    "srt_topk_per_group",
    """select p_brand, p_partkey, p_retailprice, rank from (select p_brand, p_partkey, p_retailprice,
         row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part)
       where rank <= 3""",
)
def srt_topk_per_group(spark, folder):
    parts = read(spark, folder, "part").select("p_brand", "p_partkey", "p_retailprice")
    return top_k_per_group(parts, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey").asc()], 3)


# ---- sets


@query(
    "set_distinct_keys",
    f"select distinct o_town as k from {ORDERS} where o_orderstatus = 'F' and o_town is not null",
)
def set_distinct_keys(spark, folder):
    finished = orders(spark, folder).where(F.col("o_orderstatus") == "F")
    return distinct_keys(finished, GAZETTEER.town("o_address"))


@query("set_intersect", f"with {_TAGGED} select k from common")
def set_intersect(spark, folder):
    return intersect_keys(town_keys(spark, folder), ALIASES)


@query(
    "set_except",
    f"""with {_TAGGED} select alias, k from tagged t where k is not null and
        (select count(distinct alias) from tagged u where u.k = t.k) < 3""",
)
def set_except(spark, folder):
    return keys_outside(town_keys(spark, folder), ALIASES)


@query(
    "set_symdiff",
    """select k from (select distinct c_nationkey as k, 1 as side from customer where c_acctbal > 9900
         union all select distinct s_nationkey, 2 from supplier where s_acctbal > 5000)
       group by k having count(*) = 1""",
)
def set_symdiff(spark, folder):
    few = read(spark, folder, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).distinct()
    rich = read(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return symmetric_difference(tag_keys([few, rich], ["c", "s"]), "c", "s")


@query(
    "set_union_best",
    """select l_partkey, origin, best from (select *, row_number() over (partition by l_partkey
         order by best desc, origin) as r from (
           select l_partkey, 'price' as origin, max(l_extendedprice) as best from lineitem group by all
           union all select l_partkey, 'quantity', max(l_quantity * 2000) from lineitem group by all)) where r = 1""",
)
def set_union_best(spark, folder):
    items = read(spark, folder, "lineitem")
    by_price = items.groupBy("l_partkey").agg(F.lit("price").alias("origin"), F.max("l_extendedprice").alias("best"))
    by_quantity = items.groupBy("l_partkey").agg(
        F.lit("quantity").alias("origin"), F.max(F.col("l_quantity") * 2000).alias("best")
    )
    return union_best([by_price, by_quantity], ["l_partkey"], "best", ["origin"])


# ---- result accounting

LEFT_SPEC = {
    "sources": [counted("c", "customer", "c_nationkey", "raw", "customers"), RICH_SUPPLIERS],
    "join": "left",
    "order_by": [{"name": "customers", "desc": True}],
    "limit": 10,
}
_LEFT = f"select c.k as key, customers, suppliers from {_CN} c left join {_SP} s on c.k = s.k"


@query(
    "qua_null_rate",
    f"""select least(count(*), 10) as row_count, count(*) as full_row_count, 3 as column_count,
          round((count(*) * 3 - count(key) - count(customers) - count(suppliers))::double / (count(*) * 3), 4) as null_rate
        from ({_LEFT})""",
)
def qua_null_rate(spark, folder):
    return run_spec(LEFT_SPEC, tables(spark, folder)).stats


_DETAIL = f"""with {_TAGGED}, per as (select alias, any_value(position) as position,
    count(k) as own, count(*) filter (where k is null) as blank,
    count(*) filter (where k in (select k from common)) as matched from tagged group by alias),
  shown as (select alias, string_agg(k, ';' order by k) as dropped_keys from (select alias, k,
    row_number() over (partition by alias order by k) as r from tagged
    where k is not null and k not in (select k from common)) where r <= 30 group by alias)
  select position, alias, own + blank as keys, matched, round(matched::double / (own + blank), 3) as match_rate,
    own - matched + blank as dropped, coalesce(dropped_keys, '') as dropped_keys,
    case when blank > 0 then 'missing_normalized_key' when own > matched then 'unmatched_normalized_key' end as reason_code
  from per left join shown using (alias)"""


@query("qua_dropped_detail", _DETAIL)
def qua_dropped_detail(spark, folder):
    detail = dropped_detail(town_keys(spark, folder), ALIASES)
    return detail.withColumn("dropped_keys", F.array_join("dropped_keys", ";"))


@query(
    "qua_stop_gate",
    f"""with r as ({_LEFT.replace('left join', 'join')}), d as (
          select (select count(*) from r) as row_count,
            (select round((count(*) * 3 - count(key) - count(customers) - count(suppliers))::double / (count(*) * 3), 4)
             from r) as null_rate,
            (select count(*) from {_CN}) as nc, (select count(*) from {_SP}) as ns)
        select reason, case reason when 'row_drop' then kept when 'match_rate' then low end as observed,
          case when reason is not null then 0.5::double end as threshold,
          case when reason = 'match_rate' then 'Customers' end as title
        from (select *, case when kept < 0.5 then 'row_drop' when low < 0.5 then 'match_rate' end as reason
          from (select row_count::double / nc as kept, round(row_count::double / nc, 3) as low from d))""",
)
def qua_stop_gate(spark, folder):
    run = run_spec({**LEFT_SPEC, "join": "inner", "limit": 1000}, tables(spark, folder))
    baseline = run.keyed[0].agg(F.count(F.lit(1)).alias("baseline"))
    return run.gate(baseline).select("reason", "observed", "threshold", "title")


# ---- spec jobs

FLAGSHIP = {
    "sources": [
        {
            "alias": "c",
            "dataset_id": "customer",
            "key": {"column": "c_nationkey", "level": "raw"},
            "filters": [{"column": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]}],
            "metrics": [
                {"name": "customers", "agg": "count", "column": "*"},
                {"name": "avg_balance", "agg": "avg", "column": "c_acctbal"},
            ],
        },
        counted("s", "supplier", "s_nationkey", "raw", "suppliers"),
    ],
    "join": "inner",
    "order_by": [{"name": "customers", "desc": True}],
    "limit": 50,
}
_FLAGSHIP = """select c.k as key, customers, round(avg_balance, 4) as avg_balance, suppliers from
    (select cast(c_nationkey as varchar) as k, count(*) as customers, avg(c_acctbal) as avg_balance from customer
     where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1) c
    join (select cast(s_nationkey as varchar) as k, count(*) as suppliers from supplier group by 1) s on c.k = s.k
    order by customers desc, key limit 50"""


@query("job_run_spec", _FLAGSHIP)
def job_run_spec(spark, folder):
    return run_spec(FLAGSHIP, tables(spark, folder)).result.withColumn("avg_balance", F.round("avg_balance", 4))


# ---- two questions end to end


@query(
    "job_golden_like",
    f"""select c.k as key, customers, suppliers from
        (select c_city as k, count(*) as customers from {CUSTOMERS} where c_address like '%시%' and c_city is not null group by 1) c
        join {_S} s on c.k = s.k order by customers desc, key""",
)
def job_golden_like(spark, folder):
    """Cities by customers and suppliers, where the customers' address names a city (inner join and LIKE)."""
    named = counted("c", "customer", "c_address", "sgg", "customers")
    named["filters"] = [{"column": "c_address", "op": "like", "value": "%시%"}]
    spec = {"sources": [named, SUPPLIER_CITY], "join": "inner", "order_by": [{"name": "customers", "desc": True}]}
    return run_spec(spec, tables(spark, folder)).result


@query(
    "job_golden_towns",
    f"""select o.k as key, orders, customers, suppliers from
        (select o_town as k, count(*) as orders from {ORDERS} where o_town is not null group by 1) o
        join (select c_town as k, count(*) as customers from {CUSTOMERS} where c_town is not null group by 1) c on o.k = c.k
        join (select s_town as k, count(*) as suppliers from {SUPPLIERS} where s_town is not null group by 1) s on o.k = s.k""",
)
def job_golden_towns(spark, folder):
    """Towns by orders, customers and suppliers (inner join of three at town level)."""
    spec = {
        "sources": [
            counted("o", "orders", "o_address", "emd", "orders"),
            counted("c", "customer", "c_address", "emd", "customers"),
            counted("s", "supplier", "s_address", "emd", "suppliers"),
        ],
        "order_by": [{"name": "orders", "desc": True}],
    }
    return run_spec(spec, tables(spark, folder)).result
