"""Suggested, default, recommended and stored jobs; stage reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from keyweave import SourceTable, run_spec
from keyweave.operators import graph
from keyweave.plans.runner import one_row_join
from keyweave.plans.stored import run_stored, stage_report
from keyweave.plans.suggest import job_specs, join_jobs, recommended_sets, run_join_jobs, single_jobs, single_specs, suggested_metrics
from keyweave.session import cut_lineage
from workloads.combine import _CN, _SP, LEFT_SPEC, RICH_SUPPLIERS, counted
from workloads.inputs import CUSTOMERS, GAZETTEER, ORDERS, SUPPLIERS, customers, orders, place, read, suppliers, tables
from workloads.measure import EDGES, SETS, datasets, measured_edges, place_values, questions
from workloads.registry import query

# ---- metrics: every part is a dataset with five columns named after it

_NAMES = (
    "case p_partkey % 4 when 0 then 'item_no' when 1 then 'seq' when 2 then 'wdate' else 'spm_row' end",
    "case p_partkey % 3 when 0 then 'width' when 1 then 'UnitPrice' else 'amount' end",
    "case p_partkey % 5 when 0 then 'total_cnt' when 1 then 'MAX_Temperature' when 2 then 'y' else 'length' end",
    "case p_partkey % 2 when 0 then 'open_yn' else 'a_very_long_flag_name_that_must_be_cut_somewhere' end",
)


@query(
    "job_suggest_metrics",
    f"""with c as (select p_partkey as dataset_id, {_NAMES[1]} as n1, {_NAMES[2]} as n2, {_NAMES[3]} as n3, p_brand from part),
          num as (select *, case when p2 and not p1 then n2 when n1 is not null then n1 else n2 end as best from (
            select *, n2 <> 'y' and regexp_matches(n2, '(?i)co|cnt|count|total|sum|amt|ar|area|price|rate') as p2,
              regexp_matches(n1, '(?i)co|cnt|count|total|sum|amt|ar|area|price|rate') as p1 from c)),
          hot as (select *, case when dataset_id % 10 < 5 and n2 = 'MAX_Temperature' then n2 else best end as m from num),
          agg as (select *, case when regexp_matches(m, '(?i)dnsty|avg|mean|rate|ratio|temp|tmprt|pm10|pm25|price|prc|unit') then 'avg' else 'sum' end as f from hot)
        select dataset_id, 0 as metric_pos, 'a_count' as name, 'count' as agg, '*' as "column", null::varchar as value from c
        union all select dataset_id, 1, 'a_' || f || '_' || m, f, m, null from agg
        union all select dataset_id, 2, 'a_' || n3 || '_Y', 'count_if', n3, 'Y' from c where p_brand <> 'Brand#1'""",
)
def job_suggest_metrics(spark, folder):
    part = read(spark, folder, "part").withColumnRenamed("p_partkey", "dataset_id")
    numeric = F.array().cast("array<string>")
    flags = F.when(F.col("p_brand") == "Brand#1", F.array(F.lit("Y"), F.lit("maybe"))).otherwise(F.array(F.lit("N"), F.lit("y")))
    cells = F.array(
        *[
            F.struct(
                F.lit(at).alias("column_pos"),
                F.expr(name.replace("p_partkey", "dataset_id")).alias("name"),
                F.lit("text" if at == 3 else "numeric").alias("role"),
                (flags if at == 3 else numeric).alias("samples"),
            )
            for at, name in enumerate(_NAMES)
        ]
    )
    columns = part.select("dataset_id", F.inline(cells))
    return suggested_metrics(columns, F.lit("a"), F.col("dataset_id") % 10 < 5)


_SINGLE = f"""with r as (select c_custkey as request_id, c_nationkey as dataset_id, case c_custkey % 3 when 0 then 'emd' when 1 then 'sgg' end as prefer,
            case when c_custkey % 5 = 0 then {place('c_custkey')} end as region,
            case when c_nationkey % 2 = 0 then {place('c_nationkey')} end as home,
            case when c_nationkey % 4 in (0, 1) then 'addr' end as city, case when c_nationkey % 4 in (0, 2) then 'town' end as town from customer),
          d as (select *, region is not null and home is null and city is not null as drill from r),
          l as (select *, case when drill then case when town is not null then 'emd' else 'sgg' end
              when prefer = 'emd' and town is not null then 'emd' when prefer = 'sgg' and city is not null then 'sgg'
              when home is not null and town is not null then 'emd' when city is not null then 'sgg' when town is not null then 'emd' end as level from d)
        select request_id, dataset_id, level, case level when 'sgg' then city when 'emd' then town end as key_column,
          case when drill then city end as filter_column, case when drill then '%' || substr(region, 1, length(region) - 1) || '%' end as filter_like,
          case when level is null then 'c0;c1;c2;c3;c4;c5;c6;c7;c8;c9;c10;c11;c12;c13' else '' end as raw_columns from l"""


@query("job_single_default", _SINGLE)
def job_single_default(spark, folder):
    return default_jobs(spark, folder).withColumn("raw_columns", F.coalesce(F.array_join("raw_columns", ";"), F.lit("")))


@query(
    "job_single_spec",
    f"""select request_id, dataset_id, '{{"sources":[{{"alias":"a","dataset_id":"' || dataset_id || '",' || case when level is null
            then '"columns":["' || replace(raw_columns, ';', '","') || '"]'
            else '"key":{{"column":"' || key_column || '","level":"' || level || '"}},'
              || case when filter_column is null then '' else '"filters":[{{"column":"' || filter_column || '","op":"like","value":"' || filter_like || '"}}],' end
              || '"metrics":[{{"name":"a_count","agg":"count","column":"*"}},{{"name":"a_sum_width","agg":"sum","column":"width"}}]' end || '}}]}}' as spec
        from ({_SINGLE})""",
)
def job_single_spec(spark, folder):
    columns = read(spark, folder, "nation").select(
        F.col("n_nationkey").alias("dataset_id"), F.lit(0).alias("column_pos"), F.lit("width").alias("name"), F.lit("numeric").alias("role"),
        F.array().cast("array<string>").alias("samples"),
    )
    return single_specs(default_jobs(spark, folder), suggested_metrics(columns, F.lit("")))


def default_jobs(spark, folder):
    requests = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_nationkey").alias("dataset_id"),
        F.expr("case c_custkey % 3 when 0 then 'emd' when 1 then 'sgg' end").alias("prefer"),
        F.expr(f"case when c_custkey % 5 = 0 then {place('c_custkey')} end").alias("region"),
    )
    n = F.col("n_nationkey")
    names = ["spm_row", "no", *[f"c{i}" for i in range(14)]]
    entries = read(spark, folder, "nation").select(
        n.alias("dataset_id"),
        F.create_map(
            F.lit("sgg"), F.when((n % 4).isin(0, 1), "addr"), F.lit("emd"), F.when((n % 4).isin(0, 2), "town")
        ).alias("region_keys"),
        F.expr(f"case when n_nationkey % 2 = 0 then {place('n_nationkey')} end").alias("default_region"),
        F.array(*[F.struct(F.lit(name).alias("name")) for name in names]).alias("columns"),
    )
    return single_jobs(requests, entries)


@query("job_recommend")
def job_recommend(spark, folder):
    """The recommended joins of every question as specs that can be run as they are."""
    seeds, candidates = questions(spark, folder)
    long = place_values(spark, folder)
    best = graph.best_key_columns(graph.keys_by_level(long, GAZETTEER))
    columns = long.select("dataset_id", F.col("column").alias("name")).distinct().select(
        "dataset_id", F.lit(0).alias("column_pos"), "name", F.lit("text").alias("role"), F.array().cast("array<string>").alias("samples")
    )
    sets = recommended_sets(seeds, candidates, measured_edges(spark, folder))
    jobs = join_jobs(sets, graph.region_keys(best), suggested_metrics(columns, F.lit("")))
    return job_specs(jobs)


def place_cells(spark, folder):
    """The datasets of ``place_values`` as cells of rows, with an amount and, for customers, a yes/no flag."""

    def cells(df, dataset, row, *columns):
        listed = F.array(*[F.struct(F.lit(name).alias("column"), value.cast("string").alias("value")) for name, value in columns])
        return df.select(dataset.alias("dataset_id"), F.col(row).alias("row_id"), F.inline(listed))

    alias = F.when(F.col("c_custkey") % 3 == 0, F.col("c_address")).otherwise(F.col("c_name"))
    o = orders(spark, folder)
    order_set = F.concat(F.lit("o_"), F.substring("o_orderpriority", 1, 1), "o_orderstatus")
    return (
        cells(o, order_set, "o_orderkey", ("o_address", F.col("o_address")), ("amt", F.col("o_totalprice")))
        .unionByName(
            cells(
                customers(spark, folder), F.concat(F.lit("c_"), F.col("c_nationkey").cast("string")), "c_custkey",
                ("c_address", F.col("c_address")), ("c_alias", alias), ("amt", F.col("c_acctbal")), ("rich", F.col("c_rich")),
            )
        )
        .unionByName(
            cells(
                suppliers(spark, folder), F.concat(F.lit("s_"), F.col("s_nationkey").cast("string")), "s_suppkey",
                ("s_address", F.col("s_address")), ("amt", F.col("s_acctbal")),
            )
        )
    )


@query(
    "job_run_recommended",
    f"""with recursive {EDGES}, {SETS}, members as (select question_id, rank, level, unnest(members) as dataset_id,
            generate_subscripts(members, 1) as nth, len(members) as size from sets where rank <= 6),
          named as (select 'o_' || substr(o_orderpriority, 1, 1) || o_orderstatus as dataset_id, 'o_address' as "column", o_city as city, o_town as town,
              o_totalprice::double as amt, null as rich from {ORDERS}
            union all select 'c_' || c_nationkey, 'c_address', c_city, c_town, c_acctbal::double, c_rich from {CUSTOMERS}
            union all select 'c_' || c_nationkey, 'c_alias', c_city, c_town, c_acctbal::double, c_rich from {CUSTOMERS} where c_custkey % 3 = 0
            union all select 's_' || s_nationkey, 's_address', s_city, s_town, s_acctbal::double, null from {SUPPLIERS}),
          summed as (select level, dataset_id, case level when 'sgg' then city else town end as key, count(*) as n, sum(amt) as amt,
              count(*) filter (rich = 'Y') as rich from named join best using (dataset_id, "column") group by all),
          shared as (select m.*, key, n, amt, rich, count(*) over (partition by question_id, rank, key) as have from members m
            join summed using (level, dataset_id) where key is not null)
        select question_id, rank, level, key, chr((96 + nth)::int) || '_' || u.metric as metric,
          round(case u.metric when 'count' then n when 'sum_amt' then amt else rich end, 2) as result
        from shared, (values ('count'), ('sum_amt'), ('rich_Y')) u(metric) where have = size and (u.metric <> 'rich_Y' or starts_with(dataset_id, 'c_'))""",
)
def job_run_recommended(spark, folder):
    """The joinable sets of every question as jobs with suggested metrics, all run together."""
    cells = place_cells(spark, folder)
    keys = cut_lineage(graph.keys_by_level(place_values(spark, folder), GAZETTEER).distinct())
    best = cut_lineage(graph.best_key_columns(keys))
    chosen = cut_lineage(keys.join(best, ["dataset_id", "level", "column"]).select("level", "dataset_id", "k"))
    edges = graph.both_directions(cut_lineage(graph.measure_pairs(chosen, datasets(chosen))))
    role = F.when(F.col("name") == "amt", "numeric").otherwise("text")
    samples = F.when(F.col("name") == "rich", F.array(F.lit("Y"), F.lit("N"))).otherwise(F.array().cast("array<string>"))
    columns = cells.select("dataset_id", F.col("column").alias("name")).distinct().select(
        "dataset_id", F.lit(0).alias("column_pos"), "name", role.alias("role"), samples.alias("samples")
    )
    seeds, candidates = questions(spark, folder)
    sets = cut_lineage(graph.joinable_sets(seeds, candidates, edges))
    jobs = join_jobs(sets, graph.region_keys(best), suggested_metrics(columns, F.lit("")))
    results = run_join_jobs(cut_lineage(jobs), cells, GAZETTEER)
    return results.select("question_id", "rank", "level", "key", F.explode("metrics").alias("metric", "result")).withColumn("result", F.round("result", 2))


STORED = {
    "spec": {
        "sources": [
            {
                "alias": "n",
                "dataset_id": "nation",
                "key": {"column": "n_path", "level": "raw"},
                "metrics": [{"name": "nations", "agg": "count"}],
            }
        ],
        "order_by": [{"name": "nations", "desc": True}],
        "limit": 1000,
    },
    "request": {"filters": {"place": "AFRICA"}},
    "schema": {"type": "object", "properties": {"place": {"column": "k"}, "n": {"from": "nations"}}},
}


@query(
    "job_stored_run",
    f"""select 'ASIA' || substr(n_path, 5) as k, count(*) as nations,
          '{{"place":"' || n_path || '","n":' || count(*) || '}}' as output, null::varchar as reason
        from (select r_name || '|' || n_name as n_path from nation join region on n_regionkey = r_regionkey)
        where starts_with(n_path, 'ASIA|') group by n_path""",
)
def job_stored_run(spark, folder):
    run = run_stored(json.dumps(STORED), {"request": {"filters": {"place": ["ASIA"]}}}, tables(spark, folder), GAZETTEER)
    return one_row_join(run.rows, run.signal.select("reason"))


@query(
    "qua_stage_report",
    f"""with c as (select * from {_CN}), s as (select * from {_SP}),
          j as (select c.k, customers, suppliers from c left join s on c.k = s.k),
          f as (select (select count(*) from c) as nc, (select count(*) from s) as ns, (select count(*) from j) as nj,
              (select count(*) from j where suppliers is null) as empty)
        select 0 as position, 'source' as kind, 'c' as stage, nc as row_count, 2 as columns, 0.0::double as null_percent,
            null::double as match_percent, null::varchar as reason, 'ok' as status from f
        union all select 1, 'source', 's', ns, 2, 0.0, null, null, 'ok' from f
        union all select 2, 'operation', 'operation', nj, 3, round(round(empty::double / (nj * 3), 4) * 100, 0),
            round(least(round(ns::double / nc, 3), 1.0) * 100, 0), case when empty::double / (nj * 3) > 0.2 then 'null_rate' end,
            case when empty::double / (nj * 3) > 0.2 then 'stopped' else 'ok' end from f
        union all select 3, 'output', 'output', least(nj, 10), 3, round(round(empty::double / (nj * 3), 4) * 100, 0), null,
            case when empty::double / (nj * 3) > 0.2 then 'null_rate' end,
            case when empty::double / (nj * 3) > 0.2 then 'skipped' else 'ok' end from f""",
)
def qua_stage_report(spark, folder):
    return stage_report(LEFT_SPEC, tables(spark, folder), GAZETTEER)


# ---- golden questions: the end-to-end shapes users ask for

_SEGMENT = f"(select c_city as k, count(*) as customers from {CUSTOMERS} where c_mktsegment like 'B%' group by 1)"


@query(
    "job_golden_ratio",
    """select e.event_type, users, peak, kinds, round(100.0::double * users / (peak + kinds), 1) as ratio from
         (select event_type, count(distinct user_id) as users, max(value) as peak from events where value > 10 group by 1) e
         join (select 'event|' || event_type as e, count(*) as kinds from events where event_type <> 'error' group by 1) k
           on k.e = 'event|' || e.event_type""",
)
def job_golden_ratio(spark, folder):
    events = read(spark, folder, "events")
    peaks = (
        events.where("value > 10").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.max("value").alias("peak"))
    )
    kinds = events.where("event_type <> 'error'").groupBy(F.concat(F.lit("event|"), "event_type").alias("e")).agg(
        F.count(F.lit(1)).alias("kinds")
    )
    joined = peaks.join(kinds, F.col("e") == F.concat(F.lit("event|"), F.col("event_type")))
    ratio = F.round(F.lit(100.0) * F.col("users") / (F.col("peak") + F.col("kinds")), 1)
    return joined.select("event_type", "users", "peak", "kinds", ratio.alias("ratio"))


@query(
    "job_golden_sums",
    """select p_brand, parts, sizes, lines from (select p_brand, count(*) as parts, sum(p_size)::bigint as sizes from part group by 1)
         join (select p_brand as b, count(*) as lines from lineitem join part on l_partkey = p_partkey group by 1) on p_brand = b""",
)
def job_golden_sums(spark, folder):
    part = read(spark, folder, "part")
    sizes = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("sizes"))
    # lines are counted per part before they meet the brands
    per_part = read(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    lines = (
        per_part.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(F.sum("n").alias("lines"))
    )
    return sizes.join(lines, "p_brand")


@query(
    "job_golden_coalesce",
    f"""select c.k as key, customers, coalesce(suppliers, 0) as suppliers from {_SEGMENT} c
        left join {_SP.replace('cast(s_nationkey as varchar)', place('s_nationkey'))} s on c.k = s.k where c.k is not null""",
)
def job_golden_coalesce(spark, folder):
    named = tables(spark, folder)
    rich = named["supplier"].df.withColumn("s_home", F.expr(place("s_nationkey")))
    segment = counted("c", "customer", "c_address", "sgg", "customers", filters=[{"column": "c_mktsegment", "op": "like", "value": "B%"}])
    sparse = {**RICH_SUPPLIERS, "key": {"column": "s_home", "level": "sgg"}}
    run = run_spec({"sources": [segment, sparse], "join": "left"}, {**named, "supplier": SourceTable(rich)}, GAZETTEER)
    return run.unlimited.withColumn("suppliers", F.coalesce("suppliers", F.lit(0)))
