"""Profiles, catalog, joinability and workflow links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyweave.functions.roles import role_by_name
from keyweave.operators import graph, profile, workflow
from keyweave.session import cut_lineage
from workloads.inputs import (
    CUSTOMERS,
    GAZETTEER,
    ORDERS,
    PLACES,
    SUPPLIERS,
    city_of,
    customers,
    orders,
    read,
    place,
    suppliers,
)
from workloads.registry import query

# ---- profiles: three tables in long form

_PROFILED = {
    "customer": (CUSTOMERS, "c_custkey", ["c_custkey", "c_address", "c_balance", "c_rich", "c_mktsegment"]),
    "supplier": (SUPPLIERS, "s_suppkey", ["s_address", "s_balance", "s_name"]),
    "part": ("part", "p_partkey", ["p_brand", "p_type", "p_size", "p_mail"]),
}


def _long_sql(wide: str, key: str, table: str, columns: list[str]) -> str:
    parts = []
    for at, name in enumerate(columns):
        value = "null" if name == "p_mail" else name
        parts.append(
            f"select '{table}' as dataset_id, {key} as pos, '{name}' as \"column\", {at} as column_pos,"
            f" coalesce(cast({value} as varchar), 'nan') as value from {wide}"
        )
    return " union all ".join(parts)


LONG = "long as (" + " union all ".join(_long_sql(w, k, t, c) for t, (w, k, c) in _PROFILED.items()) + ")"


def long_rows(spark, folder):
    frames = {
        "customer": customers(spark, folder),
        "supplier": suppliers(spark, folder),
        "part": read(spark, folder, "part").withColumn("p_mail", F.lit(None).cast("string")),
    }
    parts = [profile.unpivot_text(frames[t], t, key, columns) for t, (_, key, columns) in _PROFILED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FILLED = "value <> '' and lower(value) <> 'nan'"


def _profile_sql(source: str) -> str:
    return f"""counts as (select dataset_id, "column", column_pos, value, count(*) as n, min(pos) as first_pos
        from {source} group by all),
      common as (select dataset_id, "column", string_agg(value, ';' order by r) as samples from (
        select *, row_number() over (partition by dataset_id, "column" order by n desc, first_pos, value) as r
        from counts where {_FILLED}) where r <= 3 group by all)"""


_PROFILE_OUT = f"""select dataset_id, "column", sum(n)::bigint as rows,
     round(1 - coalesce(sum(n) filter (where {_FILLED}), 0)::double / greatest(sum(n), 1)::double, 3) as null_rate,
     count(*) filter (where {_FILLED}) as distinct_sample, coalesce(any_value(samples), '') as samples
   from counts left join common using (dataset_id, "column") group by dataset_id, "column" """


def _profile_out(counts):
    found = profile.column_profile(counts)
    return found.select(
        "dataset_id", "column", "rows", "null_rate", "distinct_sample", F.array_join("samples", ";").alias("samples")
    )


@query("pro_column_profile", f"with {LONG}, {_profile_sql('long')} {_PROFILE_OUT}")
def pro_column_profile(spark, folder):
    return _profile_out(profile.value_counts(long_rows(spark, folder)))


@query(
    "pro_role_name",
    """select p_partkey, case p_partkey % 9 when 0 then 'region_code' when 1 then 'region_name' when 2 then 'sido'
         when 3 then 'lat' when 4 then 'lon' when 5 then 'date' when 6 then 'year' when 7 then 'region_name' end as role
       from part""",
)
def pro_role_name(spark, folder):
    suffix = F.expr(
        "case p_partkey % 9 when 0 then '_SIGNGU_CD' when 1 then '_Addr' when 2 then 'Ctprvn' when 3 then '_위도'"
        " when 4 then '_lng' when 5 then '_ymd' when 6 then '연도' when 7 then '읍면동명' else '_price' end"
    )
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), suffix)
    return read(spark, folder, "part").select("p_partkey", role_by_name(name).alias("role"))


_RULED = f"""case when filled = 0 then 'text' when region > 0.5 then 'region_name' when c10 > 0.8 then 'region_code10'
  when c5 > 0.8 then 'region_code5' when sido > 0.7 then 'sido' when yr > 0.8 then 'year' when dt > 0.7 then 'date'
  when num > 0.9 then 'numeric' else 'text' end"""
_SHARES = f"""shares as (select dataset_id, "column", count(*) filter (where used) as filled,
    avg(regexp_matches(value, '{PLACES.replace(',', '|')}|군위군')::int) filter (where used) as region,
    avg(regexp_full_match(value, '[0-9]{{10}}')::int) filter (where used) as c10,
    avg(regexp_full_match(value, '[0-9]{{5}}')::int) filter (where used) as c5,
    avg(starts_with(value, '경상')::int) filter (where used) as sido,
    avg(regexp_full_match(value, '(19|20)[0-9]{{2}}')::int) filter (where used) as yr,
    avg(regexp_matches(value, '^[0-9]{{4}}[-/.]?[0-9]{{2}}[-/.]?[0-9]{{2}}')::int) filter (where used) as dt,
    avg(regexp_full_match(value, '-?[0-9,]+(\\.[0-9]+)?')::int) filter (where used) as num
  from (select *, value <> '' and value <> 'nan' as used from long) group by all)"""
_CONFIDENCE = """case r when 'region_name' then 0.95 when 'region_code10' then 0.9 when 'region_code5' then 0.85
  when 'sido' then 0.8 when 'year' then 0.85 when 'date' then 0.85 when 'numeric' then 0.8 else
  case when filled = 0 then 0.0 else 0.3 end end"""

# Long rows whose column names carry no hint, with values of every kind.
_KINDS = [
    f"case o_orderkey % 10 when 0 then '' else {city_of('o_orderkey')} end",
    "cast(o_totalprice as varchar(40))",
    "cast(year(o_orderdate) as varchar(4))",
    "substr(cast(o_orderdate as varchar(40)), 1, 10)",
    "o_orderstatus",
    "cast(10000 + o_custkey as varchar(40))",
    "cast(4711110100 + o_custkey as varchar(40))",
    "case when o_orderkey % 5 = 0 then '대한민국' else '경상북도' end",
    "''",
]
KINDS_LONG = "long as (" + " union all ".join(
    f"select 'orders' as dataset_id, o_orderkey as pos, 'v{i}' as \"column\", {i} as column_pos,"
    f" coalesce({kind}, 'nan') as value from orders"
    for i, kind in enumerate(_KINDS)
) + ")"


def kinds_long(spark, folder):
    wide = read(spark, folder, "orders").select(
        "o_orderkey", *[F.expr(kind).alias(f"v{i}") for i, kind in enumerate(_KINDS)]
    )
    return profile.unpivot_text(wide, "orders", "o_orderkey", [f"v{i}" for i in range(len(_KINDS))])


@query(
    "pro_role_values",
    f"""with {KINDS_LONG}, {_SHARES} select "column", r as role, {_CONFIDENCE}::double as role_confidence
        from (select *, {_RULED} as r from shares)""",
)
def pro_role_values(spark, folder):
    roles = profile.column_roles(kinds_long(spark, folder).withColumn("n", F.lit(1)), GAZETTEER)
    return roles.select("column", "role", "role_confidence")


@query(
    "pro_column_lists",
    f"""with {KINDS_LONG}, {_SHARES}, roles as (select *, {_RULED} as r from shares)
        select dataset_id,
          coalesce(string_agg("column", ';' order by "column") filter (where starts_with(r, 'region') or r = 'sido'), '') as region_columns,
          coalesce(string_agg("column", ';' order by "column") filter (where r in ('year', 'date')), '') as time_columns,
          coalesce(string_agg("column", ';' order by "column") filter (where r = 'numeric'), '') as numeric_columns
        from roles group by dataset_id""",
)
def pro_column_lists(spark, folder):
    roles = profile.column_roles(kinds_long(spark, folder).withColumn("n", F.lit(1)), GAZETTEER)
    lists = profile.column_lists(roles)
    return lists.select(
        "dataset_id",
        *[F.array_join(c, ";").alias(c) for c in ("region_columns", "time_columns", "numeric_columns")],
    )


# ---- catalog: the customers of every nation are one loaded table

_TABLE_ID = (
    "case when c_nationkey % 2 = 0 then 'd' || (c_nationkey % 5) || '_getNATION' || c_nationkey"
    " when c_nationkey < 5 then 'd' || c_nationkey else 'u' || c_nationkey end"
)
_CATALOG_COLUMNS = ["c_address", "c_balance", "c_rich", "c_since"]
_SINCE = "cast(1990 + c_custkey % 30 as varchar(4))"


def nation_long(spark, folder):
    wide = customers(spark, folder).withColumn("c_since", F.expr(_SINCE))
    return profile.unpivot_text(wide, F.expr(_TABLE_ID), "c_custkey", _CATALOG_COLUMNS)


def operations(spark, folder):
    """The operations a data service lists: five services, one operation per nation."""
    return read(spark, folder, "nation").select(
        F.concat(F.lit("d"), F.col("n_nationkey") % 5).alias("dataset_id"),
        F.col("n_nationkey").alias("position"),
        F.concat(F.lit("get_"), "n_name").alias("operation"),
        F.concat_ws(" ", F.lit("Customers of"), "n_name").alias("title"),
        F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("region "), "n_regionkey")).otherwise("").alias("category"),
        F.expr(f"case when n_nationkey % 4 = 0 then '경상북도 ' || {_place_of_nation()} else '경상북도' end").alias("provider"),
        F.array_remove(
            F.array(F.lit("customer"), F.col("n_name"), F.expr("case when n_nationkey % 2 = 0 then 'even' else '' end")), ""
        ).alias("keywords"),
        F.concat(F.lit("about "), "n_name").alias("description"),
        F.when(F.col("n_nationkey") % 3 > 0, F.array(field("c_address", F.col("n_name")), field("C_Balance", F.lit("money")), field("", F.lit("x"))))
        .otherwise(F.array(field("other", F.lit("y"))))
        .alias("fields"),
    )


def field(name, desc):
    return F.struct(F.lit(name).alias("name"), desc.alias("desc"))


def _place_of_nation() -> str:
    return place("n_nationkey")


_DEFINED = """(select case when n_nationkey % 2 = 0 then 'd' || (n_nationkey % 5) || '_getNATION' || n_nationkey
    when n_nationkey < 5 then 'd' || n_nationkey else 'u' || n_nationkey end as dataset_id,
    case n_nationkey % 5 when 0 then 'c_address' when 1 then 'C_BALANCE' when 2 then 'c rich' when 3 then 'Since'
      else 'other' end as item, n_name as "desc", n_nationkey % 5 as kind from nation)"""


@query(
    "src_coldef_merge",
    f"""select t.dataset_id, t.column, case when t.column = case kind when 0 then 'c_address' when 1 then 'c_balance'
          when 2 then 'c_rich' when 3 then 'c_since' end then "desc" else '' end as "desc"
        from (select distinct {_TABLE_ID} as dataset_id from customer) s
        join {_DEFINED} d on s.dataset_id = d.dataset_id
        join (select dataset_id, unnest(['c_address', 'c_balance', 'c_rich', 'c_since']) as "column" from {_DEFINED}) t
          on t.dataset_id = d.dataset_id""",
)
def src_coldef_merge(spark, folder):
    nation = read(spark, folder, "nation").withColumn("c_nationkey", F.col("n_nationkey"))
    item = F.expr(
        "case n_nationkey % 5 when 0 then 'c_address' when 1 then 'C_BALANCE' when 2 then 'c rich' when 3 then 'Since'"
        " else 'other' end"
    )
    known = nation.select(F.expr(_TABLE_ID).alias("dataset_id"), item.alias("item"), F.col("n_name").alias("desc"))
    columns = nation_long(spark, folder).select("dataset_id", "column").distinct()
    return profile.merge_definitions(columns, known).select("dataset_id", "column", "desc")


def entries(spark, folder):
    """Catalog entries with default region and measured region keys."""
    long = nation_long(spark, folder)
    profiles = profile.profile(long, GAZETTEER)
    listed = profile.catalog(profiles, operations(spark, folder))
    return listed.withColumn(
        "default_region", GAZETTEER.default_region(F.coalesce("provider", F.lit("")), F.coalesce("title", F.lit("")))
    )


_ENTRIES = f"""ops as (select 'd' || (n_nationkey % 5) as dataset_id, n_nationkey as position, 'get' || replace(n_name, '_', '') as op,
      'Customers of ' || n_name as title, case when n_nationkey % 3 > 0 then 'region ' || n_regionkey else '' end as category,
      case when n_nationkey % 4 = 0 then {_place_of_nation()} end as home,
      case when n_nationkey % 2 = 0 then 'even' end as even, n_name, n_nationkey % 3 > 0 as described from nation),
  meta as (select dataset_id || '_' || op as table_id, * from ops
    union all select dataset_id, * from ops where position < 5),
  loaded as (select {_TABLE_ID} as dataset_id, count(*) as rows,
      case when avg(regexp_full_match(c_balance, '-?[0-9,]+(\\.[0-9]+)?')::int) filter (where c_balance <> '') > 0.9
        then 'numeric' else 'text' end as balance_role from {CUSTOMERS} group by 1),
  entries as (select l.dataset_id, rows, balance_role, coalesce(m.dataset_id, l.dataset_id) as parent_dataset_id, title, category, home,
      even, n_name, coalesce(described, false) as described from loaded l left join meta m on l.dataset_id = m.table_id)"""


@query(
    "pro_catalog",
    f"""with {_ENTRIES} select dataset_id, rows, parent_dataset_id, title, category, home as default_region,
          'c_address;c_balance;c_rich;c_since' as columns, 'region_name;' || balance_role || ';text;year' as roles,
          case when described then n_name || ';money;;' else ';;;' end as descs from entries""",
)
def pro_catalog(spark, folder):
    return entries(spark, folder).select(
        "dataset_id",
        "rows",
        "parent_dataset_id",
        "title",
        "category",
        "default_region",
        F.array_join(F.col("columns.name"), ";").alias("columns"),
        F.array_join(F.col("columns.role"), ";").alias("roles"),
        F.array_join(F.col("columns.desc"), ";").alias("descs"),
    )


@query(
    "pro_catalog_totals",
    f"""with {_ENTRIES} select count(*) as datasets, count(*) * 4 as columns, count(*) as with_region,
          count(*) as with_time, count(*) filter (described) as with_definitions from entries""",
)
def pro_catalog_totals(spark, folder):
    return profile.catalog_totals(entries(spark, folder))


# ---- joinability: orders by priority and status, customers and suppliers by nation


def place_values(spark, folder):
    """Place texts of many datasets in long form."""
    o = orders(spark, folder).select(
        F.concat(F.lit("o_"), F.substring("o_orderpriority", 1, 1), "o_orderstatus").alias("dataset_id"),
        F.lit("o_address").alias("column"),
        F.col("o_address").alias("value"),
    )
    c = customers(spark, folder)
    c_id = F.concat(F.lit("c_"), F.col("c_nationkey").cast("string"))
    both = F.inline(
        F.array(
            F.struct(F.lit("c_address").alias("column"), F.col("c_address").alias("value")),
            F.struct(
                F.lit("c_alias").alias("column"),
                F.when(F.col("c_custkey") % 3 == 0, F.col("c_address")).otherwise(F.col("c_name")).alias("value"),
            ),
        )
    )
    s = suppliers(spark, folder).select(
        F.concat(F.lit("s_"), F.col("s_nationkey").cast("string")).alias("dataset_id"),
        F.lit("s_address").alias("column"),
        F.col("s_address").alias("value"),
    )
    return o.unionByName(c.select(c_id.alias("dataset_id"), both)).unionByName(s)


KEYS = f"""cells as (
    select 'o_' || substr(o_orderpriority, 1, 1) || o_orderstatus as dataset_id, 'o_' || o_orderstatus as parent,
      'o_address' as "column", o_city as city, o_town as town from {ORDERS}
    union all select 'c_' || c_nationkey, 'c_' || c_nationkey, 'c_address', c_city, c_town from {CUSTOMERS}
    union all select 'c_' || c_nationkey, 'c_' || c_nationkey, 'c_alias', case when c_custkey % 3 = 0 then c_city end,
      case when c_custkey % 3 = 0 then c_town end from {CUSTOMERS}
    union all select 's_' || s_nationkey, 's_' || s_nationkey, 's_address', s_city, s_town from {SUPPLIERS}),
  keyed as (select distinct 'sgg' as level, dataset_id, parent, "column", city as k from cells where city is not null
    union all select distinct 'emd', dataset_id, parent, "column", town from cells where town is not null),
  best as (select * from (select level, dataset_id, any_value(parent) as parent, "column", count(*) as n_keys,
      row_number() over (partition by level, dataset_id order by count(*) desc, "column") as r
    from keyed group by level, dataset_id, "column" having count(*) >= 3) where r = 1),
  chosen as (select level, dataset_id, parent, k, n_keys from keyed join best using (level, dataset_id, parent, "column"))"""

PAIRS = f"""{KEYS}, met as (select x.level, x.dataset_id as a, y.dataset_id as b, any_value(x.n_keys) as a_keys,
      any_value(y.n_keys) as b_keys, count(*) as matched
    from chosen x join chosen y on x.level = y.level and x.k = y.k and x.dataset_id < y.dataset_id and x.parent <> y.parent
    group by 1, 2, 3),
  pairs as (select *, round(matched::double / least(a_keys, b_keys), 3) as match_rate from met
    where matched::double / least(a_keys, b_keys) >= 0.30)"""


def chosen_keys(spark, folder):
    """Keys of the best column of every dataset and level."""
    keys = cut_lineage(graph.keys_by_level(place_values(spark, folder), GAZETTEER).distinct())
    best = graph.best_key_columns(keys)
    return keys.join(best, ["dataset_id", "level", "column"]).select("level", "dataset_id", "k")


def datasets(keys):
    ids = keys.select("dataset_id").distinct()
    last = F.substring("dataset_id", -1, 1)
    parent = F.when(F.col("dataset_id").startswith("o_"), F.concat(F.lit("o_"), last)).otherwise(F.col("dataset_id"))
    return ids.select("dataset_id", parent.alias("parent"))


def measured(spark, folder):
    keys = cut_lineage(chosen_keys(spark, folder))
    return graph.measure_pairs(keys, datasets(keys))


def measured_edges(spark, folder):
    """Measured pairs as stored edges, the way every later job reads them."""
    return graph.both_directions(cut_lineage(measured(spark, folder)))


@query(
    "gra_candidates",
    f"""with {_ENTRIES} select dataset_id, 'c_address' as "column" from entries""",
)
def gra_candidates(spark, folder):
    return graph.candidate_columns(entries(spark, folder), GAZETTEER).select("dataset_id", "column")


@query("gra_best_key", f'with {KEYS} select dataset_id, level, "column", n_keys from best')
def gra_best_key(spark, folder):
    return graph.best_key_columns(graph.keys_by_level(place_values(spark, folder), GAZETTEER))


@query(
    "gra_pairs",
    f"""with {PAIRS} select level, a, b, a_keys, b_keys, matched, match_rate, a_keys - matched as dropped_a,
          b_keys - matched as dropped_b, l."column" as a_col, r."column" as b_col,
          array_to_string(list_sort(list_intersect(ka, kb))[1:5], '|') as sample_matched,
          array_to_string(list_sort(list_concat(list_filter(ka, lambda x: not list_contains(kb, x)),
            list_filter(kb, lambda x: not list_contains(ka, x))))[1:5], '|') as sample_unmatched
        from pairs join (select level, dataset_id as a, list(k) as ka from chosen group by all) using (level, a)
        join (select level, dataset_id as b, list(k) as kb from chosen group by all) using (level, b)
        join (select level, dataset_id as a, "column" from best) l using (level, a)
        join (select level, dataset_id as b, "column" from best) r using (level, b)""",
)
def gra_pairs(spark, folder):
    keys = cut_lineage(graph.keys_by_level(place_values(spark, folder), GAZETTEER).distinct())
    best = cut_lineage(graph.best_key_columns(keys))
    chosen = cut_lineage(keys.join(best, ["dataset_id", "level", "column"]).select("level", "dataset_id", "k"))
    return graph.with_key_columns(graph.measure_pairs(chosen, datasets(chosen)), best)


EDGES = f"""{PAIRS}, edges as (select a, b as other, level, matched, match_rate from pairs
    union all select b, a, level, matched, match_rate from pairs)"""
_NEAR = """near as (select *, row_number() over (partition by a order by match_rate desc, matched desc, other, level desc) as rank
    from edges where match_rate >= {least})"""


@query(
    "gra_neighbors",
    f"""with {EDGES}, {_NEAR.format(least=0.5)}
        select a, other, level, matched, match_rate, rank from near where rank <= 10""",
)
def gra_neighbors(spark, folder):
    return graph.neighbours(measured_edges(spark, folder))


@query(
    "gra_totals",
    f"""with {PAIRS} select level, count(*) as pairs, count(*) filter (where match_rate = 1.0) as perfect
        from pairs group by level""",
)
def gra_totals(spark, folder):
    return graph.measured_totals(measured(spark, folder))


@query(
    "pro_service_stats",
    f"""with {EDGES} select (select count(distinct dataset_id) from cells) as datasets,
          (select count(distinct (dataset_id, "column")) from cells) as columns, (select count(*) from cells) as rows,
          (select count(*) from pairs) as joinable_pairs, (select count(distinct dataset_id) from best) as with_region_key""",
)
def pro_service_stats(spark, folder):
    long = place_values(spark, folder)
    best = graph.best_key_columns(graph.keys_by_level(long, GAZETTEER))
    listed = (
        long.groupBy("dataset_id", "column")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("dataset_id")
        .agg(F.sum("n").alias("rows"), F.collect_list("column").alias("columns"))
        .join(graph.region_keys(best), "dataset_id", "left")
        .withColumn("region_keys", F.coalesce("region_keys", F.create_map().cast("map<string,string>")))
    )
    return profile.service_totals(listed, measured_edges(spark, folder))


@query(
    "pro_dataset_card",
    f"""with {EDGES}, {_NEAR.format(least=0.3)},
          shape as (select dataset_id, count(distinct "column") as n_columns, count(*) as rows from cells group by 1)
        select dataset_id, rows, n_columns, coalesce(joinable_count, 0) as joinable_count, coalesce(neighbours, '') as neighbours
        from shape left join (select a as dataset_id, count(*) as joinable_count from edges group by 1) using (dataset_id)
        left join (select a as dataset_id, string_agg(other, ';' order by rank) as neighbours from near where rank <= 15
          group by 1) using (dataset_id)""",
)
def pro_dataset_card(spark, folder):
    empty = F.array().cast("array<string>")
    listed = (
        place_values(spark, folder)
        .groupBy("dataset_id", "column")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("dataset_id")
        .agg(F.sum("n").alias("rows"), F.collect_list("column").alias("columns"))
        .withColumns({"time_columns": empty, "numeric_columns": empty})
    )
    edges = measured_edges(spark, folder)
    cards = profile.dataset_cards(listed, edges, graph.neighbours(edges, 0.3, 15))
    return cards.select(
        "dataset_id", "rows", "n_columns", "joinable_count", F.array_join("neighbours", ";").alias("neighbours")
    )


@query(
    "pro_card_content",
    f"""with {_ENTRIES} select dataset_id, title, 'about ' || n_name as description, category,
          case when n_name is not null then concat_ws(';', 'customer', n_name, even) end as keywords, rows, 4 as n_columns,
          'c_since' as time_columns, case when balance_role = 'numeric' then 'c_balance' else '' end as numeric_columns
        from entries""",
)
def pro_card_content(spark, folder):
    none = spark.createDataFrame([], "a string, b string, rank int, other string, level string, match_rate double")
    cards = profile.dataset_cards(entries(spark, folder), none.select("a", "b"), none)
    lists = {n: F.array_join(n, ";") for n in ("keywords", "time_columns", "numeric_columns")}
    return cards.withColumns(lists).select(
        "dataset_id", "title", "description", "category", "keywords", "rows", "n_columns", "time_columns", "numeric_columns"
    )


@query(
    "gra_edges",
    f"""with {_ENTRIES} select 'ds:' || dataset_id as s, 'topic_of' as p, 'topic:' || category as o from entries where category <> ''
        union all select 'ds:' || dataset_id, 'tagged', 'kw:' || kw from
          (select dataset_id, unnest(['customer', n_name, even]) as kw from entries where n_name is not null) where kw is not null
        union all select 'ds:' || dataset_id, 'has_column', 'col:' || dataset_id || '.' || c from
          (select dataset_id, unnest(['c_address', 'c_balance', 'c_rich', 'c_since']) as c from entries)""",
)
def gra_edges(spark, folder):
    return graph.structure_edges(entries(spark, folder))


# ---- questions: every nation asks about three of its hits

SEEDS = """seeds as (select n_nationkey as question_id, 'c_' || n_nationkey as seed, 0 as seed_pos from nation
    union all select n_nationkey, 'o_' || (n_nationkey % 5 + 1) || 'F', 1 from nation),
  hits as (select n_nationkey as question_id, unnest([0, 1, 2, 3, 4, 5]) as candidate_pos,
    unnest(['c_' || n_nationkey, 'o_' || (n_nationkey % 5 + 1) || 'F', 's_' || (n_nationkey * 7 % 25),
      'c_' || ((n_nationkey + 3) % 25), 'o_' || (n_nationkey % 4 + 1) || 'O', 's_' || ((n_nationkey + 11) % 25)]) as candidate
    from nation),
  candidates as (select question_id, candidate, min(candidate_pos) as candidate_pos from hits group by all)"""


def questions(spark, folder):
    nation = read(spark, folder, "nation").select(F.col("n_nationkey").alias("question_id"))
    n = F.col("question_id")

    def named(prefix, number, suffix=""):
        return F.concat(F.lit(prefix), number.cast("string"), F.lit(suffix))

    hits = F.array(
        named("c_", n),
        named("o_", n % 5 + 1, "F"),
        named("s_", n * 7 % 25),
        named("c_", (n + 3) % 25),
        named("o_", n % 4 + 1, "O"),
        named("s_", (n + 11) % 25),
    )
    candidates = nation.select("question_id", F.posexplode(hits).alias("candidate_pos", "candidate"))
    seeds = candidates.where(F.col("candidate_pos") < 2).select(
        "question_id", F.col("candidate").alias("seed"), F.col("candidate_pos").alias("seed_pos")
    )
    return seeds, candidates


SETS = f"""{SEEDS}, strong as (select a, other, level, match_rate from edges where match_rate >= 0.5),
  pool as (select question_id, seed, seed_pos, s.level, c.candidate as c, match_rate,
      row_number() over (partition by question_id, seed, s.level order by match_rate desc, candidate_pos) as nth
    from seeds join strong s on s.a = seed join candidates c using (question_id)
    where s.other = c.candidate and c.candidate <> seed),
  grown as (
    select question_id, seed, seed_pos, level, [seed] as members, 1.0::double as low, 0 as nth from pool group by all
    union all
    select g.question_id, g.seed, g.seed_pos, g.level,
      case when fits then list_append(g.members, c) else g.members end,
      case when fits then least(g.low, worst) else g.low end, g.nth + 1
    from (select g.*, p.c, len(g.members) < 4 and (select count(*) from strong e where e.a = p.c and e.level = g.level
          and list_contains(g.members, e.other)) = len(g.members) as fits,
        (select min(e.match_rate) from strong e where e.a = p.c and e.level = g.level and list_contains(g.members, e.other)) as worst
      from grown g join pool p on g.question_id = p.question_id and g.seed = p.seed and g.level = p.level and p.nth = g.nth + 1) g),
  final as (select * from grown where (question_id, seed, level, nth) in
      (select question_id, seed, level, max(nth) from pool group by all)),
  ranked as (select *, row_number() over (partition by question_id, level, list_sort(members)
      order by round(low, 1) desc, len(members) desc, low desc, seed_pos) as copy from final),
  sets as (select *, row_number() over (partition by question_id order by round(low, 1) desc, len(members) desc, low desc,
      seed_pos, case level when 'sgg' then 0 else 1 end) as rank from ranked where copy = 1)"""


@query(
    "gra_joinable_sets",
    f"""with recursive {EDGES}, {SETS} select question_id, level, array_to_string(members, ';') as members,
          low as min_match_rate, rank from sets where rank <= 6""",
)
def gra_joinable_sets(spark, folder):
    seeds, candidates = questions(spark, folder)
    sets = graph.joinable_sets(seeds, candidates, measured_edges(spark, folder))
    return sets.select("question_id", "level", F.array_join("members", ";").alias("members"), "min_match_rate", "rank")


@query(
    "gra_best_combo",
    f"""with {EDGES}, {SEEDS}, cand as (select question_id, candidate_pos // 3 as part, candidate_pos % 3 + 1 as rank, candidate from hits),
        combos as (select x.question_id, x.candidate as a, y.candidate as b, x.rank as ra, y.rank as rb, v.level,
            coalesce(match_rate, 0) * (coalesce(matched, 0) / (coalesce(matched, 0) + 2.0))
              * (case when x.question_id % 2 = 0 and v.level <> 'emd' then 0.8 else 1.0 end)
              + 0.1 * ((x.rank = 1)::int + (y.rank = 1)::int) as score
          from cand x join cand y on x.question_id = y.question_id and x.part = 0 and y.part = 1 and x.candidate <> y.candidate
          cross join (select unnest(['sgg', 'emd']) as level) v
          left join edges e on e.a = x.candidate and e.other = y.candidate and e.level = v.level),
        winner as (select *, row_number() over (partition by question_id order by round(score, 12) desc, ra, rb,
            case level when 'sgg' then 0 else 1 end) as r from combos)
        select question_id, a || ';' || b as members from winner where r = 1""",
)
def gra_best_combo(spark, folder):
    _, candidates = questions(spark, folder)
    parts = candidates.select(
        "question_id",
        F.floor(F.col("candidate_pos") / 3).alias("part"),
        (F.col("candidate_pos") % 3 + 1).alias("rank"),
        F.col("candidate").alias("dataset_id"),
    )
    prefer = F.when(F.col("question_id") % 2 == 0, "emd")
    best = graph.best_combination(parts, measured_edges(spark, folder), prefer)
    return best.select("question_id", F.array_join("members", ";").alias("members"))


# ---- workflow links: the lines of an order are links between seven nodes

_LINKS = """links as (select l_orderkey as workflow_id, row_number() over (partition by l_orderkey order by l_linenumber,
      l_partkey, l_suppkey, l_extendedprice) as position, 'n' || l_linenumber as source, 'n' || (l_partkey % 7 + 1) as target
    from lineitem)"""


def links(spark, folder):
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("workflow_id"),
        F.row_number().over(in_order).alias("position"),
        F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("source"),
        F.concat(F.lit("n"), (F.col("l_partkey") % 7 + 1).cast("string")).alias("target"),
    )


@query(
    "gra_upstream",
    f"""with recursive {_LINKS}, walk as (select workflow_id, target as node from links where position = 1
          union select w.workflow_id, l.source from walk w join links l on l.workflow_id = w.workflow_id and l.target = w.node)
        select workflow_id, node from walk""",
)
def gra_upstream(spark, folder):
    all_links = links(spark, folder)
    starts = all_links.where("position = 1").select("workflow_id", F.col("target").alias("node"))
    return workflow.upstream(all_links, starts)


@query(
    "gra_link_check",
    f"""with recursive {_LINKS}, walk as (
          select workflow_id, position, source, target as node from links
          union select w.workflow_id, w.position, w.source, l.target from walk w join links l
            on l.workflow_id = w.workflow_id and l.source = w.node and l.position < w.position),
        looped as (select distinct workflow_id, position from walk where node = source)
        select workflow_id, position, case when source = target then 'self'
          when count(*) over (partition by workflow_id, source, target order by position) > 1 then 'duplicate'
          when (workflow_id, position) in (select workflow_id, position from looped) then 'cycle' end as rejection
        from links""",
)
def gra_link_check(spark, folder):
    return workflow.link_rejections(links(spark, folder)).select("workflow_id", "position", "rejection")


@query(
    "gra_set_links",
    f"""with recursive {EDGES}, {SETS}, placed as (select question_id, rank, level, unnest(members) as m, generate_subscripts(members, 1) as at
            from sets where rank <= 6)
        select x.question_id, x.rank, x.m as a, y.m as b, l."column" as a_col, r."column" as b_col, match_rate, matched
        from placed x join placed y on x.question_id = y.question_id and x.rank = y.rank and x.at < y.at
          join edges e on e.a = x.m and e.other = y.m and e.level = x.level
          join best l on l.level = x.level and l.dataset_id = x.m join best r on r.level = x.level and r.dataset_id = y.m""",
)
def gra_set_links(spark, folder):
    keys = cut_lineage(graph.keys_by_level(place_values(spark, folder), GAZETTEER).distinct())
    best = cut_lineage(graph.best_key_columns(keys))
    chosen = keys.join(best, ["dataset_id", "level", "column"]).select("level", "dataset_id", "k")
    pairs = cut_lineage(graph.with_key_columns(graph.measure_pairs(chosen, datasets(chosen)), best))
    seeds, candidates = questions(spark, folder)
    sets = cut_lineage(graph.joinable_sets(seeds, candidates, graph.both_directions(pairs)))
    return graph.set_links(sets, pairs).select("question_id", "rank", F.inline("links"))


@query(
    "gra_joinable_edges",
    f"""with {PAIRS} select 'ds:' || a as s, 'joinable_by' as p, 'ds:' || b as o, level as "on", l."column" as a_col, r."column" as b_col,
          matched, match_rate from pairs join best l using (level) join best r using (level) where l.dataset_id = a and r.dataset_id = b""",
)
def gra_joinable_edges(spark, folder):
    keys = cut_lineage(graph.keys_by_level(place_values(spark, folder), GAZETTEER).distinct())
    best = cut_lineage(graph.best_key_columns(keys))
    chosen = keys.join(best, ["dataset_id", "level", "column"]).select("level", "dataset_id", "k")
    return graph.joinable_edges(graph.with_key_columns(graph.measure_pairs(chosen, datasets(chosen)), best))


@query(
    "gra_nodes",
    f"""with {_ENTRIES} select 'ds:' || dataset_id as id, 'dataset' as type from entries
        union all select 'col:' || dataset_id || '.' || c, 'column' from
          (select dataset_id, unnest(['c_address', 'c_balance', 'c_rich', 'c_since']) as c from entries)""",
)
def gra_nodes(spark, folder):
    return graph.structure_nodes(entries(spark, folder))
