"""Text files, landed responses and service descriptions derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyweave.session import checkpoint_folder
from keyweave.sources import endpoints, responses, text_tables
from workloads.inputs import SUPPLIERS, read, suppliers
from workloads.registry import query

# ---- text files

_CELL = "case when s_suppkey % 7 = 0 then 'line \"one\",' || chr(10) || '둘' when s_suppkey % 7 = 1 then '' else s_address end"
_CHARSETS = {"utf-8-sig": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}


def write_encoded(spark, folder):
    """Every supplier once per encoding, as CSV part files with a header."""
    target = f"{checkpoint_folder(spark)}/keyweave/{uuid.uuid4().hex}"
    rows = suppliers(spark, folder).select(
        F.col("s_suppkey").alias(" id"), F.col("s_name").alias("1st name"), F.expr(_CELL).alias("주소 "), F.col("s_address").alias("주소")
    )
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    paths = []
    for kind, charset in _CHARSETS.items():
        rows.repartition(2, " id").write.options(header=True, encoding=charset, escape='"').csv(f"{target}/{kind}")
        paths += spark.read.text(f"{target}/{kind}").inputFiles()
    return paths, target


def _kind(path):
    return F.element_at(F.split(path, "/"), -2)


@query(
    "src_read_encoded",
    f"""select kind, s_suppkey::varchar as id, s_name as c_1st_name, {_CELL} as cell, s_address as address
        from {SUPPLIERS}, (select unnest(['utf-8-sig', 'cp949', 'euc-kr']) as kind)""",
)
def src_read_encoded(spark, folder):
    paths, target = write_encoded(spark, folder)
    _, tables = text_tables.load_tables(spark, paths, target + "_tables")
    parts = [
        t.df.select(
            _kind(F.lit(t.path)).alias("kind"), "id", "c_1st_name", F.col("`주소`").alias("cell"), F.col("`주소_1`").alias("address")
        )
        for t in tables
        if t.df is not None
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "src_load_report",
    """select kind, 4 as cols, count(*) as rows, 0::bigint as failed from supplier,
         (select unnest(['utf-8-sig', 'cp949', 'euc-kr']) as kind) group by kind""",
)
def src_load_report(spark, folder):
    paths, target = write_encoded(spark, folder)
    report, _ = text_tables.load_tables(spark, paths, target + "_tables")
    return report.groupBy(_kind(F.col("path")).alias("kind")).agg(
        F.max("cols").alias("cols"), F.sum("rows").alias("rows"), F.count_if(~F.col("ok")).alias("failed")
    )


_NAME = (
    "case p_partkey % 6 when 0 then ' ' || p_name || '  (A)' when 1 then p_size || ' ' || p_type when 2 then '%%'"
    " when 3 then '가격 ' || p_type when 4 then p_type || '-' || p_size else p_name end"
)


@query(
    "src_clean_columns",
    f"""with n as (select p_brand as file, p_partkey as position, {_NAME} as name from part),
          c as (select *, regexp_replace(regexp_replace(trim(name), '\\s+', '_', 'g'), '[^0-9A-Za-z가-힣_]', '', 'g') as x from n),
          d as (select *, case when x = '' then 'col' when regexp_matches(x, '^[0-9]') then 'c_' || x else x end as y from c),
          e as (select *, row_number() over (partition by file, y order by position) - 1 as copy from d)
        select file, position, name, case when copy > 0 then y || '_' || copy else y end as "column" from e""",
)
def src_clean_columns(spark, folder):
    headers = read(spark, folder, "part").select(
        F.col("p_brand").alias("file"), F.col("p_partkey").alias("position"), F.expr(_NAME).alias("name")
    )
    return text_tables.clean_names(headers)


@query(
    "src_drop_empty_columns",
    "select c_custkey, case when c_custkey = 7 then c_name end as c_rare from customer",
)
def src_drop_empty_columns(spark, folder):
    wide = read(spark, folder, "customer").select(
        "c_custkey",
        F.lit(None).cast("string").alias("c_never"),
        F.when(F.col("c_custkey") == 7, F.col("c_name")).alias("c_rare"),
        F.when(F.col("c_custkey") < 0, 1).alias("c_impossible"),
    )
    return text_tables.drop_empty_columns(wide)


# ---- landed responses: forty services list the orders of their customers, page by page

PAGE = 60
_JOB = "o_custkey % 40 as job, o_orderkey // 4000 + 1 as page"


def landed(spark, folder):
    """One body per job and page in five shapes."""
    orders = read(spark, folder, "orders").select(
        (F.col("o_custkey") % 40).alias("job"),
        (F.floor(F.col("o_orderkey") / 4000) + 1).cast("int").alias("page"),
        "o_orderkey",
        "o_orderstatus",
    )
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"))
    paged = orders.groupBy("job", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    total = F.concat(F.lit("1,"), F.lpad((F.col("job") * 10).cast("string"), 3, "0"))

    def envelope(code, item_column):
        header = F.struct(F.lit(code).alias("resultCode"), F.lit("as told").alias("resultMsg"))
        body = F.struct(total.alias("totalCount"), F.struct(item_column.alias("item")).alias("items"))
        return F.to_json(F.struct(F.struct(header.alias("header"), body.alias("body")).alias("response")))

    xml_items = F.array_join(
        F.transform("items", lambda i: F.concat(F.lit("<item><id>"), i["id"].cast("string"), F.lit("</id><st>"), i["st"], F.lit("</st></item>"))), ""
    )
    xml = F.concat(
        F.lit(' <n:response xmlns:n="urn:x"><header><resultCode>00</resultCode></header><body><items>'),
        xml_items,
        F.lit("</items><totalCount>"),
        total,
        F.lit("</totalCount></body></n:response>"),
    )
    shape = (F.col("job") + F.col("page")) % 5
    error = F.to_json(
        F.struct(F.struct(F.struct(F.lit("30").alias("resultCode"), F.lit("NO KEY").alias("resultMsg")).alias("header")).alias("response"))
    )
    body = (
        F.when(shape == 0, envelope("00", F.col("items")))
        .when(shape == 1, xml)
        .when(shape == 2, envelope("99", F.col("items")[0]))
        .when(shape == 3, error)
        .otherwise(F.concat(F.lit("busy "), F.col("job").cast("string")))
    )
    return paged.select("job", "page", body.alias("body"))


def parsed(spark, folder):
    return landed(spark, folder).withColumn("r", responses.read_body("body"))


_PAGED = f"paged as (select {_JOB}, count(*) as n, min(o_orderkey) as first from orders group by all)"


@query(
    "src_parse_body",
    f"""with {_PAGED} select job, page, case (job + page) % 5 when 1 then 'xml' when 4 then null else 'json' end as format,
          case when (job + page) % 5 = 4 then 'neither JSON nor XML: busy ' || job end as error from paged""",
)
def src_parse_body(spark, folder):
    return parsed(spark, folder).select("job", "page", "r.format", "r.error")


@query(
    "src_find_records",
    f"""select job, page, id::varchar as id, st from (select {_JOB}, o_orderkey as id, o_orderstatus as st,
          row_number() over (partition by o_custkey % 40, o_orderkey // 4000 order by o_orderkey) as r from orders)
        where (job + page) % 5 in (0, 1) or ((job + page) % 5 = 2 and r = 1)""",
)
def src_find_records(spark, folder):
    # a plain explode makes Spark filter by the size of the records first, and so parse every body a second time
    exploded = parsed(spark, folder).select("job", "page", F.explode_outer("r.records").alias("record")).where("record is not null")
    return exploded.select(
        "job", "page", F.get_json_object("record", "$.id").alias("id"), F.get_json_object("record", "$.st").alias("st")
    )


@query(
    "src_find_total",
    f"with {_PAGED} select job, page, case when (job + page) % 5 < 3 then 1000 + job * 10 end as total from paged",
)
def src_find_total(spark, folder):
    return parsed(spark, folder).select("job", "page", "r.total")


@query(
    "src_error_envelope",
    f"""with {_PAGED} select job, page, case (job + page) % 5 when 3 then '30:NO KEY' end as batch_error,
          case (job + page) % 5 when 3 then '30: NO KEY' when 2 then '99: as told' end as live_error from paged""",
)
def src_error_envelope(spark, folder):
    batch = responses.error_message(F.col("r.json"), F.size("r.records"))
    return parsed(spark, folder).select(
        "job", "page", batch.alias("batch_error"), responses.error_message(F.col("r.json")).alias("live_error")
    )


@query(
    "src_flatten_record",
    """select o_orderkey::varchar as id, o_custkey::varchar as cust_key, o_orderstatus as cust_geo_st,
         '[' || o_orderkey || ', "' || o_orderstatus || '"]' as tags, '' as note from orders""",
)
def src_flatten_record(spark, folder):
    record = F.concat(
        F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "cust": {"key": '), F.col("o_custkey").cast("string"),
        F.lit(', "geo": {"st": "'), "o_orderstatus", F.lit('"}}, "tags": ['), F.col("o_orderkey").cast("string"), F.lit(',"'),
        "o_orderstatus", F.lit('"], "note": null}'),
    )
    flat = read(spark, folder, "orders").select(responses.flatten_record(record).alias("m"))
    return flat.select(*[F.col("m")[name].alias(name) for name in ("id", "cust_key", "cust_geo_st", "tags", "note")])


@query(
    "src_union_columns",
    """select o_orderkey, case when o_orderkey % 3 < 2 then o_orderstatus else '' end as st,
         case when o_orderkey % 3 = 1 then o_orderpriority else '' end as pr,
         case when o_orderkey % 3 = 2 then o_custkey::varchar else '' end as cu from orders""",
)
def src_union_columns(spark, folder):
    kind = F.col("o_orderkey") % 3
    record = (
        F.when(kind == 0, F.create_map(F.lit("st"), F.col("o_orderstatus")))
        .when(kind == 1, F.create_map(F.lit("pr"), F.col("o_orderpriority"), F.lit("st"), F.col("o_orderstatus")))
        .otherwise(F.create_map(F.lit("cu"), F.col("o_custkey").cast("string")))
    )
    records = read(spark, folder, "orders").select("o_orderkey", record.alias("record"))
    return responses.union_columns(records, ["o_orderkey"])


def paged_records(spark, folder):
    """Pages of forty jobs: totals known, unknown or too small, a failing page, a repeating page."""
    orders = read(spark, folder, "orders").select(
        (F.col("o_custkey") % 40).alias("job"), (F.floor(F.col("o_orderkey") / 4000) + 1).cast("int").alias("page"), "o_orderkey"
    )
    paged = orders.groupBy("job", "page").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    job, page = F.col("job"), F.col("page")
    ids = F.when(job % 8 == 4, F.sequence(job, job + PAGE - 1)).otherwise(F.col("ids"))
    return paged.select(
        "job",
        "page",
        F.transform(ids, lambda i: i.cast("string")).alias("records"),
        F.when(job % 8 == 1, F.lit(150)).when(job % 8 == 2, F.lit(10_000_000)).cast("bigint").alias("total"),
        F.when((job % 8 == 3) & (page == 3), "30:NO KEY").alias("error"),
    )


@query(
    "src_assemble_pages",
    f"""with p as (select {_JOB}, count(*) as size from orders group by all),
          q as (select job, page, case when job % 8 = 4 then {PAGE} else size end as n,
              case job % 8 when 1 then 150 when 2 then 10000000 end as total, job % 8 = 3 and page = 3 as failed from p),
          j as (select job, case when job % 8 = 4 then {PAGE} else coalesce(sum(n) filter (where not failed), 0) end::bigint as rows,
              max(total) as total_count, case when job % 8 = 4 then count(*) - 1 else 0 end as repeated_pages,
              count(*) filter (where failed) as failed_pages, max(case when failed then 'page3: 30:NO KEY' end) as error from q group by job)
        select job, rows, total_count, rows >= total_count as complete, repeated_pages, failed_pages, error, rows as records from j""",
)
def src_assemble_pages(spark, folder):
    records, jobs = responses.assemble_pages(paged_records(spark, folder))
    counted = records.groupBy("job").agg(F.count(F.lit(1)).alias("records"))
    return jobs.join(counted, "job", "left").withColumn("records", F.coalesce("records", F.lit(0)))


_STATUS = "case when o_orderkey % 4 = 0 then 'fail' when o_orderkey % 4 = 1 then 'skip' else 'ok' end"
_ERROR = (
    "case when o_orderkey % 4 = 0 then case when o_custkey % 3 = 0 then null else 'page' || (o_custkey % 30) ||"
    " ': the service answered with an error that is long ' || o_orderkey end end"
)


@query(
    "src_ingest_report",
    f"""with j as (select {_STATUS} as status, o_custkey as rows, {_ERROR} as error from orders)
        select 'status' as kind, status as name, count(*) as jobs, sum(rows)::bigint as rows from j group by status
        union all select * from (select 'reason', coalesce(error, '') as name, count(*) as n, 0 from j
          where status = 'fail' group by 2)""",
)
def src_ingest_report(spark, folder):
    jobs = read(spark, folder, "orders").select(
        F.expr(_STATUS).alias("status"), F.col("o_custkey").alias("rows"), F.expr(_ERROR).alias("error")
    )
    return responses.ingest_report(jobs)


@query(
    "src_snapshot_replay",
    """with s as (select event_type as service, user_id % 7 as operation, event_id, value from events where event_id % 3 = 0 and user_id % 7 <> 5),
         latest as (select * from (select *, row_number() over (partition by service, operation order by event_id desc) as r from s) where r = 1),
         calls as (select event_id as call_id, event_type as service, user_id % 7 as operation,
           [200, 502, 503, 404, 504][event_id % 5 + 1] as status, 'live ' || event_id as response from events)
       select call_id, service, operation, status, case when status = 200 then calls.response
           when status <> 404 and l.event_id is not null then 'stored ' || l.event_id end as response,
         case when status = 200 then 'live' when status <> 404 and l.event_id is not null then 'snapshot' end as source,
         case when status in (502, 503, 504) and l.event_id is not null then status end as replayed_error
       from calls left join latest l using (service, operation)""",
)
def src_snapshot_replay(spark, folder):
    events = read(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("service"), (F.col("user_id") % 7).alias("operation")
    )
    snapshots = events.where("event_id % 3 = 0 and operation <> 5").select(
        "service",
        "operation",
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("saved_at"),
        F.create_map(F.lit("ServiceKey"), F.lit("secret"), F.lit("k"), F.col("event_id").cast("string")).alias("payload"),
        F.concat(F.lit("stored "), F.col("event_id").cast("string")).alias("response"),
    )
    status = F.get(F.array(*[F.lit(s) for s in (200, 502, 503, 404, 504)]), (F.col("event_id") % 5).cast("int"))
    calls = events.select(
        F.col("event_id").alias("call_id"), "service", "operation", status.alias("status"),
        F.concat(F.lit("live "), F.col("event_id").cast("string")).alias("response"),
    )
    return responses.replay(calls, snapshots)


# ---- endpoints


@query(
    "src_endpoint_path",
    """select page_id, rtrim(lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1)), '/') as endpoint,
         lower(regexp_replace(url, '[\\s_\\-·,()\\[\\]]', '', 'g')) as comparable from pages""",
)
def src_endpoint_path(spark, folder):
    return read(spark, folder, "pages").select(
        "page_id", endpoints.endpoint_path(F.concat(F.lit(" "), "url", F.lit("\n"))).alias("endpoint"), endpoints.comparable("url").alias("comparable")
    )


_URL = "case when s_suppkey % 11 = 0 then 'none' else 'https://api' || s_nationkey || '.example.org/svc/List' || (s_suppkey % 3) || '/' end"


@query(
    "src_match_pages",
    """with c as (select s_suppkey, s_nationkey, i, (s_suppkey * 3 + i) % 50 as page_id,
           case when i % 3 = 2 then 'Info of ' || s_name when i = 4 then 'List Nation ' || s_nationkey else 'other ' || i end as title,
           case when i = 6 and s_suppkey % 2 = 0 then 'api' || s_nationkey || '.example.org/svc/list' || (s_suppkey % 3)
             when i = 3 and s_suppkey % 5 = 0 then 'API' || s_nationkey || '.example.org/svc' else '' end as host,
           case when i = 1 and s_suppkey % 4 = 1 then 'https://api' || s_nationkey || '.example.org/svc/list' || (s_suppkey % 3) || '/get' else '' end as req
           from supplier, (select unnest(range(0, 8)) as i)),
         o as (select *, row_number() over (partition by s_suppkey order by contains(lower(title), lower(name)) desc,
             contains(replace(lower(title), ' ', ''), 'nation' || s_nationkey) desc, i) as at_ from (select *, 'Supplier#' || lpad(s_suppkey::varchar, 9, '0') as name from c)),
         k as (select *, 'api' || s_nationkey || '.example.org/svc/list' || (s_suppkey % 3) as target from o),
         m as (select *, case when lower(host) = target or starts_with(regexp_replace(req, '^https://', ''), target)
             or (host <> '' and starts_with(target, lower(host)) and contains(lower(host), 'list' || (s_suppkey % 3))) then 0
             when contains(lower(title), lower(name)) then 1 end as kind from k),
         b as (select * from (select *, row_number() over (partition by s_suppkey order by kind, at_) as r from m where kind is not null) where r = 1)
       select s.s_suppkey as endpoint_id, case when s.s_suppkey % 11 > 0 then page_id end as page_id,
         case when s.s_suppkey % 11 = 0 then 'no_endpoint' when kind = 0 then 'host' when kind = 1 then 'title' else 'none' end as match
       from supplier s left join b using (s_suppkey)""",
)
def src_match_pages(spark, folder):
    base = read(spark, folder, "supplier").select(
        "s_suppkey", "s_nationkey", "s_name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")
    )
    candidates = base.select(
        F.col("s_suppkey").alias("endpoint_id"),
        F.col("i").alias("position"),
        ((F.col("s_suppkey") * 3 + F.col("i")) % 50).alias("page_id"),
        F.expr("case when i % 3 = 2 then 'Info of ' || s_name when i = 4 then 'List Nation ' || s_nationkey else 'other ' || i end").alias("title"),
        F.expr(
            "case when i = 6 and s_suppkey % 2 = 0 then 'api' || s_nationkey || '.example.org/svc/list' || (s_suppkey % 3)"
            " when i = 3 and s_suppkey % 5 = 0 then 'API' || s_nationkey || '.example.org/svc' else '' end"
        ).alias("host"),
        F.expr(
            "case when i = 1 and s_suppkey % 4 = 1 then 'https://api' || s_nationkey || '.example.org/svc/list' || (s_suppkey % 3) || '/get' else '' end"
        ).alias("request_url"),
    )
    asked = read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("endpoint_id"),
        F.expr("'Office of Nation' || s_nationkey").alias("org"),
        F.col("s_name").alias("name"),
        F.expr(_URL).alias("url"),
    )
    return endpoints.match_pages(asked, candidates)


@query(
    "src_listable_ops",
    """with s as (select s_suppkey, s_nationkey, case when s_suppkey % 4 = 3 then 'none' when s_suppkey % 2 = 0 then 'host' else 'title' end as match,
           s_suppkey % 5 > 0 as titled, s_suppkey % 3 > 0 as second, s_suppkey % 7 > 0 as sampled from supplier),
         ok as (select * from s where match = 'host' or (match = 'title' and titled)),
         ops as (select s_suppkey, 'getA' as op, '' as base from ok where sampled
           union all select s_suppkey, 'listB', 'q=5' from ok where second)
       select 'd' || s_suppkey as dataset_id, case when count(*) over (partition by s_suppkey) > 1 then 'd' || s_suppkey || '_' || op else 'd' || s_suppkey end as file_id,
         'https://h' || s_nationkey || '/' || op as url, base from ops join supplier using (s_suppkey)""",
)
def src_listable_ops(spark, folder):
    def param(name, required, sample):
        return F.struct(F.lit(name).alias("name"), F.lit(required).alias("required"), sample.alias("sample"))

    def operation(identity, path, *params):
        return F.struct(
            F.lit(identity).alias("operation_id"), path.alias("path"), F.lit(None).cast("string").alias("full_url"), F.array(*params).alias("params")
        )

    key = F.col("s_suppkey")
    # a blank sample of a required parameter makes the operation unusable
    first = operation("get-A", F.when(key % 7 > 0, F.lit("/getA")).otherwise("/"), param("pageNo", True, F.lit("")))
    second = operation(
        "", F.lit("/listB"), param("q", True, F.when(key % 3 > 0, " 5 ").otherwise("없음")), param("serviceKey", True, F.lit("-"))
    )
    services = read(spark, folder, "supplier").select(
        F.concat(F.lit("d"), key.cast("string")).alias("dataset_id"),
        F.expr("case when s_suppkey % 4 = 3 then 'none' when s_suppkey % 2 = 0 then 'host' else 'title' end").alias("match"),
        F.lit("경상북도 포항시").alias("org"),
        F.when(key % 5 > 0, "경상북도 포항시_목록").otherwise("경주시_목록").alias("page_title"),
        F.concat(F.lit("h"), F.col("s_nationkey").cast("string"), F.lit("/")).alias("host"),
        F.array(first, second).alias("operations"),
    )
    listed = endpoints.listable_operations(services)
    base = F.array_join(F.transform(F.map_entries("base"), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return listed.select("dataset_id", "file_id", "url", base.alias("base"))


# ---- description pages: every page also carries a service description


def described_pages(spark, folder):
    number = F.col("page_id").cast("string")
    labels = F.concat(
        F.lit('<ul class="info"><li><strong class="key"> 갱신주기 </strong><span class="value"> 매 <b>월</b>  </span></li>'
              '<li><strong class="key">키워드</strong><div class="value">쌀, 물가 ,, k'),
        number,
        F.lit('</div></li><li><strong class="key">요청주소</strong><p class="value">https://h/'),
        number,
        F.lit("</p></li></ul>"),
    )
    kind = (F.col("page_id") % 3).cast("string")
    by_hand = F.concat(
        F.lit('"swaggerOprtinVOs": [{"gwSvcNm": "other"}, {"operationId": "list'), number,
        F.lit('", "reqList": [{"paramtrNm": "q", "paramtrBassValue": "old"}, {"paramtrNm": "q", "paramtrBassValue": "5"}],'
              ' "resList": [{"paramtrNm": "resultCode"}, {"paramtrNm": "box", "subParam": [{"paramtrNm": "addr'), kind,
        F.lit('", "paramtrDc": "주소", "paramtrTy": "string"}, {"paramtrNm": "deep", "subParam": [{"paramtrNm": "z", "paramtrDc": "깊이"}]},'
              ' {"paramtrNm": "addr'), kind, F.lit('", "paramtrDc": "again"}]}]}], '),
    )
    text = F.concat(
        F.lit('{"host": "h'), number, F.lit('.example.org", "basePath": "/v1/", "info": {"title": "Service '), number,
        F.lit('", "description": " About '), number, F.lit(' "}, '), F.when(F.col("page_id") % 4 == 0, by_hand).otherwise(""),
        F.lit('"paths": {"/list": {"parameters": [{"name": "pageNo", "required": true}], "get": {"operationId": "list'), number,
        F.lit('", "summary": "List", "produces": ["json", "xml"], "parameters": [{"name": "q", "required": true, "type": "string"}],'
              ' "responses": {"200": {"schema": {"properties": {"header": {"properties": {"resultCode": {"type": "string"}}},'
              ' "body": {"properties": {"items": {"items": {"properties": {"addr'), kind,
        F.lit('": {"type": "string", "description": "place"}, "geo": {"properties": {"lat": {"type": "number"}, "cnt": {}}}}}},'
              ' "totalCount": {}, "cnt": {"description": "later"}}}}}}}}}, "/a/raw": {"post": {}}}}'),
    )
    # some pages hold the description escaped once more
    text = F.when(F.col("page_id") % 8 == 4, F.replace(text, F.lit('"'), F.lit('\\"'))).otherwise(text)
    description = F.concat(F.lit("<script>const swaggerJson = `"), text, F.lit("`;</script>"))
    table = F.concat(
        F.lit("<table><tr><th>x</th></tr><tbody><tr><td>no</td></tr></tbody></table><table class='p'><thead><tr><th>항목명</th>"
              "<th>항목명(영문)</th></tr></thead><tbody><tr><td>주소</td><td> addr"),
        number,
        F.lit("</td><td>1</td><td>필수</td><td>a &amp; b</td><td></td></tr><tr><td>건수</td><td>cnt</td><td>2</td><td>옵션</td><td>-</td>"
              "<td>the\n count</td></tr><tr><td>short</td><td>row</td></tr></tbody></table>"),
    )
    extra = F.concat(labels, F.when(F.col("page_id") % 2 == 0, description).otherwise(""), table)
    return read(spark, folder, "pages").select("page_id", F.concat("html", extra).alias("html"))


_EVEN = "page_id % 2 = 0"
_BY_HAND = "page_id % 4 = 0"
# (name, description) of the fields of every operation with a description
_FIELDS = f"""case when {_BY_HAND} then ['addr' || (page_id % 3) || ':주소', 'z:깊이']
    else ['addr' || (page_id % 3) || ':place', 'lat:', 'cnt:'] end"""


@query(
    "src_page_metadata",
    f"""select page_id, '매 월' as update_cycle, '쌀;물가;k' || page_id as keywords, '' as category, 'https://h/' || page_id as request_url,
         case when {_EVEN} then 'h' || page_id || '.example.org/v1' else '' end as host,
         case when {_EVEN} then 'Service ' || page_id else '' end as title,
         case when {_EVEN} then 'About ' || page_id else '' end as description,
         case when {_EVEN} then 'list' || page_id || '(addr' || (page_id % 3) || case when {_BY_HAND} then ',z' else ',lat,cnt' end
           || ');a/raw()' else '' end as operations from pages""",
)
def src_page_metadata(spark, folder):
    """What a page says of itself, with the operations of its description and their fields."""
    # pages that share an id keep their own operations
    page = F.struct("page_id", F.sha2("html", 256).alias("print"))
    pages = described_pages(spark, folder).select(page.alias("page_id"), "html")
    named = F.concat("operation_id", F.lit("("), F.array_join(F.col("fields.name"), ","), F.lit(")"))
    told = endpoints.page_operations(pages.distinct()).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("position", named.alias("named")))).alias("told")
    )
    joined = endpoints.page_metadata(pages).join(told, "page_id", "left")
    return joined.withColumns(
        {
            "page_id": F.col("page_id.page_id"),
            "keywords": F.array_join("keywords", ";"),
            "operations": F.coalesce(F.array_join(F.col("told.named"), ";"), F.lit("")),
        }
    ).drop("told")


@query(
    "src_page_operations",
    f"""select page_id, 0 as position, '/list' as path, 'list' || page_id as operation_id, 'List' as summary, 'json;xml' as produces,
          case when {_BY_HAND} then 'pageNo!;q!string5' else 'pageNo!;q!string' end as params, array_to_string({_FIELDS}, ';') as fields
        from pages where {_EVEN} union all select page_id, 1, '/a/raw', 'a/raw', '', '', '', '' from pages where {_EVEN}""",
)
def src_page_operations(spark, folder):
    found = endpoints.page_operations(described_pages(spark, folder))
    params = F.transform("params", lambda p: F.concat(p["name"], F.when(p["required"], "!").otherwise(""), p["type"], p["sample"]))
    fields = F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["desc"]))
    joined = {"params": params, "fields": fields, "produces": F.col("produces")}
    return found.withColumns({n: F.array_join(c, ";") for n, c in joined.items()}).drop("description")


def page_services(spark, folder):
    """Every page matched to an endpoint of its own, with the operations its description tells."""
    pages = described_pages(spark, folder)
    key = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    asked = pages.select(key.alias("endpoint_id"), F.lit("경상북도 포항시").alias("org"), F.lit("목록").alias("name"))
    matches = pages.select(key.alias("endpoint_id"), "page_id", F.when(F.col("page_id") % 6 == 2, "title").otherwise("host").alias("match"))
    return endpoints.described_services(asked, matches, endpoints.page_metadata(pages), endpoints.page_operations(pages))


@query(
    "src_described_ops",
    # without a listed sample the required parameter q has no value
    f"""select 'p' || page_id as dataset_id, case when op = 'araw' and not {_BY_HAND} then 'p' || page_id
            else 'p' || page_id || '_' || op end as file_id,
          'https://h' || page_id || '.example.org/v1' || path as url, base from (
            select page_id, 'list' || page_id as op, '/list' as path, 'q=5' as base from pages where {_BY_HAND}
            union all select page_id, 'araw', '/a/raw', '' from pages where {_EVEN}) where page_id % 6 <> 2""",
)
def src_described_ops(spark, folder):
    listed = endpoints.listable_operations(page_services(spark, folder))
    base = F.array_join(F.transform(F.map_entries("base"), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return listed.select("dataset_id", "file_id", "url", base.alias("base"))


@query(
    "src_catalog_operations",
    f"""select 'p' || page_id as dataset_id, 'list' || page_id as operation, 'Service ' || page_id as title, 'About ' || page_id as description,
          '경상북도 포항시' as provider, 'k' || page_id as keyword, 'json,xml' as formats,
          'https://h' || page_id || '.example.org/v1/list' as api_url, split_part(f, ':', 1) as field, split_part(f, ':', 2) as "desc"
        from (select page_id, unnest({_FIELDS}) as f from pages where {_EVEN})""",
)
def src_catalog_operations(spark, folder):
    told = endpoints.catalog_operations(page_services(spark, folder)).select("*", F.explode("fields").alias("f"))
    return told.select(
        "dataset_id", "operation", "title", "description", "provider", F.get("keywords", F.lit(2)).alias("keyword"), "formats", "api_url",
        F.col("f.name").alias("field"), F.col("f.desc").alias("desc"),
    )


@query(
    "src_service_address",
    "select page_id, case when page_id % 3 = 2 then 'https://base/' || page_id else 'https://h/' || page_id end as service_url from pages",
)
def src_service_address(spark, folder):
    """Fragments that name a service address, and some whose request address is no address."""
    number = F.col("page_id").cast("string")
    base = F.concat(F.lit('<li><strong class="key">서비스 URL</strong><span class="value"> https://base/'), number, F.lit("/</a></span></li>"))
    html = F.when(F.col("page_id") % 3 == 2, F.replace("html", F.lit('"value">https'), F.lit('"value">none'))).otherwise(F.col("html"))
    fragments = described_pages(spark, folder).select("page_id", F.concat(base, html).alias("html"))
    return endpoints.service_address(fragments)


@query(
    "src_html_tables",
    """select page_id, 0 as table_pos, 0 as row_pos, 'addr' || page_id as name, '주소' as "desc", '주소' as local_name, true as required,
         'a & b' as sample from pages
       union all select page_id, 0, 1, 'cnt', 'the count', '건수', false, '-' from pages""",
)
def src_html_tables(spark, folder):
    return endpoints.parameter_tables(described_pages(spark, folder))
