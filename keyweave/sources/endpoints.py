"""Service endpoints, their description pages and the operations that can be listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.casts import SPACE_CLASS, as_column, strip
from keyweave.functions.nested import items, let, members, one_per_name, walk
from keyweave.operators.sorting import top_k_per_group

# Parameters every service has for paging and format (fixed values).
PAGING_PARAMETERS = (
    "servicekey", "pageno", "numofrows", "type", "_type", "datatype", "returntype", "resulttype",
    "format", "pagesize", "page", "perpage",
)
NO_SAMPLE = ("-", "없음")

# Response fields of the envelope that are no data (fixed values).
ENVELOPE_FIELDS = ("resultCode", "resultMsg", "numOfRows", "pageNo", "totalCount")
ENVELOPE_LEVELS = ("header", "body", "items", "item")


def endpoint_path(url: Column | str) -> Column:
    """Host and path of an address in lower case without trailing slashes."""
    text = strip(as_column(url))
    host_and_path = F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^?#]*)", 1)
    without_parameters = F.regexp_replace(host_and_path, ";[^/]*$", "")
    return F.lower(F.rtrim(without_parameters, F.lit("/")))


def comparable(title: Column | str) -> Column:
    """A title without blanks and punctuation, in lower case."""
    text = F.coalesce(as_column(title), F.lit(""))
    return F.lower(F.regexp_replace(text, rf"(?U)(?:{SPACE_CLASS}|[_\-·,()\[\]])", ""))


def match_pages(endpoints: DataFrame, candidates: DataFrame) -> DataFrame:
    """The description page of every endpoint and how it was recognised.

    ``endpoints`` ``(endpoint_id, org, name, url)``; ``candidates`` ``(endpoint_id, position, page_id,
    title, host, request_url)``. Candidates are checked in order of their titles: the first
    whose address fits is a ``host`` match, else the first whose title holds the name a
    ``title`` match.
    """
    asked = endpoints.select(
        "endpoint_id",
        endpoint_path("url").alias("_target"),
        comparable("name").alias("_name"),
        comparable(F.element_at(F.split(strip("org"), rf"(?U){SPACE_CLASS}+"), -1)).alias("_org"),
    )
    title = comparable("title")
    joined = candidates.join(asked, "endpoint_id").withColumns(
        {"_titled": F.contains(title, F.col("_name")), "_by_org": F.contains(title, F.col("_org"))}
    )
    order = [F.col("_titled").desc(), F.col("_by_org").desc(), F.col("position").asc()]
    host = F.lower(F.coalesce("host", F.lit("")))
    request = F.coalesce(endpoint_path("request_url"), F.lit(""))
    service = F.substring_index("_target", "/", -1)
    fits = (
        (host == F.col("_target"))
        | request.startswith(F.col("_target"))
        | ((host != "") & F.col("_target").startswith(host) & F.contains(host, service))
    )
    titled = (F.col("_name") != "") & F.col("_titled")
    kind = F.when(fits, 0).when(titled, 1)
    best = joined.withColumn("_kind", kind).where(F.col("_kind").isNotNull())
    chosen = top_k_per_group(best, ["endpoint_id"], [F.col("_kind").asc(), *order], 1)
    found = chosen.select("endpoint_id", "page_id", F.when(F.col("_kind") == 0, "host").otherwise("title").alias("_match"))
    is_address = strip("url").startswith("http")
    return endpoints.join(found, "endpoint_id", "left").select(
        "endpoint_id",
        F.when(is_address, F.col("page_id")).alias("page_id"),
        F.when(~is_address, "no_endpoint").otherwise(F.coalesce("_match", F.lit("none"))).alias("match"),
    )


def operation_key(operation: Column | str) -> Column:
    """The letters and digits of an operation's name, whole, so that different names differ."""
    return F.regexp_replace(as_column(operation), "[^A-Za-z0-9]", "")


def match_summary(matches: DataFrame) -> DataFrame:
    """How many endpoints were recognised in each way."""
    return matches.groupBy("match").agg(F.count(F.lit(1)).alias("endpoints"))


def listable_operations(services: DataFrame) -> DataFrame:
    """Operations that can be listed without asking for parameters.

    ``services`` ``(dataset_id, match, org, page_title, host, operations)`` with ``operations`` an array of
    ``struct(operation_id, path, full_url, params)`` and ``params`` an array of
    ``struct(name, required, sample)``. Every required parameter needs a usable sample.
    """
    org_tail = F.element_at(F.split(strip("org"), rf"(?U){SPACE_CLASS}+"), -1)
    trusted = (F.col("match") == "host") | (
        (F.col("match") == "title") & F.contains(F.coalesce("page_title", F.lit("")), org_tail)
    )

    def free(p: Column) -> Column:
        name = F.lower(strip(p["name"]))
        return (name == "") | name.isin(*PAGING_PARAMETERS) | ~F.coalesce(p["required"], F.lit(False))

    def sampled(p: Column) -> Column:
        sample = strip(F.coalesce(p["sample"], F.lit("")))
        return (sample != "") & ~sample.isin(*NO_SAMPLE)

    def usable(op: Column) -> Column:
        path = F.coalesce(op["path"], F.lit(""))
        return ~path.isin("", "/") & F.forall(op["params"], lambda p: free(p) | sampled(p))

    listed = services.where(trusted & (F.coalesce("host", F.lit("")) != "")).withColumn("ops", F.filter("operations", usable))
    exploded = listed.select("dataset_id", "host", F.size("ops").alias("_n"), F.explode("ops").alias("op"))
    base = F.filter("op.params", lambda p: ~free(p))
    identity = operation_key(F.coalesce(F.nullif("op.operation_id", F.lit("")), F.col("op.path")))
    url = F.coalesce(
        F.nullif("op.full_url", F.lit("")), F.concat(F.lit("https://"), F.rtrim(F.col("host"), F.lit("/")), F.col("op.path"))
    )
    return exploded.select(
        "dataset_id",
        F.when(F.col("_n") > 1, F.concat_ws("_", "dataset_id", identity)).otherwise(F.col("dataset_id")).alias("file_id"),
        url.alias("url"),
        F.map_from_entries(F.transform(base, lambda p: F.struct(strip(p["name"]), strip(p["sample"])))).alias("base"),
    )


# ---- description pages

# Labels of a description page (fixed values).
LABELS = {"update_cycle": "갱신주기", "keywords": "키워드", "category": "분류체계", "request_url": "요청주소"}
TABLE_MARK = "항목명(영문)"
REQUIRED_MARK = "필수"

# Labels of a page fragment that name the service's address, in order of preference (fixed values).
ADDRESS_LABELS = ("요청주소", "서비스 URL")

# How far nested schemas are followed (fixed value); what lies deeper counts as one field.
SCHEMA_LEVELS = 6
# Listed response fields have no such bound; what lies deeper than this counts as one field.
LISTED_LEVELS = 8

# Names in the inline description of a page (fixed values).
LISTED, LISTED_ID, LISTED_NAME = "swaggerOprtinVOs", "operationId", "gwSvcNm"
LISTED_REQUEST, LISTED_RESPONSE, LISTED_BELOW = "reqList", "resList", "subParam"
ITEM_NAME, ITEM_TEXT, ITEM_TYPE, ITEM_SAMPLE = "paramtrNm", "paramtrDc", "paramtrTy", "paramtrBassValue"

_PARAMETER = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("name", "description", "required", "type")])
)


def plain_text(html: Column) -> Column:
    """Text of a fragment: tags removed, common entities read, blanks collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(text, rf"(?U){SPACE_CLASS}+", " "))


def labelled_value(html: Column, label: str) -> Column:
    """Value of the first list item whose key is ``label``, NULL when there is none."""
    item = (
        rf"(?s)<li[^>]*>(?:(?!</li>).)*?<strong[^>]*class=\"[^\"]*\bkey\b[^\"]*\"[^>]*>\s*{label}\s*</strong>"
        r"(?:(?!</li>).)*?<(\w+)[^>]*class=\"[^\"]*\bvalue\b[^\"]*\"[^>]*>(.*?)</\1>"
    )
    return F.when(html.rlike(item), plain_text(F.regexp_extract(html, item, 2)))


def _description(html: Column) -> Column:
    """The inline JSON description of a page as text; NULL without a readable one.

    Some pages hold it with its quotes and line ends escaped once more.
    """
    block = F.replace(F.regexp_extract(html, r"(?s)const swaggerJson = `(.*?)`;", 1), F.lit("\\`"), F.lit("`"))
    one_line = F.regexp_replace(block, "[\\r\\n]+", " ")
    again = F.get_json_object(F.concat(F.lit('{"v":"'), one_line, F.lit('"}')), "$.v")
    return F.coalesce(F.when(F.size(members(block)) > 0, block), F.when(F.size(members(again)) > 0, again))


def _at(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def page_metadata(pages: DataFrame) -> DataFrame:
    """Metadata of description pages ``(page_id, html)``: labels, and heads of the inline description."""
    html = F.col("html")
    read = pages.select(
        "page_id",
        *[F.coalesce(labelled_value(html, label), F.lit("")).alias(name) for name, label in LABELS.items()],
        _description(html).alias("d"),
    )
    words = F.filter(F.transform(F.split("keywords", ","), strip), lambda w: w != "")
    d = F.col("d")
    host = F.concat(F.coalesce(_at(d, "host"), F.lit("")), F.coalesce(_at(d, "basePath"), F.lit("")))
    text = strip(F.replace(F.coalesce(_at(d, "info.description"), F.lit("")), F.lit("\\n"), F.lit("\n")))
    return read.select(
        "page_id",
        "update_cycle",
        words.alias("keywords"),
        "category",
        "request_url",
        F.rtrim(host, F.lit("/")).alias("host"),
        F.coalesce(_at(d, "info.title"), F.lit("")).alias("title"),
        text.alias("description"),
    )


def page_operations(pages: DataFrame) -> DataFrame:
    """The operations in the inline descriptions of pages ``(page_id, html)``, one row each.

    ``(page_id, position, path, operation_id, summary, description, params, fields, produces)``: ``params``
    ``(name, desc, required, type, sample)`` and ``fields`` ``(name, desc, type)``. Where the page also lists the
    operation's parameters by hand, samples come from there, and so do the fields if it names
    any; else they are the leaves of the response's schema. Names of the envelope are no
    fields; of equal names the first stays.
    """
    d = pages.select("page_id", _description(F.col("html")).alias("d")).where("d is not null")

    def by_id(v: Column) -> Column:
        return F.struct(F.coalesce(F.nullif(_at(v, LISTED_ID), F.lit("")), _at(v, LISTED_NAME)).alias("id"), v.alias("spec"))

    listed = F.transform(items(_at(F.col("d"), LISTED)), by_id)
    paths = d.select("page_id", listed.alias("listed"), F.posexplode(members(_at(F.col("d"), "paths"))).alias("position", "entry"))
    calls = paths.select(
        "page_id",
        "position",
        "listed",
        F.col("entry.name").alias("path"),
        F.col("entry.spec").alias("whole"),
        F.coalesce(*[F.when(F.size(members(c)) > 0, c) for c in (_at(F.col("entry.spec"), m) for m in ("get", "post"))]).alias("call"),
    )
    call, whole = F.col("call"), F.col("whole")
    operation = F.coalesce(F.nullif(_at(call, "operationId"), F.lit("")), F.btrim("path", F.lit("/")))
    named = calls.withColumn("operation_id", operation).withColumn(
        "listed", F.try_element_at(F.filter("listed", lambda v: v["id"] == F.col("operation_id")), F.lit(-1))["spec"]
    )

    def nested_items(spec: Column) -> Column:
        return F.transform(items(spec), lambda x: F.struct(_at(x, ITEM_NAME).alias("name"), x.alias("spec")))

    def nested_schema(spec: Column) -> Column:
        own, of_items = members(_at(spec, "properties")), members(_at(spec, "items.properties"))
        return let(own, lambda o: F.when(F.size(o) > 0, o).otherwise(of_items))

    named = walk(named, nested_items(_at(F.col("listed"), LISTED_RESPONSE)), lambda s: nested_items(_at(s, LISTED_BELOW)), LISTED_LEVELS, "by_hand")
    schema = _at(call, "responses['200'].schema.properties")
    named = walk(named, members(schema), nested_schema, SCHEMA_LEVELS, "by_schema")

    def fields(leaves: str, dropped: tuple[str, ...], text: str, kind: str) -> Column:
        kept = F.filter(leaves, lambda n: (F.coalesce(n["name"], F.lit("")) != "") & ~n["name"].isin(*dropped))
        return F.transform(
            one_per_name(kept),
            lambda n: F.struct(
                n["name"].alias("name"),
                F.coalesce(_at(n["spec"], text), F.lit("")).alias("desc"),
                F.coalesce(_at(n["spec"], kind), F.lit("")).alias("type"),
            ),
        )

    by_hand = fields("by_hand", ENVELOPE_FIELDS, ITEM_TEXT, ITEM_TYPE)
    by_schema = fields("by_schema", ENVELOPE_FIELDS + ENVELOPE_LEVELS, "description", "type")
    samples = F.transform(
        items(_at(F.col("listed"), LISTED_REQUEST)),
        lambda x, i: F.struct(i.alias("at"), _at(x, ITEM_NAME).alias("name"), _at(x, ITEM_SAMPLE).alias("sample")),
    )
    known = F.map_from_entries(
        F.transform(F.filter(one_per_name(samples, last=True), lambda x: x["name"].isNotNull()), lambda x: F.struct(x["name"], x["sample"]))
    )
    params = F.concat(*[F.coalesce(F.from_json(_at(c, "parameters"), _PARAMETER), F.array().cast(_PARAMETER)) for c in (whole, call)])
    named = named.withColumns({"_params": params, "_samples": known, "_by_hand": by_hand})
    return named.select(
        "page_id",
        "position",
        "path",
        "operation_id",
        F.coalesce(_at(call, "summary"), F.lit("")).alias("summary"),
        F.coalesce(_at(call, "description"), F.lit("")).alias("description"),
        F.transform(
            "_params",
            lambda p: F.struct(
                p["name"].alias("name"),
                F.coalesce(p["description"], F.lit("")).alias("desc"),
                F.coalesce(F.lower(p["required"]) == "true", F.lit(False)).alias("required"),
                F.coalesce(p["type"], F.lit("")).alias("type"),
                F.coalesce(F.try_element_at(F.col("_samples"), p["name"]), F.lit("")).alias("sample"),
            ),
        ).alias("params"),
        F.when(F.size("_by_hand") > 0, F.col("_by_hand")).otherwise(by_schema).alias("fields"),
        items(_at(call, "produces")).alias("produces"),
    )


def described_services(endpoints: DataFrame, matches: DataFrame, metadata: DataFrame, operations: DataFrame) -> DataFrame:
    """Endpoints with what their matched page tells of them, as ``listable_operations`` takes them.

    ``endpoints`` ``(endpoint_id, org, ...)``, ``matches`` from ``match_pages``, the rest from ``page_metadata`` and
    ``page_operations``. A dataset without a page has no operations.
    """
    address = F.lit(None).cast("string").alias("full_url")
    operation = F.struct(
        "position", "operation_id", "path", address, "params", "summary", "description", "fields", "produces"
    )
    told = operations.groupBy("page_id").agg(F.array_sort(F.collect_list(operation)).alias("operations"))
    pages = metadata.join(told, "page_id", "left").withColumnRenamed("title", "page_title")
    none = F.array().cast(told.schema["operations"].dataType)
    return (
        endpoints.join(matches.select("endpoint_id", "page_id", "match"), "endpoint_id")
        .join(pages, "page_id", "left")
        .withColumn("operations", F.coalesce("operations", none))
        .withColumnRenamed("endpoint_id", "dataset_id")
    )


def catalog_operations(services: DataFrame) -> DataFrame:
    """The operations of described services, as the catalog takes them.

    ``(dataset_id, position, operation, ...)`` with the metadata of the page and the operation's ``fields``.
    """
    def text(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    kept = services.withColumn("op", F.explode("operations"))
    identity = F.coalesce(F.nullif("op.operation_id", F.lit("")), F.col("op.path"))
    address = F.concat(F.lit("https://"), F.rtrim(text("host"), F.lit("/")), text("op.path"))
    return kept.select(
        "dataset_id",
        F.col("op.position").alias("position"),
        identity.alias("operation"),
        F.coalesce(F.nullif("page_title", F.lit("")), "name").alias("title"),
        F.col("op.summary").alias("op_summary"),
        text("category").alias("category"),
        F.col("org").alias("provider"),
        "keywords",
        text("description").alias("description"),
        text("update_cycle").alias("update_cycle"),
        F.array_join("op.produces", ",").alias("formats"),
        F.coalesce(F.nullif("op.full_url", F.lit("")), address).alias("api_url"),
        F.col("op.fields").alias("fields"),
    )


def service_address(fragments: DataFrame) -> DataFrame:
    """The address a page fragment ``(page_id, html)`` names for its service, blank without one.

    Only addresses that begin with ``http`` count; a request address goes before a service address, and of several
    the last one written.
    """
    pairs = F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>.*?</li>"), F.lit(0))

    def named(label: str) -> Column:
        values = F.transform(pairs, lambda item: strip(F.regexp_replace(F.coalesce(labelled_value(item, label), F.lit("")), "[<>/]+a?>?$", "")))
        return F.try_element_at(F.filter(values, lambda v: v.startswith("http")), F.lit(-1))

    return fragments.select("page_id", F.coalesce(*map(named, ADDRESS_LABELS), F.lit("")).alias("service_url"))


def parameter_tables(pages: DataFrame) -> DataFrame:
    """Rows of the parameter tables inside pages ``(page_id, html)``.

    Only tables whose header names the English item count, only rows with six cells or
    more and an English name. The first such table lists parameters, the second fields.
    """
    tables = F.regexp_extract_all("html", F.lit(r"(?s)(<table.*?</table>)"), F.lit(1))
    heads = r"(?s)<th[^>]*>(.*?)</th>"

    def is_listing(table: Column) -> Column:
        cells = F.regexp_extract_all(table, F.lit(heads), F.lit(1))
        return F.exists(cells, lambda c: plain_text(c) == TABLE_MARK)

    kept = pages.select("page_id", F.posexplode(F.filter(tables, is_listing)).alias("table_pos", "table"))
    body = F.regexp_extract("table", r"(?s)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = kept.select(
        "page_id", "table_pos", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_pos", "row")
    )
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), plain_text)
    read = rows.select("page_id", "table_pos", "row_pos", cells.alias("c")).where(
        (F.size("c") >= 6) & (F.get("c", 1) != "")
    )
    cell = [F.get("c", i) for i in range(6)]
    return read.select(
        "page_id",
        "table_pos",
        "row_pos",
        cell[1].alias("name"),
        F.when(cell[5] != "", cell[5]).otherwise(cell[0]).alias("desc"),
        cell[0].alias("local_name"),
        (cell[3] == REQUIRED_MARK).alias("required"),
        cell[4].alias("sample"),
    )
