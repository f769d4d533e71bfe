"""Text files in several encodings, response bodies, definitions and sinks."""

import json
import time
import tracemalloc

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from keyweave.functions import nested
from keyweave.sources import endpoints, responses, sinks, text_tables


def write(folder, name, text, encoding):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_load_reports_every_file(spark, tmp_path):
    good = 'id,주소 ,주소 ,1st\n1,"포항시, ""북구""\n2층",,a\n2,경주시,x\n3,a,b,c,too,many\n\n4,,,\n'
    paths = [
        write(tmp_path, "a.csv", good, "utf-8-sig"),
        write(tmp_path, "b.csv", good, "cp949"),
        write(tmp_path, "c.csv", "id,never\n1\n2\n", "ascii"),
    ]
    bad = tmp_path / "d.csv"
    bad.write_bytes(b"id\n\xff\xff\xff\n")
    report, tables = text_tables.load_tables(spark, [*paths, str(bad)], str(tmp_path / "out"))
    rows = {r.id: r for r in report.collect()}
    assert rows["a"].encoding == "utf-8-sig" and rows["b"].encoding == "cp949" and not rows["d"].ok and rows["d"].error
    assert rows["a"].columns == ["id", "주소", "주소_1", "c_1st"] and rows["a"].rows == rows["b"].rows == 3
    for table in tables:
        if table.id in ("a", "b"):
            got = sorted(tuple(r) for r in table.df.collect())
            assert got == [("1", '포항시, "북구"\n2층', "", "a"), ("2", "경주시", "x", "nan"), ("4", "", "", "")]
    assert rows["c"].columns == ["id"], "a column missing from every row is dropped"


def test_replacement_character_in_header_rejects_an_encoding(spark, tmp_path):
    path = write(tmp_path, "a.csv", "i�d\n1\n", "utf-8")
    row = text_tables.file_encodings(spark, [path]).first()
    assert row.encoding != "utf-8-sig"


def test_definitions(spark, tmp_path):
    path = write(tmp_path, "15.csv", "목록\n번호,항목명,설명\n1,addr, 주소 \n2,,x\n3,cnt\n", "cp949")
    rows = text_tables.read_definitions(spark, [path]).collect()
    assert {(r.dataset_id, r.item, r.desc) for r in rows} == {("15", "addr", "주소"), ("15", "cnt", "")}
    # a line that can't be decoded, and one with a very long cell, cost themselves at most
    lines = ["번호,항목명,설명", "1,addr,주소", "2,long," + "x" * 200_000, '3,"two\nlines","quo""ted"', "4,cnt,건수"]
    raw = [line.encode("cp949") for line in lines]
    (tmp_path / "16.csv").write_bytes(b"\r\n".join([*raw[:2], b"9,\xff\xff\xff,bad", *raw[2:]]))
    (tmp_path / "17.csv").write_bytes(b"")
    rows = text_tables.read_definitions(spark, [str(tmp_path / f"{n}.csv") for n in (16, 17)]).collect()
    assert {(r.item, r.desc[:10]) for r in rows} == {("addr", "주소"), ("long", "x" * 10), ("two\nlines", 'quo"ted'), ("cnt", "건수")}


def one(spark, text):
    return spark.createDataFrame([(text,)], "b string").select(responses.read_body("b").alias("r")).first().r


def test_bodies(spark):
    nested = {"a": [{"x": 1}], "header": {"list": [{}, {}, {}]}, "b": {"c": [{"y": 1}, {"y": 2}], "TotalCount": "2,000"}}
    assert [json.loads(r) for r in one(spark, json.dumps(nested)).records] == [{"y": 1}, {"y": 2}]
    assert one(spark, json.dumps(nested)).total == 2000
    assert one(spark, '{"item": {"x": 1}}').records == ['{"x": 1}']
    xml = '<r xmlns="u"><items><item><a> 1 </a></item><item><a/></item></items></r>'
    assert [json.loads(r) for r in one(spark, xml).records] == [{"a": "1"}, {"a": ""}]
    assert one(spark, "<r><open></r>").error and one(spark, "{bad").error and one(spark, "busy").format is None
    deep = {"l": 0}
    for _ in range(10):
        deep = {"d": deep}
    inner = deep
    while "d" in inner:
        inner = inner["d"]
    inner["rows"] = [{"z": 1}]
    assert one(spark, json.dumps(deep)).records == ['{"z": 1}']
    tied = '{"p": [{"n": 1}, {"n": 2}], "q": {"r": [{"n": 3}, {"n": 4}]}, "total": "many", "x": {"TOTAL": 1.10, "totalcnt": 12}}'
    assert [json.loads(r)["n"] for r in one(spark, tied).records] == [1, 2]
    assert one(spark, tied).total == 12
    assert one(spark, '{"item": {"item": {"x": "1"}, "y": 2}}').records == ['{"x": "1"}']
    assert one(spark, None).error and one(spark, "{}").records == [] and one(spark, '{"a": NaN}').error
    exact = one(spark, '[{"big": 1e400, "price": 1.10, "text": "n1.5"}]')
    assert exact.records == ['{"big": 1e400, "price": 1.10, "text": "n1.5"}']


def test_hostile_bodies(spark):
    for body in ("[" * 200_000, '{"a":' * 100_000 + "1" + "}" * 100_000, "<a>" * 100_000 + "</a>" * 100_000):
        r = one(spark, body)
        assert "nested too deeply" in r.error and not r.records and r.format is None
    # nothing that stands in a string passes for a number
    assert one(spark, '[{"x": "\\u0000n5", "y": 1.50}]').records == ['{"x": "\\u0000n5", "y": 1.50}']
    half = one(spark, '[{"x": "\\ud800", "y": "é"}]')
    assert half.error is None and json.loads(half.records[0]) == {"x": "\ud800", "y": "é"}
    long_error = "<!doctype html>" + "x" * 500
    assert one(spark, "busy " + long_error).error.endswith(long_error)
    nested = '{"item": {"item": {"q": {"item": {"z": 1}}}, "w": {"item": {"z": 2}}}}'
    assert one(spark, nested).records == ['{"z": 1}']


def seconds(spark, texts, made):
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    start = time.perf_counter()
    rows = df.select(made("b").alias("r")).collect()
    return time.perf_counter() - start, [r.r for r in rows]


def test_time_follows_the_size_of_a_body(spark):
    one(spark, "{}")
    body = json.dumps({"a": {"rows": [{"i": i, "s": f"é{i}"} for i in range(5000)], "single": [1] * 50, "totalCount": "5,000"}})
    took, (r,) = seconds(spark, [body], responses.read_body)
    assert took < 5 and len(r.records) == r.total == 5000 and json.loads(r.records[-1]) == {"i": 4999, "s": "é4999"}
    # as many single items, none of them in a list
    items = "{" + ", ".join(f'"k{i}": {{"item": {{"i": {i}}}}}' for i in range(5000)) + "}"
    took, (r,) = seconds(spark, [items], responses.read_body)
    assert took < 5 and r.records == ['{"i": 0}']
    record = json.dumps({f"k{i}": [i] if i % 2 else i for i in range(2000)} | {"k": {"1": "no"}, "z": {"0": 1}, "z_0": 2})
    record = record[:-1] + ', "k_9": 1}'
    took, (flat,) = seconds(spark, [record], responses.flatten_record)
    assert took < 5 and len(flat) == 2003 and flat["z_0"] == "2" and flat["k1999"] == "[1999]" and flat["k_9"] == "1"


def test_memory_follows_the_largest_body_and_not_their_number():
    body = json.dumps({"items": {"item": [{"id": i, "st": "O"} for i in range(100)]}})
    large = json.dumps([{"id": i} for i in range(10_000)])
    kinds = [body, None, "", "busy", "{bad", "<a>é</a>", large]

    def told(part):
        return list(zip(part.field("kind").to_pylist(), map(len, part.field("nodes")), part.field("error").to_pylist()))

    # each body alone, which also loads what is loaded at first use
    alone = {b: told(part)[0] for b in kinds for part in responses._nodes.func(iter([pa.array([b], pa.string())]))}
    bodies = kinds[:6] * 500 + [large, None] + [body] * 500
    batches = [pa.array(bodies), pa.array([], pa.string()), pa.array([None], pa.string())]
    found, parts = [], 0
    tracemalloc.start()
    for part in responses._nodes.func(iter(batches)):
        found += told(part)
        parts += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [alone[b] for b in [*bodies, None]]
    # all at once take 84 MB, slice by slice 11 MB
    assert parts > 5 and peak < 25e6


def test_find_records_query_parses_each_body_once(spark, tmp_path):
    from workloads import QUERIES

    rows = [(k, c, "OFP"[k % 3]) for k in range(0, 24_000, 40) for c in (0, 1, 41)]
    rows += [(40, 1, "O"), (None, 1, "O"), (80, None, "O"), (None, None, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    df = QUERIES["src_find_records"](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    landed = {}
    for k, c, st in rows:
        if k is not None and c is not None:
            landed.setdefault((c % 40, k // 4000 + 1), []).append((k, st))
    expected = []
    for (job, page), orders in landed.items():
        shape = (job + page) % 5
        kept = sorted(orders) if shape < 2 else sorted(orders)[:1] if shape == 2 else []
        expected += [(job, page, str(k), st) for k, st in kept]
    assert sorted(tuple(r) for r in df.collect()) == sorted(expected)


def test_all_landed_pages_stay(spark):
    rows = [(1, p, [f"{p}-{i}" for i in range(2)], 500, None) for p in range(1, 101)]
    rows += [(2, p, ["same", "page"], None, None) for p in range(1, 5)] + [(2, 5, [], None, "99:busy"), (2, 6, ["late"], None, None)]
    pages = spark.createDataFrame(rows, "job int, page int, records array<string>, total long, error string")
    records, jobs = responses.assemble_pages(pages)
    found = {r.job: r for r in jobs.collect()}
    assert found[1].rows == 200 and found[1].complete is False and records.where("job = 1").count() == 200
    assert (found[2].rows, found[2].repeated_pages, found[2].failed_pages, found[2].error) == (3, 3, 1, "page5: 99:busy")
    assert found[2].complete is None and records.where("job = 2").count() == 3


def test_intermediates_need_a_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    from keyweave.session import checkpoint_folder

    with pytest.raises(ValueError):
        checkpoint_folder(Session())
    Context.master = "local[8]"
    assert "app" in checkpoint_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        checkpoint_folder(Session())


def test_scope_removes_intermediates(spark):
    import os

    from keyweave.session import cut_lineage, intermediates

    def stored(df):
        # other sessions may use the same folder, so only the tables made here are looked at
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    with intermediates(spark):
        outer = cut_lineage(spark.range(5))
        with intermediates(spark):
            inner = stored(cut_lineage(spark.range(3)))
            assert os.path.isdir(inner)
        assert not os.path.exists(inner) and outer.count() == 5
        place = stored(outer)
    assert not os.path.exists(place)
    assert os.path.isdir(stored(cut_lineage(spark.range(1))))


def test_errors(spark):
    gateway = {"OpenAPI_ServiceResponse": {"cmmMsgHeader": {"returnReasonCode": "30", "errMsg": "NO KEY"}}}
    coded = {"response": {"header": {"resultCode": "99", "resultMsg": "bad"}}}
    fine = {"header": {"resultCode": "INFO-000"}}
    df = spark.createDataFrame([(json.dumps(x),) for x in (gateway, coded, fine)], "b string")
    assert [r[0] for r in df.select(responses.error_message("b")).collect()] == ["30: NO KEY", "99: bad", None]
    assert [r[0] for r in df.select(responses.error_message("b", F.lit(5))).collect()] == ["30:NO KEY", None, None]


def test_flatten(spark):
    record = '{"a": {"b": {"c": 1.5}, "d": true}, "e": [1, "둘"], "f": null}'
    flat = spark.createDataFrame([(record,)], "r string").select(responses.flatten_record("r")).first()[0]
    assert flat == {"a_b_c": "1.5", "a_d": "True", "e": '[1, "둘"]', "f": ""}
    odd = spark.createDataFrame([(None,), ("[1]",), ('{"a": {"b": 1}, "a_b": 2, "n": 9007199254740993, "d": 1.10}',), ("no",)], "r string")
    assert [r[0] for r in odd.select(responses.flatten_record("r")).collect()] == [None, None, {"a_b": "2", "n": "9007199254740993", "d": "1.10"}, None]
    nested = spark.createDataFrame([((1, ("x",)), None)], "a struct<b:int,c:struct<d:string>>, e string")
    assert responses.flatten_struct(nested).first().asDict() == {"a_b": "1", "a_c_d": "x", "e": ""}


def described(spark, text):
    html = None if text is None else f"<p>const swaggerJson = `{text}`;</p>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return endpoints.page_operations(pages).orderBy("position").collect(), endpoints.page_metadata(pages).first()


def test_descriptions(spark):
    def at(depth):
        spec = {"properties": {"leaf": {"description": "end"}, "item": {}}}
        for n in range(depth - 1, 0, -1):
            spec = {"items": {"properties": {f"n{n}": spec}}}
        return spec["items"]["properties"]

    def service(schema, **more):
        call = {"operationId": "o", "responses": {"200": {"schema": {"properties": schema}}}}
        return json.dumps({"paths": {"/z": {"get": call}, "/a": {"post": {"summary": "s"}, "parameters": [{"name": "p"}]}}, **more})

    shallow, deep = at(5), at(9)
    (z, a), meta = described(spark, service(shallow))
    # paths stay in the order they are written; nested fields are found at their end
    assert [f["name"] for f in z.fields] == ["leaf"] and z.fields[0]["desc"] == "end" and (a.path, a.summary, a.operation_id) == ("/a", "s", "a")
    assert a.params[0]["name"] == "p" and a.fields == [] and meta.host == "" and meta.keywords == []
    (z, _), _ = described(spark, service(deep))
    assert [f["name"] for f in z.fields] == ["n7"], "what lies deeper counts as one field"
    twice = {"b": {"type": "x"}, "a": {"properties": {"b": {"type": "y"}, "pageNo": {}}}}
    (z, _), _ = described(spark, service(twice))
    assert [tuple(f) for f in z.fields] == [("b", "", "x")]
    listed = [{"gwSvcNm": "o", "resList": [{"paramtrNm": "r", "subParam": [{"paramtrNm": "s", "paramtrTy": "t"}]}, {"paramtrNm": ""}]}]
    (z, _), _ = described(spark, service(twice, swaggerOprtinVOs=listed))
    assert [tuple(f) for f in z.fields] == [("s", "", "t")]
    for broken in ("", "{", "[1]", '{"paths": 5}', '{"paths": {"/x": []}}', None):
        rows, meta = described(spark, broken)
        assert all(not r.fields for r in rows) and meta.title == ""
    escaped = service(twice, info={"title": "T"}).replace('"', '\\"')
    (z, _), meta = described(spark, escaped)
    assert z.operation_id == "o" and meta.title == "T"


def test_one_per_name(spark):
    rows = [([(3, "b"), (1, "a"), (2, "b"), (4, None), (5, None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "e array<struct<at:int,name:string>>")
    first, last = (df.select(nested.one_per_name(F.col("e"), last=side)["at"]).collect() for side in (False, True))
    assert [r[0] for r in first] == [[1, 2, 4], [], None] and [r[0] for r in last] == [[1, 3, 5], [], None]


def test_snapshots_lose_their_key(spark):
    rows = [("s", "o", "2024-01-02", {"serviceKey": "x", "p": "1"}, "new"), ("s", "o", "2024-01-01", {}, "old")]
    df = spark.createDataFrame(rows, "service string, operation string, saved_at string, payload map<string,string>, response string")
    (row,) = responses.latest_snapshots(df).collect()
    assert row.payload == {"p": "1"} and row.response == "new"
    calls = spark.createDataFrame([(1, "s", "o", 503, "")], "call_id int, service string, operation string, status int, response string")
    assert responses.replay(calls, df).first().source == "snapshot"
    assert responses.replay(calls, df, enabled=False).first().source is None


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("sgg", 0.5, 3), ("emd", 1.0, 4)], "level string, match_rate double, matched int").coalesce(1)
    sinks.write_pairs(pairs, str(tmp_path / "pairs"))
    (part,) = (tmp_path / "pairs").glob("*.csv")
    assert part.read_text(encoding="utf-8").splitlines() == ["﻿level,match_rate,matched", "emd,1.0,4", "sgg,0.5,3"]
    sinks.write_json(pairs.withColumn("empty", F.lit(None).cast("string")), str(tmp_path / "json"))
    assert '"empty":null' in next((tmp_path / "json").glob("*.json")).read_text()
    sinks.write_table(pairs, str(tmp_path), "1")
    assert spark.read.parquet(str(tmp_path / "t_1")).count() == 2


def test_page_metadata_query_tells_operations_and_their_fields(spark, tmp_path):
    from workloads import QUERIES

    spark.createDataFrame([(1, "u", "<p>"), (2, "u", "<p>"), (2, "u", "<b>"), (4, "u", None), (8, "u", "")], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet")
    )
    rows = sorted((r.page_id, r.operations) for r in QUERIES["src_page_metadata"](spark, str(tmp_path)).collect())
    second = (2, "list2(addr2,lat,cnt);a/raw()")
    assert rows == [(1, ""), second, second, (4, ""), (8, "list8(addr2,z);a/raw()")]
