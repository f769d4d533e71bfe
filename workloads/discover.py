"""Search documents, ranking and recommendation for a table of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.functions.text import Dictionary, expand_questions, tokens
from keyweave.operators import search
from keyweave.session import cut_lineage
from workloads.inputs import GAZETTEER, place, read, town
from workloads.registry import query

DICTIONARY = Dictionary()

# ---- documents and tokens


@query(
    "sea_documents",
    """select cast(doc_id as varchar) as doc_id, array_to_string(list_filter([source || ' ' || lang,
         case when doc_id % 2 = 0 then 'list' else '' end, lang, source,
         array_to_string([lang, source, 'k' || (doc_id % 7)], ', '), text,
         'quality(score ' || lang || '); toxic'], lambda x: x <> ''), ' | ') as text from documents""",
)
def sea_documents(spark, folder):
    doc = F.col("doc_id")
    column = [
        F.struct(F.lit("quality").alias("name"), F.concat(F.lit("score "), "lang").alias("desc"), F.lit("numeric").alias("role")),
        F.struct(F.lit("toxic").alias("name"), F.lit("").alias("desc"), F.lit("numeric").alias("role")),
    ]
    entries = read(spark, folder, "documents").select(
        doc.cast("string").alias("dataset_id"),
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.when(doc % 2 == 0, "list").otherwise("").alias("operation"),
        F.col("lang").alias("category"),
        F.col("source").alias("provider"),
        F.array("lang", "source", F.concat(F.lit("k"), (doc % 7).cast("string"))).alias("keywords"),
        F.col("text").alias("description"),
        F.array(*column).alias("columns"),
    )
    return search.dataset_text(entries)


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+|[가-힣]+')"


@query(
    "sea_tokens",
    f"""with runs as (select doc_id, unnest({_TOKENS.format("text || ' ' || " + town('doc_id') + " || '시청 2024'")}) as term from documents),
          every as (select doc_id, term from runs union all
            select doc_id, unnest(list_transform(range(1, length(term)), lambda i: substring(term, i, 2))) from runs
            where regexp_matches(term, '^[가-힣]{{3,}}'))
        select term, count(*) as n, count(distinct doc_id) as documents from every group by term""",
)
def sea_tokens(spark, folder):
    text = F.concat("text", F.lit(" "), F.expr(town("doc_id")), F.lit("시청 2024"))
    words = read(spark, folder, "documents", spread=True).select("doc_id", F.explode(tokens(text)).alias("term"))
    per_document = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


_ASK = (
    "case turn % 5 when 0 then ' public toilets' when 1 then ' 병원' when 2 then ' Pohangs' when 3 then ' real estate Andong' else '' end"
)


def _values(entries):
    return ", ".join(f"({at}, '{term}', '{added}')" for at, (term, added) in enumerate(entries.items()))


def _expanded(rows: str) -> str:
    """Rows ``(id, t)`` with their expanded text, by looking for every term in every text."""
    return f"""with q as materialized (select id, t, lower(t) as low from ({rows})),
    anywhere(pos, term, added) as (values {_values({**DICTIONARY.phrases, **DICTIONARY.synonyms})}),
    known(pos, term, added) as (values {_values(DICTIONARY.words)}),
    spoken as (select id, unnest(regexp_extract_all(low, '[A-Za-z][A-Za-z-]+')) as w,
      generate_subscripts(regexp_extract_all(low, '[A-Za-z][A-Za-z-]+'), 1) as pos from q),
    hits as (select id, 0 as kind, pos, added from q join anywhere on contains(low, term)
      union all select id, 1, s.pos, coalesce(k.added, p.added) from spoken s left join known k on k.term = w
        left join known p on w like '%s' and p.term = w[:-2] where coalesce(k.added, p.added) is not null)
    select id, any_value(t) || coalesce(' ' || string_agg(added, ' ' order by kind, h.pos), '') as expanded
    from q left join hits h using (id) group by id"""


_EXPANDED = f"""select id // 1000 as conv_id, (id % 1000)::int as turn, expanded
    from ({_expanded(f"select conv_id * 1000 + turn as id, text || {_ASK} as t from conversations")})"""


def asking(spark, folder):
    return read(spark, folder, "conversations").select("conv_id", "turn", F.concat("text", F.expr(_ASK)).alias("text"))


@query("sea_expand", _EXPANDED)
def sea_expand(spark, folder):
    return asking(spark, folder).select("conv_id", "turn", DICTIONARY.expand("text").alias("expanded"))


@query("sea_expand_table", f"select expanded, count(*) as n from ({_EXPANDED}) group by 1")
def sea_expand_table(spark, folder):
    """The same by a join with the dictionary as a table, each distinct question once."""
    texts = asking(spark, folder).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(texts.withColumn("question_id", F.sha2("text", 256)))
    expanded = expand_questions(counted, DICTIONARY.table(spark))
    return expanded.join(counted, "question_id").select("expanded", "n")


@query(
    "sea_split",
    f"""with q as (select o_orderkey, unnest(case o_orderkey % 6
          when 0 then [o_orderstatus || ' orders', o_orderpriority || ' parts']
          when 1 then ['포항시 ' || o_orderstatus, '포항시 b', '포항시 c']
          when 2 then ['Pohang solar permits', 'Pohang ' || o_orderpriority]
          when 3 then [{place('o_orderkey')} || ' 학교', {place('o_orderkey')} || ' 공원']
          when 4 then [] else ['buses', 'trains ' || o_orderstatus] end) as part,
        generate_subscripts(case o_orderkey % 6 when 1 then [1, 2, 3] when 4 then [] else [1, 2] end, 1) - 1 as pos from orders)
        select o_orderkey, pos::int as pos, part from q""",
)
def sea_split(spark, folder):
    asked = F.expr(
        "case o_orderkey % 6 when 0 then 'Show ' || o_orderstatus || ' orders vs ' || o_orderpriority || ' parts by city in detail'"
        " when 1 then '포항시 : ' || o_orderstatus || ', b; c' when 2 then 'Pohang solar permits and ' || o_orderpriority"
        f" when 3 then {place('o_orderkey')} || ' 학교 versus 공원' when 4 then 'only ' || o_orderpriority"
        " else 'compare  buses & trains ' || o_orderstatus || ' per month' end"
    )
    parts = DICTIONARY.split(asked)
    return read(spark, folder, "orders").select("o_orderkey", F.posexplode(parts).alias("pos", "part"))


# ---- lexical scores

_INDEX = f"""toks as (select doc_id, unnest({_TOKENS.format('text')}) as term from documents),
  post as (select doc_id, term, count(*) as tf from toks group by all),
  lens as (select doc_id, sum(tf)::double as length from post group by all),
  tot as (select count(*)::double as n, (select sum(length) from lens) / count(*) as mean from documents),
  raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from post, tot group by term, n),
  terms as (select term, case when idf < 0 then (select avg(idf) * 0.25 from raw) else idf end as idf from raw)"""


def _scores(questions: str) -> str:
    return f"""asked as (select question_id, unnest({_TOKENS.format('text')}) as term from {questions}),
  bm as (select question_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) as bm25
    from (select question_id, term, count(*) as times from asked group by all) join terms using (term)
    join post using (term) join lens using (doc_id), tot group by all),
  rng as (select question_id, case when count(doc_id) = any_value(n) then min(bm25) else least(coalesce(min(bm25), 0), 0) end as lo,
      case when count(doc_id) = any_value(n) then max(bm25) else greatest(coalesce(max(bm25), 0), 0) end as hi
    from {questions} left join bm using (question_id), tot group by question_id)"""


_QUESTIONS = "(select item_id as question_id, text from benchmark)"


def questions(spark, folder):
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def index_of(spark, folder):
    return search.build_index(read(spark, folder, "documents").select("doc_id", "text"))


@query(
    "sea_bm25",
    f"with {_INDEX}, {_scores(_QUESTIONS)} select question_id, doc_id, round(bm25, 4) as bm25 from bm",
)
def sea_bm25(spark, folder):
    scores = search.lexical_scores(index_of(spark, folder), questions(spark, folder))
    return scores.select("question_id", "doc_id", F.round("bm25", 4).alias("bm25"))


@query(
    "sea_minmax",
    f"""with {_INDEX}, {_scores(_QUESTIONS)} select question_id, doc_id,
          round(case when hi > lo then (bm25 - lo) / (hi - lo) else 0 end, 6) as scaled from bm join rng using (question_id)""",
)
def sea_minmax(spark, folder):
    index, asked = index_of(spark, folder), questions(spark, folder)
    scores = search.lexical_scores(index, asked)
    ranges = search.lexical_range(index, scores, asked)
    value = search.scaled(F.col("bm25"), F.col("bm_low"), F.col("bm_high"))
    return scores.join(ranges, "question_id").select("question_id", "doc_id", F.round(value, 6).alias("scaled"))


# ---- vectors

_VECTORS = """qv as (select item_id as question_id, embedding::double[] as v from benchmark join embeddings on item_id = vec_id),
  dv as (select vec_id as doc_id, embedding::double[] as v from embeddings)"""


def question_vectors(spark, folder):
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return questions(spark, folder).join(vectors, "question_id")


@query(
    "sea_cosine",
    f"""with {_VECTORS} select question_id, doc_id, round(c, 6) as cosine from (select question_id, doc_id,
          list_inner_product(qv.v, dv.v) as c, row_number() over (partition by question_id
            order by list_inner_product(qv.v, dv.v) desc, doc_id) as r from qv, dv) where r <= 10""",
)
def sea_cosine(spark, folder):
    documents = read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    top = search.cosine_top(question_vectors(spark, folder).drop("text"), documents)
    return top.select("question_id", "doc_id", F.round("cosine", 6).alias("cosine"))


# Datasets of the hybrid search: all documents, ranked with their length as row count; one without a vector has cosine 0.
_HYBRID = f"""{_INDEX}, qv as (select item_id as question_id, embedding::double[] as v from benchmark join embeddings on item_id = vec_id),
  dv as (select doc_id, coalesce(embedding::double[], list_resize([]::double[], 64, 0)) as v from documents left join embeddings on doc_id = vec_id),
  {_scores(_QUESTIONS)},
  cos as (select question_id, doc_id, list_inner_product(qv.v, dv.v) as c from qv, dv),
  crng as (select question_id, min(c) as clo, max(c) as chi from cos group by 1)"""


def hybrid_inputs(spark, folder):
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    documents = read(spark, folder, "documents").join(vectors, "doc_id", "left")
    index = search.build_index(documents.select("doc_id", "text"))
    return index, question_vectors(spark, folder), documents.select("doc_id", F.col("n_chars").alias("rows"), "vector")


def hybrid_hits(spark, folder):
    return search.hybrid_search(*hybrid_inputs(spark, folder))


_FUSED = f"""{_HYBRID}, fused as (select cos.question_id, cos.doc_id, c, coalesce(bm25, 0) as bm25,
    0.3 * case when hi > lo then (coalesce(bm25, 0) - lo) / (hi - lo) else 0 end
      + 0.7 * case when chi > clo then (c - clo) / (chi - clo) else 0 end + 0.015 * log10(n_chars + 1) as score
    from cos join crng using (question_id) join rng using (question_id) join documents using (doc_id)
    left join bm on bm.question_id = cos.question_id and bm.doc_id = cos.doc_id),
  hits as (select *, row_number() over (partition by question_id order by round(score, 12) desc, doc_id) as rank from fused)"""


@query(
    "sea_hybrid",
    f"with {_FUSED} select question_id, doc_id, rank, round(score, 6) as score, round(bm25, 6) as bm25, round(c, 6) as cosine from hits where rank <= 8",
)
def sea_hybrid(spark, folder):
    rounded = [F.round(c, 6).alias(c) for c in ("score", "bm25", "cosine")]
    return hybrid_hits(spark, folder).select("question_id", "doc_id", "rank", *rounded)


# Column documents are the turns of conversations; a conversation is the dataset of its id.
_COLUMNS = "(select conv_id * 1000 + turn as doc_id, conv_id, turn, text from conversations)"


def column_documents(spark, folder):
    return read(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("conv_id").alias("dataset_id"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("name"),
        "text",
    )


@query(
    "sea_column_bonus",
    f"""with {_INDEX.replace('from documents', 'from ' + _COLUMNS)}, {_scores(_QUESTIONS)},
          every as (select question_id, d.doc_id, conv_id, turn, case when hi > lo then (coalesce(bm25, 0) - lo) / (hi - lo) else 0 end as score
            from rng cross join {_COLUMNS} d left join bm using (question_id, doc_id)),
          lead as (select *, row_number() over (partition by question_id order by round(score, 12) desc, doc_id) as r from every),
          first as (select *, row_number() over (partition by question_id, conv_id order by r) as s from lead where r <= 200)
        select question_id, conv_id as dataset_id, round(score, 6) as score, 'turn ' || turn as name from first where s = 1""",
)
def sea_column_bonus(spark, folder):
    columns = column_documents(spark, folder)
    index = search.build_index(columns.select("doc_id", "text"))
    bonus = search.column_bonus(index, questions(spark, folder), columns.drop("text"))
    return bonus.withColumn("score", F.round("score", 6))


# ---- all parts of the score together: widened questions, vectors, sizes and the best column

_ASKED = f"(select item_id as question_id, text || {_ASK.replace('turn', 'item_id')} as text from benchmark)"
_DESCRIBED = "(select doc_id, text || case doc_id % 5 when 0 then ' 공중화장실 공공' when 1 then ' 의료기관' when 2 then ' 포항시' else '' end as text from documents)"
_COLUMN_VECTOR = "(conv_id * 7 + turn) % 400"


def _with_pairs(sql: str) -> str:
    """The same with the 2-grams of Hangul runs among the tokens."""
    runs = _TOKENS.format("text")
    pairs = f"list_transform(list_filter({runs}, lambda r: regexp_matches(r, '^[가-힣]{{3,}}$')), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))"
    return sql.replace(runs, f"list_concat({runs}, flatten({pairs}))")


def _zero_or(vector: str) -> str:
    return f"coalesce({vector}::double[], list_resize([]::double[], 64, 0))"


_FULL = _with_pairs(f"""wide as materialized (select id as question_id, expanded as text from ({_expanded("select question_id as id, text as t from " + _ASKED)})),
  qv as materialized (select item_id as question_id, {_zero_or("embedding")} as v from benchmark left join embeddings on item_id = vec_id),
  columns as materialized (select c.*, {_zero_or("embedding")} as v from {_COLUMNS} c left join embeddings on {_COLUMN_VECTOR} = vec_id),
  told as materialized (with {_INDEX.replace('from documents', 'from columns')}, {_scores('wide')},
    near as (select question_id, doc_id, list_inner_product(qv.v, d.v) as c from qv, columns d),
    span as (select question_id, min(c) as clo, max(c) as chi from near group by 1),
    every as (select question_id, d.doc_id, conv_id, turn, 0.5 * case when hi > lo then (coalesce(bm25, 0) - lo) / (hi - lo) else 0 end
        + 0.5 * case when chi > clo then (c - clo) / (chi - clo) else 0 end as score
      from rng join span using (question_id) join near using (question_id) join columns d using (doc_id) left join bm using (question_id, doc_id)),
    lead as (select *, row_number() over (partition by question_id order by round(score, 12) desc, doc_id) as r from every)
    select question_id, conv_id as doc_id, arg_min(score, r) as bonus, arg_min('turn ' || turn, r) as name from lead where r <= 200 group by all),
  full_hits as materialized (with {_INDEX.replace('from documents', 'from ' + _DESCRIBED)}, {_scores('wide')},
    near as (select question_id, doc_id, list_inner_product(qv.v, d.v) as c from qv,
      (select doc_id, {_zero_or("embedding")} as v from documents left join embeddings on doc_id = vec_id) d),
    span as (select question_id, min(c) as clo, max(c) as chi from near group by 1),
    every as (select question_id, doc_id, c, coalesce(bm25, 0) as bm25, name, 0.3 * case when hi > lo then (coalesce(bm25, 0) - lo) / (hi - lo) else 0 end
        + 0.7 * case when chi > clo then (c - clo) / (chi - clo) else 0 end + 0.015 * log10(n_chars + 1) + 0.1 * coalesce(bonus, 0) as score
      from rng join span using (question_id) join near using (question_id) join documents using (doc_id)
        left join bm using (question_id, doc_id) left join told using (question_id, doc_id))
    select *, row_number() over (partition by question_id order by round(score, 12) desc, doc_id) as rank from every)""")


def vector_of(spark, folder, name):
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))


def full_hits(spark, folder):
    asked = questions(spark, folder).join(vector_of(spark, folder, "question_id"), "question_id", "left")
    asked = asked.withColumn("text", F.concat("text", F.expr(_ASK.replace("turn", "question_id"))))
    known = read(spark, folder, "documents").join(vector_of(spark, folder, "doc_id"), "doc_id", "left")
    words = "case doc_id % 5 when 0 then ' 공중화장실 공공' when 1 then ' 의료기관' when 2 then ' 포항시' else '' end"
    index = search.build_index(known.select("doc_id", F.concat("text", F.expr(words)).alias("text")))
    columns = column_documents(spark, folder)
    column_index = search.build_index(columns.select("doc_id", "text"))
    at = columns.withColumn("vec", ((F.col("dataset_id") * 7 + F.col("doc_id") % 1000) % 400))
    columns = at.join(vector_of(spark, folder, "vec"), "vec", "left").drop("vec", "text")
    documents = known.select("doc_id", F.col("n_chars").alias("rows"), "vector")
    return search.full_search(index, column_index, asked, documents, columns, DICTIONARY)


@query(
    "sea_full",
    f"with {_FULL} select question_id, doc_id, rank, round(score, 6) as score, round(bm25, 6) as bm25, name as matched_column from full_hits where rank <= 8",
)
def sea_full(spark, folder):
    hits = full_hits(spark, folder)
    return hits.select("question_id", "doc_id", "rank", F.round("score", 6).alias("score"), F.round("bm25", 6).alias("bm25"), "matched_column")


_REGIONS = (
    f"case when item_id % 3 = 0 then {place('item_id')} end",
    f"case when doc_id % 2 = 0 then {place('doc_id')} end",
)


@query(
    "sea_confidence",
    f"""with {_FUSED} select question_id, doc_id, case when question_id % 3 = 0 and doc_id % 2 = 0 and question_id % 22 <> doc_id % 22 then 'low'
          when c >= 0.87 or (c >= 0.85 and bm25 > 2) then 'high' when c >= 0.84 or bm25 > 2 then 'medium' else 'low' end as confidence
        from hits where rank <= 8""",
)
def sea_confidence(spark, folder):
    asked = F.expr(_REGIONS[0].replace("item_id", "question_id"))
    own = F.expr(_REGIONS[1])
    level = search.confidence(F.col("cosine"), F.col("bm25"), asked, own)
    return hybrid_hits(spark, folder).select("question_id", "doc_id", level.alias("confidence"))


# ---- compound questions

_SEPARATORS = r"(?i)\s*(?:,|;|/| vs\.? | versus | and | & | with | against | compared to )\s*"
_PARTS = f"""pieces as (select item_id, list_filter(list_transform(regexp_split_to_array(text, '{_SEPARATORS}'),
      lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') as p, text from benchmark),
  asks as (select item_id * 1000 as question_id, item_id, 0 as part, text from pieces
    union all select item_id * 1000 + part, item_id, part, text from (select item_id, unnest(p) as text,
      generate_subscripts(p, 1) as part from pieces where len(p) >= 2))"""


def asked_parts(spark, folder):
    """Whole questions (part 0) and their parts, each a question of its own."""
    asked = questions(spark, folder)
    parts = asked.select("question_id", F.posexplode(DICTIONARY.split("text")).alias("at", "text"))
    whole = asked.select((F.col("question_id") * 1000).alias("question_id"), F.lit(0).alias("part"), "text")
    return whole.unionByName(
        parts.select((F.col("question_id") * 1000 + F.col("at") + 1).alias("question_id"), (F.col("at") + 1).alias("part"), "text")
    )


def merged_hits(spark, folder, k=8):
    index = index_of(spark, folder)
    documents = read(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("rows"))
    # parts ask for half as many hits as the whole question
    asked = asked_parts(spark, folder).select("question_id", "text", F.when(F.col("part") == 0, 8).otherwise(4).alias("k"))
    found = search.hybrid_search(index, cut_lineage(asked), documents, 8)
    hits = found.select(
        F.floor(F.col("question_id") / 1000).alias("question_id"), (F.col("question_id") % 1000).alias("part"), "rank", "doc_id", "score"
    )
    return search.merge_parts(hits, k)


_MERGED = f"""{_INDEX}, {_PARTS}, {_scores('asks')},
  every as (select question_id, d.doc_id, 0.3 * case when hi > lo then (coalesce(bm25, 0) - lo) / (hi - lo) else 0 end
      + 0.015 * log10(n_chars + 1) as score from rng cross join documents d left join bm using (question_id, doc_id)),
  hits as (select question_id // 1000 as q, question_id % 1000 as part, doc_id, score,
      row_number() over (partition by question_id order by round(score, 12) desc, doc_id) as rank from every),
  rated as (select q, part, doc_id, round(round(score, 3) * (case when part = 0 then 1.0 else 1.15 end)::double - (0.02)::double * (rank - 1), 3) as score
    from hits where rank <= case when part = 0 then 8 else 4 end),
  single as (select * from (select *, row_number() over (partition by q, doc_id order by score desc, part) as r from rated) where r = 1),
  merged as (select q as question_id, part, doc_id, score, row_number() over (partition by q order by score desc, part, doc_id) as rank
    from single)"""


@query("sea_multi", f"with {_MERGED} select question_id, part, doc_id, score, rank from merged where rank <= 8")
def sea_multi(spark, folder):
    return merged_hits(spark, folder)


@query(
    "sea_seeds_first",
    f"""with {_MERGED}, seeds as (select distinct question_id, doc_id from merged where rank % 5 = 0),
          placed as (select m.*, s.doc_id is not null as seed, row_number() over (partition by question_id
              order by s.doc_id is null, m.rank) as place from merged m left join seeds s using (question_id, doc_id) where rank <= 12)
        select question_id, doc_id, place as rank from placed where place <= 2 or seed""",
)
def sea_seeds_first(spark, folder):
    """The fifth and tenth hit moved to the front, and the rest cut to two or to all of these."""
    merged = cut_lineage(merged_hits(spark, folder, 12))
    seeds = merged.where(F.col("rank") % 5 == 0)
    return search.seeds_first(merged, seeds, 2).select("question_id", "doc_id", "rank")


_TITLE = (
    "case doc_id % 9 when 0 then '지역별 노인 인구' when 1 then '노령 인구' when 2 then '기상 관측' when 3 then '지역별 기온'"
    " when 4 then '무더위쉼터' when 5 then '대피 장소' else source end"
)
_HOME = f"case when doc_id % 4 > 0 then {place('doc_id')} end"
_HEAT = f"case item_id % 4 when 0 then ' heat' when 1 then ' 폭염 ' || {place('item_id')} else '' end"


@query(
    "sea_intent_boost",
    f"""with {_MERGED}, hot as (select item_id, case when item_id % 4 = 1 then {place('item_id')} end as region from benchmark where item_id % 4 < 2),
          ds as (select doc_id, {_TITLE} as title, {_HOME} as home, n_chars from documents),
          match as (select item_id, pattern, doc_id, row_number() over (partition by item_id, pattern
              order by case when contains(title, '지역별') then 0 else 1 end, n_chars desc, doc_id) as r
            from hot, ds, (select unnest(['노령|고령|노인', '기상|기온|온도|날씨', '대피|쉼터|보호']) as pattern)
            where (region is null or home is null or home = region) and regexp_matches(title, pattern)),
          forced as (select item_id, doc_id, row_number() over (partition by item_id order by
              case pattern when '노령|고령|노인' then 0 when '기상|기온|온도|날씨' then 1 else 2 end) - 1 as offs from match where r = 1),
          kept as (select * from merged where rank <= 8)
        select coalesce(k.question_id, f.item_id) as question_id, coalesce(k.doc_id, f.doc_id) as doc_id,
          case when f.item_id is not null then round((select max(score) from kept x where x.question_id = f.item_id) + 1.0 - 0.01 * offs, 3)
            else score end as score, f.item_id is not null as forced
        from kept k full join forced f on k.question_id = f.item_id and k.doc_id = f.doc_id""",
)
def sea_intent_boost(spark, folder):
    asked = questions(spark, folder).withColumn("text", F.concat("text", F.expr(_HEAT.replace("item_id", "question_id"))))
    datasets = read(spark, folder, "documents").select(
        "doc_id", F.expr(_TITLE).alias("title"), F.col("n_chars").alias("rows"), F.expr(_HOME).alias("default_region")
    )
    return search.intent_boost(
        cut_lineage(merged_hits(spark, folder)), asked, datasets, search.HEAT_TOPICS, GAZETTEER.question_region("text")
    )


_MODE = "case item_id % 7 when 0 then ' by town' when 1 then ' compare cities' when 2 then ' 시군별' when 3 then ' together' else '' end"


@query(
    "sea_mode",
    f"""with {_PARTS}, n as (select item_id, count(*) - 1 as parts from asks group by 1)
        select item_id as question_id, case item_id % 7 when 0 then 'emd' when 1 then 'sgg' when 2 then 'sgg' end as prefer,
          case when (parts >= 2 or item_id % 7 in (1, 3)) and item_id % 2 = 0 then 'join' else 'single' end as mode,
          item_id % 5 = 0 as weak_match from n""",
)
def sea_mode(spark, folder):
    plain = questions(spark, folder)
    asked = plain.withColumn("text", F.concat("text", F.expr(_MODE.replace("item_id", "question_id"))))
    parts = plain.select("question_id", F.size(DICTIONARY.split("text")).alias("n_parts"))
    sets = plain.where("question_id % 2 = 0").select("question_id")
    first = plain.select("question_id", F.when(F.col("question_id") % 5 == 0, "low").otherwise("high").alias("confidence"))
    return search.search_mode(asked, parts, sets, first)
