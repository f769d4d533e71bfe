"""Ranking of metadata documents for many questions at once.

Lexical scores are sparse: the weighted words of the questions are handed to every task, which scores its documents one
by one against all of them; too many questions meet documents through posting lists instead. Vector scores are dense: questions meet only those cells of documents whose bound reaches what they have found (``vectors``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.functions.text import Dictionary, asks_about_heat, asks_to_join, preferred_level, tokens
from keyweave.operators import vectors
from keyweave.operators.sorting import top_k_per_group
from keyweave.operators.vectors import VectorIndex
from keyweave.session import cut_lineage, size_in_bytes

# Parameters of the lexical score (fixed values).
K1 = 1.5
B = 0.75
IDF_FLOOR = 0.25

# Weights of the fused score (fixed values).
LEXICAL_WEIGHT = 0.3
VECTOR_WEIGHT = 0.7
COLUMN_WEIGHT = 0.1
ROWS_WEIGHT = 0.015
COLUMN_HITS = 200

# Title patterns that answer a question about heat, most important first (fixed values).
HEAT_TOPICS = ["노령|고령|노인", "기상|기온|온도|날씨", "대피|쉼터|보호"]

# Postings of one term, or documents and questions of one block, handled together.
TERM_BLOCK = 100_000

# Stored bytes up to which a table is broadcast.
BROADCAST_LIMIT = 8 * 1024 * 1024

# Scores of documents and questions that a task holds together.
CELLS = 1 << 20


def dataset_text(entries: DataFrame) -> DataFrame:
    """One search document per dataset from its metadata; rows are never indexed."""
    columns = F.transform(
        "columns",
        lambda c: F.when(c["desc"] != "", F.concat(c["name"], F.lit("("), c["desc"], F.lit(")"))).otherwise(c["name"]),
    )
    parts = [
        F.col("title"),
        F.col("operation"),
        F.col("category"),
        F.col("provider"),
        F.array_join("keywords", ", "),
        F.col("description"),
        F.array_join(columns, "; "),
    ]
    filled = F.filter(F.array(*parts), lambda p: p != "")
    return entries.select(F.col("dataset_id").alias("doc_id"), F.array_join(filled, " | ").alias("text"))


def column_text(entries: DataFrame) -> DataFrame:
    """One search document per column."""
    exploded = entries.select("dataset_id", "title", "category", F.explode("columns").alias("c"))
    text = F.concat(
        F.col("c.name"), F.lit(" "), F.col("c.desc"), F.lit(" ["), F.col("c.role"), F.lit("] — "), "title",
        F.lit(" ("), "category", F.lit(")"),
    )
    return exploded.select(
        F.concat_ws(".", "dataset_id", "c.name").alias("doc_id"), "dataset_id", F.col("c.name").alias("name"), text.alias("text")
    )


@dataclass(frozen=True)
class SearchIndex:
    """Index of documents: ``bags (doc_id, terms, tfs, lengths)`` with the distinct terms of each id, ``terms (term, df, idf)``
    and one row of ``totals (documents, mean_length)``."""

    bags: DataFrame
    terms: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """``(doc_id, term, tf, length)``."""
        return self.bags.select("doc_id", F.inline(F.arrays_zip("terms", "tfs", "lengths"))).toDF("doc_id", "term", "tf", "length")


def build_index(documents: DataFrame) -> SearchIndex:
    """Index the whole texts of ``documents (doc_id, text)``.

    Texts are dealt by id once; from there on a document's words stay in one task and are stored in one row, so neither counting
    nor scoring them shuffles words. Frequencies and totals come from the stored rows.
    """
    dealt = documents.select("doc_id", "text").repartition("doc_id")
    words = dealt.select("doc_id", tokens("text").alias("bag")).select("doc_id", "bag", F.size("bag").alias("length"))
    counts = (
        words.select("doc_id", "length", F.explode("bag").alias("term")).groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    listed = counts.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf", "length")).alias("bag"))
    bags = cut_lineage(
        listed.select("doc_id", F.col("bag.term").alias("terms"), F.col("bag.tf").alias("tfs"), F.col("bag.length").alias("lengths"))
    )
    postings = SearchIndex(bags, bags, bags).postings
    counted = documents.agg(F.count(F.lit(1)).alias("documents"))
    words = postings.agg(F.sum("tf").alias("words"))
    totals = cut_lineage(
        beside(counted, words).select("documents", (F.col("words") / F.col("documents")).alias("mean_length"))
    )
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(F.col("documents") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    rated = cut_lineage(beside(frequency, totals).select("term", "df", raw.alias("idf")))
    floor = rated.agg((F.avg("idf") * IDF_FLOOR).alias("floor"))
    terms = beside(rated, floor).select(
        "term", "df", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf")
    )
    return SearchIndex(bags, terms, totals)


def beside(table: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table next to every row, as scalar subqueries."""
    return table.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def _wanted(index: SearchIndex, questions: DataFrame) -> DataFrame:
    """The rated terms of the questions, stored; repeated question words count repeatedly."""
    asked = (
        questions.select("question_id", F.explode(tokens("text")).alias("term"))
        .groupBy("question_id", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return cut_lineage(
        asked.join(index.terms, "term").withColumn("blocks", F.ceil(F.col("df") / TERM_BLOCK).cast("int"))
    )


@dataclass(frozen=True)
class _Asked:
    """Question terms as every task holds them: term ``i`` has the entries ``starts[i]`` to ``starts[i + 1]``."""

    ids: pa.Array
    terms: pa.Array
    starts: np.ndarray
    question: np.ndarray
    weight: np.ndarray
    mean_length: float


def _asked(index: SearchIndex, wanted: DataFrame, others: pa.Array | None = None) -> _Asked:
    """``wanted``, whose size was checked, as arrays; ``others`` are questions that may have no known term."""
    table = wanted.select("question_id", "term", (F.col("times") * F.col("idf")).alias("weight")).toArrow().sort_by("term").combine_chunks()
    question, term = (table[c].combine_chunks() for c in ("question_id", "term"))
    ids = pc.unique(question if others is None else pa.concat_arrays([question, others]))
    terms = pc.unique(term)
    at = pc.index_in(term, value_set=terms).to_numpy(zero_copy_only=False)
    starts = np.searchsorted(at, np.arange(len(terms) + 1))
    mean = index.totals.first()["mean_length"]
    number = pc.index_in(question, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    return _Asked(ids, terms, starts, number, table["weight"].to_numpy(), float(mean or 0.0))


def _score_blocks(asked: _Asked, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Scores of all questions for blocks of a batch of bags: first row, scores, and which documents share a term."""
    width = len(asked.ids)
    if not width or not batch.num_rows:
        return
    held = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
    term = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=asked.terms), -1).to_numpy(zero_copy_only=False)
    known = np.flatnonzero(term >= 0)
    owner, term = np.repeat(np.arange(batch.num_rows), held)[known], term[known]
    tf, length = (batch.column(c).flatten().to_numpy(zero_copy_only=False)[known].astype(np.float64) for c in ("tfs", "lengths"))
    worth = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / asked.mean_length))
    fan = asked.starts[term + 1] - asked.starts[term]
    meets = np.cumsum(fan)
    upto = np.concatenate([[0], np.searchsorted(owner, np.arange(batch.num_rows), side="right")])
    # a score of zero can still be a match where some term has no or negative worth
    plain = bool((asked.weight > 0).all())
    low = 0
    while low < batch.num_rows:
        before = meets[upto[low] - 1] if upto[low] else 0
        fits = np.searchsorted(np.concatenate([[0], meets])[upto], before + CELLS, side="right") - 1
        high = int(max(low + 1, min(fits, low + max(1, CELLS // width), batch.num_rows)))
        part = slice(upto[low], upto[high])
        n = fan[part]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(asked.starts[term[part]], n)
        cell = np.repeat(owner[part] - low, n) * width + asked.question[entry]
        shape = (high - low, width)
        scores = np.bincount(cell, np.repeat(worth[part], n) * asked.weight[entry], (high - low) * width).reshape(shape)
        yield low, scores, scores != 0 if plain else np.bincount(cell, minlength=(high - low) * width).reshape(shape) > 0
        low = high


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def lexical_scores(index: SearchIndex, questions: DataFrame) -> DataFrame:
    """``(question_id, doc_id, bm25)`` for the documents sharing a term with a question.

    Repeated question words count repeatedly. The rated question terms are stored first: when
    they are small, every task scores its documents against all questions and nothing is shuffled; otherwise the
    postings of a frequent term are cut into blocks, so that no join group depends on one task.
    """
    return _scores(index, _wanted(index, questions))


def _scores(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    if size_in_bytes(wanted) <= BROADCAST_LIMIT:
        asked = _asked(index, wanted)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, scores, shared in _score_blocks(asked, batch):
                    doc, question = np.nonzero(shared)
                    columns = [asked.ids.take(pa.array(question)), batch.column("doc_id").take(pa.array(doc + low)), pa.array(scores[shared])]
                    yield pa.RecordBatch.from_arrays(columns, ["question_id", "doc_id", "bm25"])

        kinds = f"question_id {_type(wanted, 'question_id')}, doc_id {_type(index.bags, 'doc_id')}, bm25 double"
        return index.bags.mapInArrow(score, kinds)
    blocks = wanted.select("term", "blocks").distinct()
    held = index.postings.join(blocks, "term").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    matched = held.drop("blocks").join(spread.drop("blocks"), ["term", "block"])
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return beside(matched, index.totals).groupBy("question_id", "doc_id").agg(F.sum(weight).alias("bm25"))


def lexical_range(index: SearchIndex, scores: DataFrame, questions: DataFrame) -> DataFrame:
    """Lowest and highest score per question over all documents; unmatched ones score 0. Stored, as it is small."""
    seen = scores.groupBy("question_id").agg(
        F.min("bm25").alias("low"),
        F.max("bm25").alias("high"),
        F.count(F.lit(1)).alias("matches"),
        F.count_if(F.col("bm25") < 0).alias("negative"),
    )
    return cut_lineage(_ranges(index, seen, questions))


def _scanned_range(index: SearchIndex, wanted: DataFrame, questions: DataFrame) -> DataFrame:
    """``lexical_range`` of the scores of ``wanted``, whose size was checked, from one row per task and question."""
    asked = _asked(index, wanted)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(asked.ids)
        low, high, matches, negative = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for _, scores, shared in _score_blocks(asked, batch):
                low = np.minimum(low, np.where(shared, scores, np.inf).min(axis=0))
                high = np.maximum(high, np.where(shared, scores, -np.inf).max(axis=0))
                matches += shared.sum(axis=0)
                negative += (scores < 0).sum(axis=0)
        seen = np.flatnonzero(matches)
        columns = [asked.ids.take(pa.array(seen)), *[pa.array(c[seen]) for c in (low, high, matches, negative)]]
        yield pa.RecordBatch.from_arrays(columns, ["question_id", "low", "high", "matches", "negative"])

    kinds = f"question_id {_type(wanted, 'question_id')}, low double, high double, matches long, negative long"
    seen = index.bags.mapInArrow(reduce, kinds).groupBy("question_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("matches").alias("matches"), F.sum("negative").alias("negative")
    )
    return cut_lineage(_ranges(index, seen, questions))


def _ranges(index: SearchIndex, seen: DataFrame, questions: DataFrame) -> DataFrame:
    joined = beside(questions.select("question_id").join(seen, "question_id", "left"), index.totals)
    everywhere = F.col("matches") == F.col("documents")
    zero = F.lit(0.0)
    return joined.select(
        "question_id",
        F.when(everywhere, F.col("low")).otherwise(F.least("low", zero)).alias("bm_low"),
        F.when(everywhere, F.col("high")).otherwise(F.greatest("high", zero)).alias("bm_high"),
        F.coalesce("negative", F.lit(0)).alias("negative"),
    )


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant score scales to zero."""
    return F.when(high > low, (value - low) / F.when(high > low, high - low)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors (cosine when both have length one)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def sound_vectors(table: DataFrame, questions: DataFrame) -> DataFrame:
    """The table with a zero vector wherever one is missing, has a NULL or isn't as long as the questions' longest.

    Such a row has cosine 0 to everything and is ranked by its other scores.
    """
    width = questions.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).select("width").scalar()
    whole = F.col("vector").isNotNull() & (F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull())
    vector = F.col("vector").cast("array<double>")
    return table.withColumn("vector", F.when(F.coalesce(whole, F.lit(False)), vector).otherwise(F.array_repeat(F.lit(0.0), width)))


def unsound_vectors(table: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: how many vectors ``sound_vectors`` replaces."""
    given = table.withColumn("_given", F.col("vector").cast("array<double>"))
    same = F.col("_given").eqNullSafe(F.col("vector"))
    return sound_vectors(given, questions).agg(F.count_if(~same).alias("replaced"))


def cosine_range(questions: DataFrame, index: VectorIndex) -> DataFrame:
    """Lowest and highest cosine of every question ``(question_id, vector)`` over all documents of an index without priors."""
    sides = [
        vectors.best(index, questions.select("question_id", "vector", F.lit(sign).alias("scale"), F.lit(1).alias("keep"))).select(
            "question_id", F.col("product").alias(name)
        )
        for sign, name in ((-1.0, "cos_low"), (1.0, "cos_high"))
    ]
    return sides[0].join(sides[1], "question_id")


def best_dense(questions: DataFrame, index: VectorIndex, weight: float) -> DataFrame:
    """Best documents per question by scaled cosine plus the document's own prior.

    ``questions`` ``(question_id, vector, cos_low, cos_high, keep)``.
    """
    wide = F.col("cos_high") > F.col("cos_low")
    scale = F.when(wide, weight / F.when(wide, F.col("cos_high") - F.col("cos_low"))).otherwise(0.0)
    scaled_questions = questions.withColumn("scale", scale)
    found = vectors.best(index, scaled_questions).withColumnRenamed("product", "cosine")
    offset = scaled_questions.select("question_id", (F.col("scale") * F.col("cos_low")).alias("_low"))
    dense = F.when(F.col("_low").isNotNull(), F.col("value") - F.col("_low")).otherwise(F.col("value"))
    return found.join(offset, "question_id").withColumn("dense", dense).select("question_id", "doc_id", "cosine", "dense")


def best_prior(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Without vectors the dense order is the same for every question: the leading documents
    are found once and handed to all questions as one short list."""
    widest = questions.agg(F.max("keep").alias("keep")).first()["keep"] or 0
    order = [F.col("prior").desc(), F.col("doc_id").asc()]
    leading = documents.select("doc_id", "prior").orderBy(*order).limit(int(widest))
    item = F.struct((-F.col("prior")).alias("order"), "doc_id", "prior")
    listed = leading.agg(F.array_sort(F.collect_list(item)).alias("leading"))
    handed = beside(questions, listed).select("question_id", "keep", F.explode(F.slice("leading", F.lit(1), F.col("keep"))).alias("d"))
    return handed.select("question_id", "d.doc_id", F.lit(0.0).alias("cosine"), F.col("d.prior").alias("dense"), "keep")


def cosine_top(questions: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents closest to every question, exactly."""
    documents, questions = sound_vectors(documents, questions), sound_vectors(questions, questions)
    asked = questions.select(
        "question_id", "vector", F.lit(0.0).alias("cos_low"), F.lit(1.0).alias("cos_high"), F.lit(k).alias("keep")
    )
    return best_dense(asked, vectors.build(documents.withColumn("prior", F.lit(0.0))), 1.0).select("question_id", "doc_id", "cosine")


def _with_bonus(scores: DataFrame, bonus: DataFrame | None) -> DataFrame:
    """Pairs with a lexical score or a bonus, and both."""
    extra = scores.select("question_id", "doc_id", "bm25", F.lit(0.0).alias("bonus"))
    if bonus is None:
        return extra
    added = bonus.select("question_id", "doc_id", F.lit(0.0).alias("bm25"), "bonus")
    return extra.unionByName(added).groupBy("question_id", "doc_id").agg(F.sum("bm25").alias("bm25"), F.sum("bonus").alias("bonus"))


def _joined_hits(extra: DataFrame, limits: DataFrame, context: DataFrame, documents: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """``(question_id, doc_id, score, bm25, cosine)`` of the pairs whose upper bound reaches what is needed."""
    lexical_weight, vector_weight = weights
    lexical = lexical_weight * scaled(F.col("bm25"), F.col("bm_low"), F.col("bm_high"))
    hopeful = (
        extra.join(limits, "question_id")
        .join(documents.select("doc_id", "prior"), "doc_id")
        .where(lexical + F.col("bonus") + F.col("prior") + vector_weight + 1e-9 >= F.col("_needed"))
    )
    cosine = dot(F.col("q_vector"), F.col("d_vector"))
    return (
        hopeful.join(context.select("question_id", F.col("vector").alias("q_vector")), "question_id")
        .join(documents.select("doc_id", F.col("vector").alias("d_vector")), "doc_id")
        .withColumn("cosine", cosine)
        .withColumn(
            "score",
            lexical + vector_weight * scaled(F.col("cosine"), F.col("cos_low"), F.col("cos_high")) + F.col("prior") + F.col("bonus"),
        )
        .select("question_id", "doc_id", "score", "bm25", "cosine")
    )


def _scanned_hits(
    index: SearchIndex, wanted: DataFrame, plans: DataFrame, documents: DataFrame, bonus: DataFrame | None, weights: tuple[float, float], k: int
) -> DataFrame:
    """The same pairs without storing any others: each task scores its documents and keeps the ``k`` best of a block.

    ``plans`` are the questions with all that their scores need; those with a known term or a bonus are held by every task.
    """
    lexical_weight, vector_weight = weights
    concerned = wanted.select("question_id")
    held = index.bags
    if bonus is not None:
        concerned = concerned.unionByName(bonus.select("question_id"))
        of_doc = bonus.groupBy("doc_id").agg(F.collect_list(F.struct("question_id", "bonus")).alias("b"))
        of_doc = of_doc.select("doc_id", F.col("b.question_id").alias("bonus_questions"), F.col("b.bonus").alias("bonuses"))
        held = held.join(of_doc, "doc_id", "full")
    held = held.join(documents.select("doc_id", F.col("prior").cast("double").alias("prior")), "doc_id").join(documents.select("doc_id", "vector"), "doc_id")
    plan = plans.join(concerned.distinct(), "question_id", "left_semi").toArrow()
    ids = plan["question_id"].combine_chunks()
    asked = _asked(index, wanted, ids)
    at = pc.index_in(ids, value_set=asked.ids).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = {c: plan[c].to_numpy().astype(np.float64) for c in ("bm_low", "bm_high", "cos_low", "cos_high", "_needed")}
    toward = np.array(plan["q_vector"].to_pylist(), dtype=np.float64).reshape(len(ids), -1 if len(ids) else 0)

    def spread(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        wide = high > low
        return np.where(wide, (value - low) / np.where(wide, high - low, 1.0), 0.0)

    raised = bonus is not None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = bounds["_needed"].copy()
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            docs = batch.column("doc_id")
            order = np.empty(len(docs), dtype=np.int64)
            order[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
            prior = batch.column("prior").to_numpy(zero_copy_only=False).astype(np.float64)
            vectors_of = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(docs), -1 if toward.shape[1] else 0)
            for low, scores, shared in _score_blocks(asked, batch):
                rows = slice(low, low + len(scores))
                extra = _bonuses(batch.slice(low, len(scores)), asked.ids) if raised else None
                bm25, cosine = scores[:, at], vectors_of[rows] @ toward.T
                total = lexical_weight * spread(bm25, bounds["bm_low"], bounds["bm_high"])
                total += vector_weight * spread(cosine, bounds["cos_low"], bounds["cos_high"]) + prior[rows, None]
                met = shared[:, at]
                if extra is not None:
                    total += extra[0][:, at]
                    met = met | extra[1][:, at]
                met = met & (total + 1e-9 >= needed)
                for column in np.flatnonzero(met.sum(axis=0) > k):
                    doc = np.flatnonzero(met[:, column])
                    value = np.round(total[doc, column], 12)
                    best = np.lexsort((order[rows][doc], -value))[:k]
                    met[:, column] = False
                    met[doc[best], column] = True
                    needed[column] = max(needed[column], value[best[-1]])
                doc, question = np.nonzero(met)
                columns = [ids.take(pa.array(question)), docs.take(pa.array(doc + low)), *[pa.array(v[met]) for v in (total, bm25, cosine)]]
                yield pa.RecordBatch.from_arrays(columns, ["question_id", "doc_id", "score", "bm25", "cosine"])

    kinds = f"question_id {_type(plans, 'question_id')}, doc_id {_type(documents, 'doc_id')}, score double, bm25 double, cosine double"
    return held.mapInArrow(score, kinds)


def _bonuses(batch: pa.RecordBatch, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bonus of every document and question of a block, and where there is one."""
    questions = batch.column("bonus_questions")
    doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(questions), 0).to_numpy(zero_copy_only=False))
    at = pc.fill_null(pc.index_in(questions.flatten(), value_set=ids), -1).to_numpy(zero_copy_only=False)
    value = batch.column("bonuses").flatten().to_numpy(zero_copy_only=False)
    cell, value = (doc * len(ids) + at)[at >= 0], value[at >= 0]
    size = batch.num_rows * len(ids)
    shape = (batch.num_rows, len(ids))
    return np.bincount(cell, value, size).reshape(shape), np.bincount(cell, minlength=size).reshape(shape) > 0


def fused_top(
    index: SearchIndex,
    questions: DataFrame,
    documents: DataFrame,
    k: int,
    lexical_weight: float = LEXICAL_WEIGHT,
    vector_weight: float = VECTOR_WEIGHT,
    bonus: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best documents per question by lexical, vector and prior scores together.

    ``questions`` ``(question_id, text[, vector])``, ``documents`` ``(doc_id, prior[, vector])``,
    ``bonus`` ``(question_id, doc_id, bonus)`` with values of zero or more. Without vectors
    the vector term is zero. A column ``k`` of the questions asks for fewer than ``k`` documents.

    The best documents by the dense part alone give a lower bound of the k-th score, and only lexical
    matches that reach it leave their task, at most ``k`` of a block for each question. Negative lexical
    scores widen the dense list, which keeps the result exact. Where the questions are too many for every task, lexical
    matches are stored and scored in full only when their upper bound reaches the k-th score.
    """
    with_vectors = "vector" in documents.columns
    if with_vectors:
        documents, questions = sound_vectors(documents, questions), sound_vectors(questions, questions)
    asked = _wanted(index, questions)
    scanned = size_in_bytes(asked) <= BROADCAST_LIMIT
    scores = None if scanned else cut_lineage(_scores(index, asked))
    ranges = _scanned_range(index, asked, questions) if scanned else lexical_range(index, scores, questions)
    wanted = F.least(F.col("k"), F.lit(k)) if "k" in questions.columns else F.lit(k)
    context = questions.drop("text").withColumn("k", wanted).join(ranges, "question_id")
    context = context.withColumn("keep", (F.col("k") + F.col("negative")).cast("int"))
    if with_vectors:
        documents = cut_lineage(documents.select("doc_id", "vector", "prior"))
        near = vectors.build(documents)
        context = context.join(cosine_range(questions, near.without_priors()), "question_id", "left")
    else:
        context = context.withColumns({"cos_low": F.lit(0.0), "cos_high": F.lit(0.0), "vector": F.array(F.lit(0.0))})
        documents = documents.withColumn("vector", F.array(F.lit(0.0)))
    context = cut_lineage(context)
    if with_vectors:
        dense_side = context.select("question_id", "vector", "cos_low", "cos_high", "keep")
        dense = best_dense(dense_side, near, vector_weight)
    else:
        dense = best_prior(context.select("question_id", "keep"), documents)
    dense = cut_lineage(dense)

    least = dense.groupBy("question_id").agg(F.min("dense").alias("_least"), F.count(F.lit(1)).alias("_listed"))
    limits = context.drop("vector").join(least, "question_id", "left").withColumn(
        "_needed",
        F.when(F.col("_listed") >= F.col("keep"), F.col("_least") + lexical_weight * scaled(F.lit(0.0), F.col("bm_low"), F.col("bm_high")))
        .otherwise(F.lit(float("-inf"))),
    )
    weights = (lexical_weight, vector_weight)
    if scanned:
        plans = limits.join(context.select("question_id", F.col("vector").alias("q_vector")), "question_id")
        sparse_hits = _scanned_hits(index, asked, plans, documents, bonus, weights, k)
        # of the matches of other documents nothing is needed
        near_docs = replace(index, bags=index.bags.join(dense.select("doc_id").distinct(), "doc_id", "left_semi"))
        extra = _with_bonus(_scores(near_docs, asked), bonus)
    else:
        extra = _with_bonus(scores, bonus)
        sparse_hits = _joined_hits(extra, limits, context, documents, weights)
    dense_hits = (
        dense.drop("keep").join(extra.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")
        .join(context.select("question_id", "bm_low", "bm_high"), "question_id")
        .select(
            "question_id",
            "doc_id",
            (F.col("dense") + lexical_weight * scaled(F.lit(0.0), F.col("bm_low"), F.col("bm_high"))).alias("score"),
            F.lit(0.0).alias("bm25"),
            "cosine",
        )
    )
    # scores are compared at twelve digits: the same sum in another order is still a tie
    order = [F.round("score", 12).desc(), F.col("doc_id").asc()]
    top = top_k_per_group(sparse_hits.unionByName(dense_hits), ["question_id"], order, k)
    if "k" not in questions.columns:
        return top
    return top.join(context.select("question_id", "k"), "question_id").where(F.col("rank") <= F.col("k")).drop("k")


def column_bonus(index: SearchIndex, questions: DataFrame, columns: DataFrame, leading: int = COLUMN_HITS) -> DataFrame:
    """Best column per dataset among the ``leading`` columns: ``(question_id, dataset_id, score, name)``.

    ``columns`` ``(doc_id, dataset_id, name[, vector])``; both score parts weigh the same,
    without vectors the lexical one counts alone.
    """
    weights = (0.5, 0.5) if "vector" in columns.columns else (1.0, 0.0)
    documents = columns.withColumn("prior", F.lit(0.0))
    hits = fused_top(index, questions, documents, leading, *weights)
    named = hits.join(columns.select("doc_id", "dataset_id", "name"), "doc_id")
    first = top_k_per_group(named.drop("rank"), ["question_id", "dataset_id"], [F.round("score", 12).desc(), F.col("doc_id").asc()], 1)
    return first.select("question_id", "dataset_id", "score", "name")


def hybrid_search(
    index: SearchIndex, questions: DataFrame, documents: DataFrame, k: int = 8, columns: DataFrame | None = None
) -> DataFrame:
    """Ranked datasets per question. ``documents`` ``(doc_id, rows[, vector])``; ``columns`` is
    the result of ``column_bonus``."""
    prior = ROWS_WEIGHT * F.log10(F.col("rows") + F.lit(1.0))
    bonus = None
    if columns is not None:
        bonus = columns.select("question_id", F.col("dataset_id").alias("doc_id"), (COLUMN_WEIGHT * F.col("score")).alias("bonus"))
        bonus = bonus.join(documents.select("doc_id"), "doc_id", "left_semi").select("question_id", "doc_id", "bonus")
    return fused_top(index, questions, documents.withColumn("prior", prior), k, bonus=bonus)


def full_search(
    index: SearchIndex,
    column_index: SearchIndex,
    questions: DataFrame,
    documents: DataFrame,
    columns: DataFrame,
    dictionary: Dictionary,
    k: int = 8,
    leading: int = COLUMN_HITS,
) -> DataFrame:
    """Ranked datasets by all parts of the score, with the column that matched best.

    Questions ``(question_id, text[, vector, k])`` are widened by the dictionary; ``index`` and ``documents`` are those of
    ``hybrid_search``, ``column_index`` and ``columns`` those of ``column_bonus``.
    """
    asked = cut_lineage(questions.withColumn("text", dictionary.expand("text")))
    told = cut_lineage(column_bonus(column_index, asked.drop("k"), columns, leading))
    matched = told.select("question_id", F.col("dataset_id").alias("doc_id"), F.col("name").alias("matched_column"))
    return hybrid_search(index, asked, documents, k, told).join(matched, ["question_id", "doc_id"], "left")


def confidence(cosine: Column, bm25: Column, asked_region: Column, own_region: Column) -> Column:
    """How far to trust a hit: both scores, and the place it covers."""
    lexical = bm25 > 2
    base = (
        F.when((cosine >= 0.87) | ((cosine >= 0.85) & lexical), "high")
        .when((cosine >= 0.84) | lexical, "medium")
        .otherwise("low")
    )
    elsewhere = asked_region.isNotNull() & own_region.isNotNull() & (asked_region != own_region)
    return F.when(elsewhere, "low").otherwise(base)


def merge_parts(hits: DataFrame, k: int = 8) -> DataFrame:
    """One ranking from the hits of a whole question (part 0) and of its parts.

    ``hits`` ``(question_id, part, rank, doc_id, score)`` with ranks from 1. The best copy of
    a dataset stays; among equals the earlier part.
    """
    factor = F.when(F.col("part") == 0, 1.0).otherwise(1.15)
    adjusted = F.round(F.round("score", 3) * factor - 0.02 * (F.col("rank") - 1), 3)
    rated = hits.withColumn("score", adjusted).drop("rank")
    single = top_k_per_group(rated, ["question_id", "doc_id"], [F.col("score").desc(), F.col("part").asc()], 1)
    order = [F.col("score").desc(), F.col("part").asc(), F.col("doc_id").asc()]
    return top_k_per_group(single.drop("rank"), ["question_id"], order, k)


def seeds_first(merged: DataFrame, seeds: DataFrame, k: int = 8) -> DataFrame:
    """Move the chosen datasets ``(question_id, doc_id)`` to the front of a ranking, and cut it to ``k`` or to all of them."""
    marked = merged.join(seeds.select("question_id", "doc_id", F.lit(0).alias("_seed")).distinct(), ["question_id", "doc_id"], "left")
    order = Window.partitionBy("question_id").orderBy(F.coalesce("_seed", F.lit(1)), "rank")
    ranked = marked.withColumn("rank", F.row_number().over(order))
    # seeds lead, so a row beyond k stays only as one of them
    return ranked.where((F.col("rank") <= k) | F.col("_seed").isNotNull()).drop("_seed")


def intent_boost(
    merged: DataFrame, questions: DataFrame, datasets: DataFrame, rules: list[str], region: Column, asked: Column | None = None
) -> DataFrame:
    """Force the best dataset of each listed title pattern to the top of matching questions.

    ``datasets`` ``(doc_id, title, rows, default_region)``. For every pattern the best dataset
    of each place (regional titles first, then more rows) is found once; a question then
    takes the best among those of its place and those without a place.
    """
    preferred = F.when(F.contains("title", F.lit("지역별")), 0).otherwise(1)
    fits = F.array(*[F.when(F.col("title").rlike(pattern), F.lit(at)) for at, pattern in enumerate(rules)])
    found = datasets.withColumn("rule", F.explode(F.filter(fits, lambda r: r.isNotNull())))
    order = [F.col("preferred").asc(), F.col("rows").desc(), F.col("doc_id").asc()]
    by_place = top_k_per_group(
        found.withColumn("preferred", preferred), ["rule", "default_region"], order, 1
    ).drop("rank", "title")
    anywhere = top_k_per_group(by_place, ["rule"], order, 1).drop("rank", "default_region").withColumn("place", F.lit("*"))
    local = by_place.withColumn("place", F.coalesce("default_region", F.lit(""))).drop("default_region")
    options = local.unionByName(anywhere)
    concerned = questions.where(asks_about_heat("text") if asked is None else asked).select("question_id", region.alias("_region"))
    places = F.when(F.col("_region").isNull(), F.array(F.lit("*"))).otherwise(F.array("_region", F.lit("")))
    wanted = concerned.select("question_id", F.explode(places).alias("place"))
    chosen = top_k_per_group(wanted.join(options, "place"), ["question_id", "rule"], order, 1).select("question_id", "doc_id", "rule")
    chosen = chosen.groupBy("question_id", "doc_id").agg(F.max("rule").alias("rule"))
    # positions count only the patterns that found something
    top = merged.groupBy("question_id").agg(F.max("score").alias("_top"))
    filled = chosen.join(top, "question_id", "left")
    offset = _offset(wanted, options, order)
    boosted = filled.join(offset, ["question_id", "rule"]).select(
        "question_id", "doc_id", F.round(F.coalesce("_top", F.lit(0.0)) + 1.0 - 0.01 * F.col("offset"), 3).alias("forced")
    )
    both = merged.select("question_id", "doc_id", "score").join(boosted, ["question_id", "doc_id"], "full")
    return both.select(
        "question_id", "doc_id", F.coalesce("forced", "score").alias("score"), F.col("forced").isNotNull().alias("forced")
    )


def _offset(wanted: DataFrame, options: DataFrame, order: list[Column]) -> DataFrame:
    hit = wanted.join(options, "place").select("question_id", "rule").distinct()
    window = Window.partitionBy("question_id").orderBy("rule")
    return hit.withColumn("offset", F.row_number().over(window) - 1)


def search_mode(questions: DataFrame, parts: DataFrame, sets: DataFrame, first_hits: DataFrame) -> DataFrame:
    """Per question: preferred level, ``join`` or ``single``, and whether the first hit is weak.

    ``parts`` ``(question_id, n_parts)``, ``sets`` and ``first_hits`` ``(question_id, confidence)``.
    """
    known_sets = sets.select("question_id").distinct().withColumn("_sets", F.lit(True))
    several = (F.coalesce("n_parts", F.lit(0)) >= 2) | asks_to_join("text")
    return (
        questions.join(parts, "question_id", "left")
        .join(known_sets, "question_id", "left")
        .join(first_hits.select("question_id", "confidence"), "question_id", "left")
        .select(
            "question_id",
            preferred_level("text").alias("prefer"),
            F.when(several & F.col("_sets").isNotNull(), "join").otherwise("single").alias("mode"),
            F.coalesce(F.col("confidence") == "low", F.lit(False)).alias("weak_match"),
        )
    )
