"""Which datasets can be joined, measured from their keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.keys import Gazetteer
from keyweave.operators.sorting import top_k_per_group
from keyweave.session import cut_lineage

# Measurement thresholds (fixed values).
MINIMUM_RATE = 0.30
MINIMUM_KEYS = 3
SAMPLE_KEYS = 5
MAXIMUM_MEMBERS = 4
SETS_KEPT = 6

# Rows of one posting list (or of one class of equal key sets) that meet in one join group.
BLOCK = 512
# Keys of a set that are compared in one row, on average.
BLOCK_KEYS = 1024


def keys_by_level(long: DataFrame, gazetteer: Gazetteer, default: Column | None = None) -> DataFrame:
    """City and town keys of every value in long form; values without a key vanish."""
    levels = F.array(
        F.struct(F.lit("sgg").alias("level"), gazetteer.city("value").alias("k")),
        F.struct(F.lit("emd").alias("level"), gazetteer.town("value", default).alias("k")),
    )
    return long.select("dataset_id", "column", F.inline(levels)).where(F.col("k").isNotNull())


def candidate_columns(entries: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Columns that may hold a key: region columns, then text columns with a key in a sample."""
    columns = entries.select(
        "dataset_id",
        "default_region",
        F.posexplode("columns").alias("at", "c"),
    ).select("dataset_id", "default_region", "at", F.col("c.name").alias("column"), "c.role", "c.samples")
    role = F.col("role")
    by_role = role.startswith("region") | (role == "sido")
    home = F.col("default_region")
    by_sample = role.isin("text", "code") & F.exists(
        "samples", lambda s: gazetteer.city(s).isNotNull() | gazetteer.town(s, home).isNotNull()
    )
    return columns.where(by_role | by_sample).select(
        "dataset_id", "column", (F.when(by_role, 0).otherwise(1_000_000) + F.col("at")).alias("priority")
    )


def best_key_columns(keys: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """The column with most distinct keys per dataset and level (at least three)."""
    counted = (
        keys.select("dataset_id", "level", "column", "k")
        .distinct()
        .groupBy("dataset_id", "level", "column")
        .agg(F.count(F.lit(1)).alias("n_keys"))
        .where(F.col("n_keys") >= MINIMUM_KEYS)
    )
    if priority is not None:
        counted = counted.join(priority, ["dataset_id", "column"])
    order = [F.col("n_keys").desc(), *([F.col("priority").asc()] if priority is not None else []), F.col("column").asc()]
    return top_k_per_group(counted, ["dataset_id", "level"], order, 1).select("dataset_id", "level", "column", "n_keys")


def region_keys(best: DataFrame) -> DataFrame:
    """Best columns as one map per dataset: level to column name."""
    return best.groupBy("dataset_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "column")))).alias("region_keys")
    )


def measure_pairs(key_table: DataFrame, datasets: DataFrame) -> DataFrame:
    """Key overlap of every pair of datasets at one level, from 30 percent of the smaller side.

    ``key_table`` holds ``(level, dataset_id, k)``, ``datasets`` ``(dataset_id, parent)``.

    Datasets whose key sets are equal form one class and are measured once. Of two classes the
    smaller one must hold 30 percent of its keys in common, so they share one of its rarest 70
    percent: only those keys look for partners, in an inverted index whose posting lists are cut
    into blocks. Each pair found so is measured once, block of keys by block of keys; common keys
    of low value, such as one that every dataset has, bring no pairs together.
    """
    keys = cut_lineage(key_table.select("level", "dataset_id", "k").where(F.col("k").isNotNull()).distinct())
    members = cut_lineage(_classes(keys))
    reps = members.where(F.col("dataset_id") == F.col("rep")).select("level", "rep", "n_keys")
    postings = cut_lineage(keys.withColumnRenamed("dataset_id", "rep").join(reps, ["level", "rep"]))
    blocks = cut_lineage(_key_blocks(postings))
    sampled = cut_lineage(_measured(_candidates(postings), blocks).unionByName(_twins(blocks)))
    pairs = _expand(sampled, members, datasets)
    return pairs.select(
        "level",
        "a",
        "b",
        "a_keys",
        "b_keys",
        "matched",
        F.round("_rate", 3).alias("match_rate"),
        (F.col("a_keys") - F.col("matched")).alias("dropped_a"),
        (F.col("b_keys") - F.col("matched")).alias("dropped_b"),
        F.concat_ws("|", "sample_matched").alias("sample_matched"),
        F.concat_ws("|", "sample_unmatched").alias("sample_unmatched"),
    )


def _classes(keys: DataFrame) -> DataFrame:
    """Datasets with their class representative: the first dataset with an equal key set.

    Sets are recognised by size and two independent 64-bit hashes combined without order, and compared
    key by key with the representative's; a set that only shares the hashes stays by itself.
    """
    prints = ["level", "n_keys", "print1", "print2"]
    signed = keys.groupBy("level", "dataset_id").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.bit_xor(F.xxhash64("k")).alias("print1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "k")).alias("print2"),
    )
    first = signed.groupBy(*prints).agg(F.min("dataset_id").alias("rep"))
    placed = cut_lineage(signed.join(first, prints).select("level", "dataset_id", "rep", "n_keys"))
    twins = placed.where(F.col("dataset_id") != F.col("rep"))
    theirs = keys.join(twins, ["level", "dataset_id"]).select("level", "dataset_id", "rep", "k", "n_keys")
    held = theirs.join(keys.withColumnRenamed("dataset_id", "rep"), ["level", "rep", "k"], "left_semi")
    equal = held.groupBy("level", "dataset_id", "n_keys").agg(F.count(F.lit(1)).alias("_equal")).where(F.col("_equal") == F.col("n_keys"))
    same = placed.join(equal.select("level", "dataset_id", F.lit(True).alias("_same")), ["level", "dataset_id"], "left")
    return same.select(
        "level", "dataset_id", F.when(F.col("_same"), F.col("rep")).otherwise(F.col("dataset_id")).alias("rep"), "n_keys"
    )


def _candidates(postings: DataFrame) -> DataFrame:
    """``(level, a, a_keys, b, b_keys)`` for classes that share one of the rarest keys of the smaller one, ``a``.

    Keys are ordered by how many classes hold them and then by a hash. How far a class's rarest keys
    reach is read from a histogram of that order, so its keys are never sorted in one place; keys beyond the
    exact bound that share its last step are looked up too.
    """
    lengths = postings.groupBy("level", "k").agg(F.count(F.lit(1)).alias("held"))
    step = F.struct("held", F.pmod(F.xxhash64(F.lit("order"), "k"), F.lit(16)).alias("h"))
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    placed = cut_lineage(
        postings.join(lengths, ["level", "k"]).select(
            "level", "rep", "n_keys", "k", step.alias("step"), blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own")
        )
    )
    steps = placed.groupBy("level", "rep", "n_keys", "step").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("level", "rep").orderBy("step"))
    # a shade less than the bound, so that rounding can't shorten the reach
    needed = F.greatest(F.ceil(MINIMUM_RATE * F.col("n_keys") - 1e-6), F.lit(1))
    reach = (
        steps.withColumn("so_far", so_far)
        .where(F.col("so_far") > F.col("n_keys") - needed)
        .groupBy("level", "rep")
        .agg(F.min("step").alias("last"))
    )
    rare = placed.join(reach, ["level", "rep"]).where(F.col("step") <= F.col("last"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        return rows.select(
            "level", "k", F.col("rep").alias(name), F.col("n_keys").alias(f"{name}_keys"), F.col("own").alias(own), others.alias(other)
        )

    met = side(rare, "a", "row", "col").join(side(placed, "b", "col", "row"), ["level", "k", "row", "col"])
    smaller = F.struct("a_keys", "a") < F.struct("b_keys", "b")
    return met.where(smaller).select("level", "a", "a_keys", "b", "b_keys").distinct()


def _parts(size: str) -> Column:
    return F.expr(f"shiftleft(1, int(ceil(log2(greatest({size} / {BLOCK_KEYS}D, 1D)))))")


def _key_blocks(postings: DataFrame) -> DataFrame:
    """``(level, rep, n_keys, parts, part, ks)``: key sets as parts of bounded size.

    The number of parts is a power of two, so the parts of a set are unions of those of any finer one.
    """
    return (
        postings.withColumn("parts", _parts("n_keys"))
        .groupBy("level", "rep", "n_keys", "parts", F.pmod(F.xxhash64("k"), "parts").cast("int").alias("part"))
        .agg(F.collect_list("k").alias("ks"))
    )


def _first(keys: Column) -> Column:
    return F.slice(F.array_sort(keys), 1, SAMPLE_KEYS)


def _measured(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Matched keys, rate and first matched and unmatched keys of pairs that reach the minimum rate."""
    none = F.array().cast("array<string>")

    spread = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), _parts("b_keys") - 1))).withColumn("a_part", F.pmod("part", _parts("a_keys")))
    small = blocks.select("level", F.col("rep").alias("a"), F.col("part").alias("a_part"), F.col("ks").alias("_a"))
    large = blocks.select("level", F.col("rep").alias("b"), "part", F.col("ks").alias("_b"))
    # only the smaller set's keys of this part travel to the larger set's part
    own = F.filter("_a", lambda k: F.pmod(F.xxhash64(k), _parts("b_keys")) == F.col("part"))
    carried = spread.join(small, ["level", "a", "a_part"], "left").withColumn("_a", F.coalesce(own, none))
    both = carried.join(large, ["level", "b", "part"], "left").withColumn("_b", F.coalesce("_b", none))
    met = both.withColumns(
        {"_same": F.array_intersect("_a", "_b"), "_apart": F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a"))}
    )
    first = [_first(F.col(f"_{kind}")).alias(kind) for kind in ("same", "apart")]
    met = met.select("level", "a", "a_keys", "b", "b_keys", F.size("_same").alias("n"), *first)
    return (
        met.groupBy("level", "a", "a_keys", "b", "b_keys")
        .agg(
            F.sum("n").alias("matched"),
            _first(F.flatten(F.collect_list("same"))).alias("sample_matched"),
            _first(F.flatten(F.collect_list("apart"))).alias("sample_unmatched"),
        )
        .withColumn("_rate", F.col("matched") / F.col("a_keys"))
        .where(F.col("_rate") >= MINIMUM_RATE)
    )


def _twins(blocks: DataFrame) -> DataFrame:
    """Every class with itself, for the datasets that share it."""
    return blocks.groupBy("level", F.col("rep").alias("a"), F.col("n_keys").alias("a_keys")).agg(
        F.first("rep").alias("b"),
        F.first("n_keys").alias("b_keys"),
        F.first("n_keys").alias("matched"),
        _first(F.flatten(F.collect_list(_first(F.col("ks"))))).alias("sample_matched"),
        F.array().cast("array<string>").alias("sample_unmatched"),
        F.lit(1.0).alias("_rate"),
    )


def _expand(class_pairs: DataFrame, members: DataFrame, datasets: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of datasets of different parents, in bounded blocks."""
    owned = members.join(datasets.select("dataset_id", "parent"), "dataset_id")
    sizes = owned.groupBy("level", "rep").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = owned.join(sizes, ["level", "rep"]).withColumn("block", F.pmod(F.xxhash64("dataset_id"), F.col("blocks")).cast("int"))

    def side(name: str) -> DataFrame:
        return placed.select(
            "level",
            F.col("rep").alias(name),
            F.col("block").alias(f"{name}_block"),
            F.col("dataset_id").alias(f"{name}_id"),
            F.col("parent").alias(f"{name}_parent"),
        )

    counts = sizes.select("level", "rep", "blocks")
    spread = (
        class_pairs.join(counts.withColumnsRenamed({"rep": "a", "blocks": "_na"}), ["level", "a"])
        .join(counts.withColumnsRenamed({"rep": "b", "blocks": "_nb"}), ["level", "b"])
        .withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
        .withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    )
    both = spread.join(side("a"), ["level", "a", "a_block"]).join(side("b"), ["level", "b", "b_block"])
    same_class = F.col("a") == F.col("b")
    kept = both.where(
        (F.col("a_parent") != F.col("b_parent")) & (~same_class | (F.col("a_id") < F.col("b_id")))
    )
    swap = F.col("a_id") > F.col("b_id")

    def oriented(left: str, right: str) -> Column:
        return F.when(swap, F.col(right)).otherwise(F.col(left))

    return kept.select(
        "level",
        oriented("a_id", "b_id").alias("a"),
        oriented("b_id", "a_id").alias("b"),
        oriented("a_keys", "b_keys").alias("a_keys"),
        oriented("b_keys", "a_keys").alias("b_keys"),
        "matched",
        "_rate",
        "sample_matched",
        "sample_unmatched",
    )


def with_key_columns(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """Measured pairs with the columns they join on: ``a_col`` and ``b_col``.

    ``best`` is the result of ``best_key_columns``.
    """
    for side in ("a", "b"):
        columns = best.select("level", F.col("dataset_id").alias(side), F.col("column").alias(f"{side}_col"))
        pairs = pairs.join(columns, ["level", side], "left")
    return pairs


def both_directions(pairs: DataFrame) -> DataFrame:
    """Measured pairs as edges that can be walked from either side: ``(a, other, level, ...)``."""
    forward = pairs.select("a", F.col("b").alias("other"), "level", "matched", "match_rate")
    backward = pairs.select(F.col("b").alias("a"), F.col("a").alias("other"), "level", "matched", "match_rate")
    return forward.unionByName(backward)


def neighbours(edges: DataFrame, minimum: float = 0.5, k: int = 10) -> DataFrame:
    """The best-matching partners of every dataset, one per partner and level."""
    order = [F.col("match_rate").desc(), F.col("matched").desc()]
    near = edges.where(F.col("match_rate") >= minimum)
    single = top_k_per_group(near, ["a", "other", "level"], order, 1).drop("rank")
    return top_k_per_group(single, ["a"], [*order, F.col("other").asc(), F.col("level").desc()], k)


def joinable_sets(
    seeds: DataFrame,
    candidates: DataFrame,
    edges: DataFrame,
    minimum: float = 0.5,
    most_members: int = MAXIMUM_MEMBERS,
    kept: int = SETS_KEPT,
) -> DataFrame:
    """Sets of datasets that all join each other, grown greedily around each seed.

    ``seeds`` ``(question_id, seed, seed_pos)`` and ``candidates`` ``(question_id, candidate,
    candidate_pos)`` are the few hits of each question. The pool of a seed is ordered by match rate;
    a candidate joins when it is adjacent to every member.
    """
    near = edges.where(F.col("match_rate") >= minimum).select("a", "other", "level", "match_rate", "matched")
    group = ["question_id", "seed", "seed_pos", "level"]
    seeds = seeds.groupBy("question_id", "seed").agg(F.min("seed_pos").alias("seed_pos"))
    candidates = candidates.groupBy("question_id", "candidate").agg(F.min("candidate_pos").alias("candidate_pos"))
    pool = (
        seeds.join(near.withColumnRenamed("a", "seed"), "seed")
        .join(candidates.withColumnRenamed("candidate", "other"), ["question_id", "other"])
        .where(F.col("other") != F.col("seed"))
        .select(*group, F.col("other").alias("c"), "candidate_pos", "match_rate")
    )
    reach = near.select(
        F.col("a").alias("c"), "level", F.col("other").alias("friend"), F.col("match_rate").alias("friend_rate")
    )
    friends = (
        pool.select(*group, "c")
        .join(reach, ["c", "level"])
        .join(pool.select(*group, F.col("c").alias("friend")), [*group, "friend"])
        .groupBy(*group, "c")
        .agg(F.collect_list(F.struct("friend", "friend_rate")).alias("friends"))
    )
    item = F.struct((-F.col("match_rate")).alias("order"), "candidate_pos", "c", "match_rate", "friends")
    pools = pool.join(friends, [*group, "c"], "left").groupBy(*group).agg(
        F.transform(
            F.array_sort(F.collect_list(item)),
            lambda c: F.struct(
                c["c"].alias("c"),
                c["match_rate"].alias("match_rate"),
                F.map_from_entries(F.coalesce(c["friends"], F.array())).alias("friends"),
            ),
        ).alias("pool")
    )

    start = F.struct(F.array(F.col("seed")).alias("members"), F.lit(1.0).cast("double").alias("low"))

    def grow(acc: Column, c: Column) -> Column:
        grown = F.slice(acc["members"], 2, most_members)
        fits = (F.size(acc["members"]) < most_members) & F.forall(grown, lambda m: F.map_contains_key(c["friends"], m))
        low = F.array_min(F.concat(F.array(acc["low"], c["match_rate"]), F.transform(grown, lambda m: c["friends"][m])))
        return F.when(
            fits, F.struct(F.concat(acc["members"], F.array(c["c"])).alias("members"), low.alias("low"))
        ).otherwise(acc)

    sets = pools.select(*group, F.aggregate("pool", start, grow).alias("grown")).select(
        *group, F.col("grown.members").alias("members"), F.col("grown.low").alias("min_match_rate")
    )
    level_order = F.when(F.col("level") == "sgg", 0).otherwise(1)
    order = [
        F.round("min_match_rate", 1).desc(),
        F.size("members").desc(),
        F.col("min_match_rate").desc(),
        F.col("seed_pos").asc(),
        level_order.asc(),
    ]
    single = top_k_per_group(
        sets.withColumn("_set", F.array_sort("members")), ["question_id", "level", "_set"], order, 1
    ).drop("rank", "_set")
    return top_k_per_group(single, ["question_id"], order, kept)


def set_links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """How the members of every set join: ``(question_id, rank, links)``, one link per pair in member order.

    ``sets`` as from ``joinable_sets``, ``pairs`` as from ``with_key_columns``; a link is
    ``struct(a, b, a_col, b_col, match_rate, matched)``.
    """
    placed = sets.select("question_id", "rank", "level", F.posexplode("members").alias("at", "id"))
    group = ["question_id", "rank", "level"]
    two = placed.withColumnsRenamed({"at": "a_at", "id": "a_id"}).join(placed.withColumnsRenamed({"at": "b_at", "id": "b_id"}), group)
    two = two.where(F.col("a_at") < F.col("b_at")).withColumns({"a": F.least("a_id", "b_id"), "b": F.greatest("a_id", "b_id")})
    known = two.join(pairs.select("level", "a", "b", "a_col", "b_col", "match_rate", "matched"), ["level", "a", "b"])
    turned = F.col("a_id") != F.col("a")
    link = F.struct(
        "a_at",
        "b_at",
        F.struct(
            F.col("a_id").alias("a"),
            F.col("b_id").alias("b"),
            F.when(turned, F.col("b_col")).otherwise(F.col("a_col")).alias("a_col"),
            F.when(turned, F.col("a_col")).otherwise(F.col("b_col")).alias("b_col"),
            "match_rate",
            "matched",
        ).alias("link"),
    )
    return known.groupBy("question_id", "rank").agg(F.array_sort(F.collect_list(link)).getField("link").alias("links"))


def best_combination(parts: DataFrame, edges: DataFrame, prefer: Column | None = None) -> DataFrame:
    """For each question one candidate per part such that the worst pair joins best.

    ``parts`` holds ``(question_id, part, rank, dataset_id)`` with at most three candidates
    per part. The pairs known among a question's candidates are gathered with it (a few
    rows), and the search over combinations prunes by an upper bound, so it stays exact.
    """
    ranked = parts.groupBy("question_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("rank", "dataset_id"))).getField("dataset_id").alias("candidates")
    )
    questions = ranked.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "candidates"))).getField("candidates").alias("choices")
    )
    mine = parts.select("question_id", F.col("dataset_id").alias("a")).distinct()
    links = (
        mine.join(edges, "a")
        .join(mine.withColumnRenamed("a", "other"), ["question_id", "other"])
        .groupBy("question_id")
        .agg(F.collect_list(F.struct("a", "other", "level", "match_rate", "matched")).alias("links"))
    )
    preferred = F.lit(None).cast("string") if prefer is None else prefer
    chosen = _choose(F.col("choices"), F.coalesce("links", F.array()), preferred)
    return questions.join(links, "question_id", "left").select("question_id", chosen.alias("members"))


def search_combination(choices: list[list[str]], rate: dict, matched: dict, prefer: str | None) -> list[str]:
    """Depth-first over combinations in candidate order; a branch that cannot win is cut."""
    best: list[str] | None = None
    best_score = -1.0
    factor = {level: 0.8 if prefer and level != prefer else 1.0 for level in ("sgg", "emd")}

    def score(low: float, keys: float, level: str, firsts: int) -> float:
        trust = 1.0 if keys == float("inf") else keys / (keys + 2.0)
        return low * trust * factor[level] + 0.1 * firsts

    def visit(at: int, combo: list[str], state: dict, firsts: int) -> None:
        nonlocal best, best_score
        left = len(choices) - at
        if left == 0:
            if len(combo) < 2:
                return
            for level, (low, keys) in state.items():
                value = score(low, keys, level, firsts)
                if value > best_score:
                    best, best_score = list(combo), value
            return
        if max(score(low, keys, level, firsts + left) for level, (low, keys) in state.items()) <= best_score:
            return
        for rank, candidate in enumerate(choices[at]):
            if candidate in combo:
                continue
            grown = {
                level: (
                    min([low, *(rate.get((m, candidate, level), 0.0) for m in combo)]),
                    min([keys, *(matched.get((m, candidate, level), 0) for m in combo)]),
                )
                for level, (low, keys) in state.items()
            }
            visit(at + 1, [*combo, candidate], grown, firsts + (rank == 0))

    visit(0, [], {"sgg": (1.0, float("inf")), "emd": (1.0, float("inf"))}, 0)
    if best is None or best_score <= 0.06:
        return [candidates[0] for candidates in choices if len(candidates)]
    return best


@F.pandas_udf(T.ArrayType(T.StringType()))
def _choose(choices: pd.Series, links: pd.Series, prefer: pd.Series) -> pd.Series:
    chosen = []
    for parts, known, level in zip(choices, links, prefer):
        rate = {(e["a"], e["other"], e["level"]): e["match_rate"] for e in known}
        matched = {(e["a"], e["other"], e["level"]): e["matched"] for e in known}
        chosen.append(search_combination([list(p) for p in parts], rate, matched, level))
    return pd.Series(chosen)


def structure_edges(entries: DataFrame) -> DataFrame:
    """Edges from datasets to their topic, keywords and columns."""
    subject = F.concat(F.lit("ds:"), "dataset_id")
    topics = entries.where(F.col("category") != "").select(
        subject.alias("s"), F.lit("topic_of").alias("p"), F.concat(F.lit("topic:"), "category").alias("o")
    )
    tags = entries.select(subject.alias("s"), F.explode("keywords").alias("kw")).select(
        "s", F.lit("tagged").alias("p"), F.concat(F.lit("kw:"), "kw").alias("o")
    )
    columns = entries.select(subject.alias("s"), "dataset_id", F.explode("columns").alias("c")).select(
        "s", F.lit("has_column").alias("p"), F.concat(F.lit("col:"), "dataset_id", F.lit("."), "c.name").alias("o")
    )
    return topics.unionByName(tags).unionByName(columns)


def joinable_edges(pairs: DataFrame) -> DataFrame:
    """Measured pairs as edges: ``(s, p, o, on, a_col, b_col, matched, match_rate)``; ``pairs`` as from ``with_key_columns``."""
    return pairs.select(
        F.concat(F.lit("ds:"), "a").alias("s"),
        F.lit("joinable_by").alias("p"),
        F.concat(F.lit("ds:"), "b").alias("o"),
        F.col("level").alias("on"),
        "a_col",
        "b_col",
        "matched",
        "match_rate",
    )


def structure_nodes(entries: DataFrame) -> DataFrame:
    """Dataset and column nodes."""
    datasets = entries.select(F.concat(F.lit("ds:"), "dataset_id").alias("id"), F.lit("dataset").alias("type"))
    columns = entries.select("dataset_id", F.explode("columns").alias("c")).select(
        F.concat(F.lit("col:"), "dataset_id", F.lit("."), "c.name").alias("id"), F.lit("column").alias("type")
    )
    return datasets.unionByName(columns)


def measured_totals(pairs: DataFrame) -> DataFrame:
    """Joinable and perfectly matching pairs per level."""
    return pairs.groupBy("level").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("match_rate") == 1.0).alias("perfect")
    )
