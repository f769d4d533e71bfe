"""Default and recommended jobs for all datasets or questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.functions.casts import metric_double
from keyweave.functions.keys import Gazetteer
from keyweave.operators.graph import joinable_sets
from keyweave.operators.profile import BOOKKEEPING
from keyweave.operators.sorting import top_k_per_group
from keyweave.session import cut_lineage

# Name parts of columns that identify, date or locate instead of measuring (fixed values).
NOT_MEASURES = (
    "no", "id", "cd", "code", "sn", "row", "seq", "zip", "tel", "telno", "yr", "year", "ym", "mt",
    "month", "de", "dt", "date", "la", "lo", "lat", "lng", "lon", "x", "y", "sm", "se", "ordr", "wdate",
)
NOT_MEASURE_ENDINGS = ("no", "cd", "id")
ROW_NUMBERS = ("spm_row", "ts_row", "innerTableRowNum")

# Name parts of columns worth showing first, of columns to average, and of temperatures (fixed values).
MEASURES = (
    "co", "cnt", "count", "nmpr", "popltn", "total", "sum", "amt", "ar", "cpcty", "qy", "capct", "area",
    "psncpa", "price", "rate", "aceptnc",
)
AVERAGED = (
    "dnsty", "avg", "mean", "rate", "ratio", "temp", "tmprt", "pm10", "pm25", "price", "prc", "unit",
)
TEMPERATURES = r"(?i)max_?temperature|temperature|tmprt|기온|온도"



def _is_measure(name: Column) -> Column:
    low = F.lower(name)
    identifies = low.rlike(rf"(?:^|_)(?:{'|'.join(NOT_MEASURES)})(?:$|_)|(?:{'|'.join(NOT_MEASURE_ENDINGS)})$")
    return ~identifies & ~name.isin(*ROW_NUMBERS)


def suggested_metrics(columns: DataFrame, alias: Column, about_heat: Column | None = None) -> DataFrame:
    """Metrics of every dataset: row count, one measure, one yes/no count.

    ``columns`` ``(dataset_id, column_pos, name, role, samples)``. Returns
    ``(dataset_id, metric_pos, name, agg, column, value)``.
    """
    name = F.col("name")
    heat = F.lit(False) if about_heat is None else about_heat
    measured = columns.where((F.col("role") == "numeric") & _is_measure(name))
    order = [
        F.when(heat & name.rlike(TEMPERATURES), 0).otherwise(1).asc(),
        F.when(name.rlike(f"(?i)(?:{'|'.join(MEASURES)})"), 0).otherwise(1).asc(),
        F.col("column_pos").asc(),
    ]
    first_measure = top_k_per_group(measured, ["dataset_id"], order, 1)
    agg = F.when(name.rlike(f"(?i)(?:{'|'.join(AVERAGED)})"), "avg").otherwise("sum")

    def named(*parts: Column) -> Column:
        return F.concat_ws("_", alias, *parts)

    def metric(df: DataFrame, pos: int, title: Column, agg_: Column, column: Column, value: Column) -> DataFrame:
        return df.select(
            "dataset_id",
            F.lit(pos).alias("metric_pos"),
            title.alias("name"),
            agg_.alias("agg"),
            column.alias("column"),
            value.cast("string").alias("value"),
        )

    yes_no = F.forall("samples", lambda s: s.isin("Y", "N", "y", "n"))
    flags = columns.where((F.col("role") == "text") & (F.size("samples") > 0) & yes_no)
    first_flag = top_k_per_group(flags, ["dataset_id"], [F.col("column_pos").asc()], 1)
    none = F.lit(None)
    counts = metric(
        columns.select("dataset_id").distinct(), 0, F.concat_ws("_", alias, F.lit("count")), F.lit("count"), F.lit("*"), none
    )
    return counts.unionByName(metric(first_measure, 1, named(agg, name), agg, name, none)).unionByName(
        metric(first_flag, 2, named(name, F.lit("Y")), F.lit("count_if"), name, F.lit("Y"))
    )


def single_jobs(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """The default job for one dataset per request.

    ``requests`` ``(request_id, dataset_id, prefer, region)``; ``entries`` needs ``region_keys``,
    ``default_region`` and ``columns``. A place named in the question turns into a filter when
    the dataset covers more than one place; without any key the job lists raw columns.
    """
    keys = F.col("region_keys")
    city, town = keys["sgg"], keys["emd"]
    drill = F.col("region").isNotNull() & F.col("default_region").isNull() & city.isNotNull()
    usual = (
        F.when(F.col("prefer").isin("sgg", "emd") & keys[F.col("prefer")].isNotNull(), F.col("prefer"))
        .when(F.col("default_region").isNotNull() & town.isNotNull(), "emd")
        .when(city.isNotNull(), "sgg")
        .when(town.isNotNull(), "emd")
    )
    level = F.when(drill, F.when(town.isNotNull(), "emd").otherwise("sgg")).otherwise(usual)
    stem = F.expr("substring(region, 1, length(region) - 1)")
    raw = F.filter(F.col("columns.name"), lambda c: ~c.isin(*BOOKKEEPING))
    joined = requests.join(entries.select("dataset_id", "region_keys", "default_region", "columns"), "dataset_id")
    return joined.withColumn("level", level).select(
        "request_id",
        "dataset_id",
        "level",
        keys[F.col("level")].alias("key_column"),
        F.when(drill, city).alias("filter_column"),
        F.when(drill, F.concat(F.lit("%"), stem, F.lit("%"))).alias("filter_like"),
        F.when(F.col("level").isNull(), raw).alias("raw_columns"),
    )


def single_specs(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Default jobs as specs that ``run_spec`` takes: ``(request_id, dataset_id, spec)``.

    ``jobs`` as from ``single_jobs``; ``metrics`` as from ``suggested_metrics`` with an empty alias.
    """
    listed = metrics.groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct("metric_pos", "agg", "column", "value"))).alias("metrics")
    )
    keyed = F.col("level").isNotNull()
    like = F.struct(F.col("filter_column").alias("column"), F.lit("like").alias("op"), F.col("filter_like").alias("value"))
    # fields that are NULL are left out of the text
    source = F.struct(
        F.lit("a").alias("alias"),
        F.col("dataset_id").cast("string").alias("dataset_id"),
        F.when(keyed, F.struct(F.col("key_column").alias("column"), "level")).alias("key"),
        F.when(F.col("filter_column").isNotNull(), F.array(like)).alias("filters"),
        F.when(keyed, F.transform("metrics", lambda m: _metric(m, F.lit("a")))).alias("metrics"),
        F.when(~keyed, F.col("raw_columns")).alias("columns"),
    )
    spec = F.to_json(F.struct(F.array(source).alias("sources")))
    return jobs.join(listed, "dataset_id", "left").select("request_id", "dataset_id", spec.alias("spec"))


def recommended_sets(seeds: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Joinable sets of every question: those holding its first two seeds come first.

    ``seeds`` and ``candidates`` as for ``joinable_sets``; seeds count from position 0.
    """
    direct = joinable_sets(
        seeds.where(F.col("seed_pos") == 0),
        seeds.select("question_id", F.col("seed").alias("candidate"), F.col("seed_pos").alias("candidate_pos")),
        edges,
        0.3,
    )
    leading = (
        seeds.where(F.col("seed_pos") < 2)
        .groupBy("question_id")
        .agg(F.collect_set("seed").alias("_leading"))
        .where(F.size("_leading") == 2)
    )
    holding = direct.join(leading, "question_id").where(F.size(F.array_intersect("members", "_leading")) == 2)
    grown = joinable_sets(seeds.where(F.col("seed_pos") < 3), candidates, edges)
    columns = ["question_id", "level", "members", "min_match_rate", "rank"]
    everything = (
        holding.select(*columns).withColumn("origin", F.lit("direct"))
        .unionByName(grown.select(*columns).withColumn("origin", F.lit("grown")))
    )
    single = top_k_per_group(
        everything.withColumnRenamed("rank", "at"), ["question_id", "level", "members"], [F.col("origin").asc(), F.col("at").asc()], 1
    ).drop("rank")
    ranked = Window.partitionBy("question_id").orderBy("origin", "at")
    return single.withColumn("rank", F.row_number().over(ranked)).drop("at")


def join_jobs(sets: DataFrame, region_keys: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per source of every recommended join: alias, dataset, key column and metrics.

    ``region_keys`` ``(dataset_id, region_keys)``; ``metrics`` as from ``suggested_metrics`` with an
    empty alias, prefixed here by the source's letter.
    """
    sources = sets.select("question_id", "rank", "level", F.posexplode("members").alias("at", "dataset_id")).withColumn(
        "alias", F.char(F.col("at") + 97)
    )
    listed = metrics.groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct("metric_pos", "agg", "column", "value"))).alias("metrics")
    )
    return (
        sources.join(region_keys, "dataset_id", "left")
        .join(listed, "dataset_id", "left")
        .select(
            "question_id",
            "rank",
            "level",
            "alias",
            "dataset_id",
            F.col("region_keys")[F.col("level")].alias("key_column"),
            "metrics",
        )
    )


def _metric_name(m: Column, alias: Column) -> Column:
    parts = F.when(m["metric_pos"] == 0, F.lit("count")).when(m["metric_pos"] == 1, F.concat_ws("_", m["agg"], m["column"]))
    return F.concat_ws("_", alias, parts.otherwise(F.concat_ws("_", m["column"], F.lit("Y"))))


def _metric(m: Column, alias: Column) -> Column:
    return F.struct(_metric_name(m, alias).alias("name"), m["agg"].alias("agg"), m["column"].alias("column"), m["value"].alias("value"))


def run_join_jobs(jobs: DataFrame, long: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """The results of all recommended joins at once: ``(question_id, rank, level, key, metrics)``.

    ``jobs`` as from ``join_jobs``; ``long`` ``(dataset_id, row_id, column, value)`` holds the datasets' cells. Each
    distinct aggregate of a dataset, key column, level and metric is computed once, however many jobs
    ask for it, and the jobs then meet the aggregates: the plan doesn't grow with the jobs. A job's rows are the keys that all its
    sources have; ``metrics`` maps names to numbers. A job with a source that has no key at its level has no rows.
    """
    job = ["question_id", "rank", "level"]
    sized = jobs.groupBy(*job).agg(F.count("key_column").alias("_keyed"), F.count(F.lit(1)).alias("_sources"))
    runnable = cut_lineage(jobs.join(sized.where(F.col("_keyed") == F.col("_sources")).drop("_keyed"), job))
    source = ["dataset_id", "level", "key_column"]
    metric = ["agg", "column", "value"]
    wanted = cut_lineage(runnable.select(*source, F.inline("metrics")).select(*source, *metric).distinct())

    places = wanted.select(*source).distinct().withColumnRenamed("key_column", "column")
    key = F.when(F.col("level") == "sgg", gazetteer.city("value")).otherwise(gazetteer.town("value"))
    # the NULL test stays outside: pushed below the projection it would find every key twice
    keyed = cut_lineage(
        long.join(places, ["dataset_id", "column"]).select(*source[:2], F.col("column").alias("key_column"), "row_id", key.alias("key"))
    ).where("key is not null")
    counts = keyed.groupBy(*source, "key").agg(F.count(F.lit(1)).cast("double").alias("result"))
    counted = wanted.where("agg = 'count'").join(counts, source)
    measured = wanted.where("agg <> 'count'")
    cells = long.withColumnRenamed("value", "cell").join(measured.select("dataset_id", "column").distinct(), ["dataset_id", "column"])
    number = metric_double("cell")
    results = (
        F.when(F.first("agg") == "sum", F.sum(number))
        .when(F.first("agg") == "avg", F.avg(number))
        .otherwise(F.count_if(F.col("cell") == F.col("value")).cast("double"))
    )
    measured = (
        keyed.join(measured, source)
        .join(cells, ["dataset_id", "row_id", "column"])
        .groupBy(*source, *metric, "key")
        .agg(results.alias("result"))
    )
    every = counted.select(*source, *metric, "key", "result").unionByName(measured.select(*source, *metric, "key", "result"))
    asked = runnable.select(*job, "alias", "_sources", *source[::2], F.inline("metrics")).withColumn(
        "name", _metric_name(F.struct("metric_pos", "agg", "column"), F.col("alias"))
    )
    met = asked.alias("q").join(
        every.alias("r"),
        (F.col("q.dataset_id") == F.col("r.dataset_id"))
        & (F.col("q.level") == F.col("r.level"))
        & (F.col("q.key_column") == F.col("r.key_column"))
        & (F.col("q.agg") == F.col("r.agg"))
        & (F.col("q.column") == F.col("r.column"))
        & F.col("q.value").eqNullSafe(F.col("r.value")),
    )
    named = F.array_sort(F.collect_list(F.struct("name", "result")))
    grouped = met.groupBy("q.question_id", "q.rank", "q.level", "r.key", "q._sources").agg(
        F.count_if(F.col("q.agg") == "count").alias("_met"), F.map_from_entries(named).alias("metrics")
    )
    # every source counts its rows, so a key that all sources have comes with as many counts
    return grouped.where(F.col("_met") == F.col("_sources")).drop("_met", "_sources")


def job_specs(jobs: DataFrame) -> DataFrame:
    """Recommended joins as specs that ``run_spec`` takes: ``(question_id, rank, level, spec)``.

    ``jobs`` as from ``join_jobs``; a join with a source that has no key at its level is left out.
    """

    source = F.struct(
        "alias",
        "dataset_id",
        F.struct(F.col("key_column").alias("column"), F.col("level").alias("level")).alias("key"),
        F.transform("metrics", lambda m: _metric(m, F.col("alias"))).alias("metrics"),
    )
    grouped = jobs.groupBy("question_id", "rank", "level").agg(
        F.array_sort(F.collect_list(source)).alias("sources"), F.count("key_column").alias("_keyed"), F.count(F.lit(1)).alias("_all")
    )
    spec = F.to_json(F.struct("sources", F.lit("inner").alias("join")))
    return grouped.where(F.col("_keyed") == F.col("_all")).select("question_id", "rank", "level", spec.alias("spec"))
