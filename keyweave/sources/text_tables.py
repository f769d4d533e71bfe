"""Load delimited text files of unknown encoding as all-text tables.

Detection runs over the raw lines of all files in parallel, so no file has to fit into
one task. Each file is then
read by the CSV source in its own encoding; only files whose quoted fields span lines
need one task per file.
"""

from __future__ import annotations

import codecs
import csv
import io
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.functions.casts import SPACE_CLASS, as_column, strip

# Encodings in the order they are tried (fixed values).
ENCODINGS = ("utf-8-sig", "cp949", "utf-8", "euc-kr")
_CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}
_BROKEN = "_broken_row"


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _decodable(lines: pd.Series) -> pd.Series:
    """For each line whether each encoding in turn can decode its bytes."""

    def check(line: bytes) -> list[bool]:
        if line.isascii():
            return [True] * len(ENCODINGS)
        return [_decode(line, name) is not None for name in ENCODINGS]

    return lines.map(check)


@F.pandas_udf(T.BooleanType())
def _opens_quote(lines: pd.Series) -> pd.Series:
    return lines.map(lambda line: line.count(b'"') % 2 == 1)


@F.pandas_udf(T.StringType())
def _decoded(lines: pd.Series, encodings: pd.Series) -> pd.Series:
    pairs = zip(lines, encodings)
    return pd.Series([None if name is None else _decode(line, name) for line, name in pairs])


def _decode(raw: bytes, encoding: str) -> str | None:
    try:
        return codecs.decode(raw.rstrip(b"\r"), encoding)
    except UnicodeDecodeError:
        return None


def file_encodings(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Per file: first encoding that decodes every line and leaves an intact header.

    Returns ``(path, encoding, header, multi_line)``; ``encoding`` is NULL when none fits.
    """
    # the text source hands over the bytes of a line unchanged; no text function touches them
    raw = spark.read.text(paths)
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("line"),
    ).where(F.octet_length("line") > 0)
    tested = lines.withColumns({"ok": _decodable("line"), "opens": _opens_quote("line")})
    passed = [F.bool_and(F.col("ok")[i]).alias(f"ok{i}") for i in range(len(ENCODINGS))]
    # a block is read by one task in order: the first line of the first block is the header
    first = F.min(F.when(F.col("block") == 0, F.struct("at", "line")))
    files = tested.groupBy("path").agg(
        *passed, F.max("opens").alias("multi_line"), first.alias("first")
    )
    fits = F.array_compact(F.array(*[F.when(F.col(f"ok{i}"), F.lit(name)) for i, name in enumerate(ENCODINGS)]))
    options = files.select("path", "multi_line", F.col("first.line").alias("line"), F.explode_outer(fits).alias("encoding"))
    readable = options.withColumn("header", _decoded("line", "encoding"))
    intact = ~F.contains("header", F.lit("\ufffd"))
    rank = F.array_position(F.array(*[F.lit(e) for e in ENCODINGS]), F.col("encoding"))
    chosen = F.min(F.when(intact, F.struct(rank.alias("rank"), "encoding", "header")))
    return readable.groupBy("path").agg(chosen.alias("best"), F.max("multi_line").alias("multi_line")).select(
        "path", F.col("best.encoding").alias("encoding"), F.col("best.header").alias("header"), "multi_line"
    )


def clean_name(name: Column | str) -> Column:
    """A column name as identifier: blanks to underscores, other characters removed."""
    text = F.replace(strip(as_column(name)), F.lit("\ufeff"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, f"(?U){SPACE_CLASS}+", "_"), "[^0-9A-Za-z가-힣_]", "")
    text = F.regexp_replace(text, "^$", "col")
    return F.regexp_replace(text, r"^([0-9])", "c_$1")


def clean_names(headers: DataFrame) -> DataFrame:
    """Cleaned names of ``(file, position, name)``; later copies get ``_1``, ``_2`` and so on."""
    cleaned = headers.withColumn("_name", clean_name("name"))
    copy = F.row_number().over(Window.partitionBy("file", "_name").orderBy("position")) - 1
    cleaned = cleaned.withColumn("_copy", copy)
    return cleaned.select(
        "file",
        "position",
        "name",
        F.when(F.col("_copy") > 0, F.concat_ws("_", "_name", F.col("_copy").cast("string"))).otherwise(F.col("_name")).alias("column"),
    )


def header_cells(header: str) -> list[str]:
    """Cells of a header line; blank cells and repeated names get distinct names."""
    cells = next(csv.reader(io.StringIO(header)), [])
    seen: dict[str, int] = {}
    names = []
    for at, cell in enumerate(cells):
        name = cell or f"Unnamed: {at}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without any value; one aggregation over the table."""
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if counted[c] > 0]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def read_text_table(spark: SparkSession, path: str, encoding: str, header: str, multi_line: bool) -> DataFrame:
    """One file as text columns under its original names.

    Blanks stay blank, fields missing at the end of a short row become NULL, rows with too
    many fields are skipped.
    """
    if encoding not in ("utf-8-sig", "utf-8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    names = header_cells(header)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    reader = spark.read.schema(T.StructType([*fields, T.StructField(_BROKEN, T.StringType())]))
    rows = reader.options(
        header=True,
        encoding=_CHARSETS[encoding],
        multiLine=multi_line,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=_BROKEN,
        quote='"',
        escape='"',
        enforceSchema=True,
        maxCharsPerColumn=-1,
    ).csv(path)
    unquoted = F.regexp_replace(_BROKEN, '"[^"]*"', "")
    present = F.when(F.col(_BROKEN).isNull(), F.lit(len(names))).otherwise(
        F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    )
    rows = rows.withColumn("_present", present).where(F.col("_present") <= len(names))
    values = [
        F.when(F.col("_present") > i, F.coalesce(f"c{i}", F.lit(""))).alias(f"c{i}") for i in range(len(names))
    ]
    return rows.select(*values)


@dataclass(frozen=True)
class LoadedTable:
    """A file that was loaded, or the reason why not."""

    id: str
    path: str
    encoding: str | None = None
    columns: tuple[str, ...] = ()
    df: DataFrame | None = None
    error: str | None = None


def load_tables(spark: SparkSession, paths: list[str], target: str) -> tuple[DataFrame, list[LoadedTable]]:
    """Load every file into ``target/t_{id}`` as all-text columns and report each outcome.

    One bad file never stops the batch. The report has one row per file: rows, columns,
    encoding, column list, or the error. The driver handles one line of metadata per file;
    the rows are read, checked and written by the cluster.
    """
    found = {row.path: row for row in file_encodings(spark, paths).collect()}
    readable = [(p, row) for p, row in found.items() if row.encoding]
    cells = [(p, at, name) for p, row in readable for at, name in enumerate(header_cells(row.header))]
    columns: dict[str, list[str]] = {}
    if cells:
        cleaned = clean_names(spark.createDataFrame(cells, "file string, position int, name string"))
        for row in cleaned.orderBy("file", "position").collect():
            columns.setdefault(row.file, []).append(row.column)
    tables = [_load(spark, path, row, columns.get(path, []), target) for path, row in found.items()]
    missing = [p for p in paths if not any(t.path.endswith(p.split("://")[-1]) for t in tables)]
    tables += [LoadedTable(_identity(p), p, error="the file is empty or missing") for p in missing]
    return load_report(spark, tables), tables


def _identity(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _load(spark: SparkSession, path: str, row, names: list[str], target: str) -> LoadedTable:
    identity = _identity(path)
    if row.encoding is None:
        return LoadedTable(identity, path, error="no encoding fits the file")
    try:
        df = read_text_table(spark, path, row.encoding, row.header, row.multi_line).toDF(*names)
        kept = drop_empty_columns(df)
        text = kept.select(*[F.coalesce(f"`{c}`", F.lit("nan")).alias(c) for c in kept.columns])
        out = f"{target}/t_{identity}"
        text.write.mode("overwrite").parquet(out)
        return LoadedTable(identity, path, row.encoding, tuple(text.columns), spark.read.parquet(out))
    except Exception as error:  # noqa: BLE001
        return LoadedTable(identity, path, error=str(error))


def load_report(spark: SparkSession, tables: list[LoadedTable]) -> DataFrame:
    """Report rows; the row counts come from the written tables."""
    listed = [
        (t.id, t.path, f"t_{t.id}", len(t.columns), t.encoding, list(t.columns), t.df is not None, t.error) for t in tables
    ]
    schema = "id string, path string, table string, cols int, encoding string, columns array<string>, ok boolean, error string"
    report = spark.createDataFrame(listed, schema)
    counts = None
    for table in tables:
        if table.df is not None:
            one = table.df.agg(F.count(F.lit(1)).alias("rows")).withColumn("id", F.lit(table.id))
            counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        return report.withColumn("rows", F.lit(None).cast("bigint"))
    return report.join(counts, "id", "left")


# Header words of column-definition files (fixed values).
NAME_WORDS = "항목명|컬럼명|필드명"
DESCRIPTION_WORDS = "설명|정의|내용|한글"


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _cells(contents: pd.Series) -> pd.Series:
    """The cells of a CSV file; lines that can't be decoded are left out one by one."""

    def read(content: bytes) -> list:
        csv.field_size_limit(1 << 30)
        lines = (_decode(line, "cp949") for line in bytes(content).split(b"\n"))
        rows = csv.reader(line + "\n" for line in lines if line is not None)
        found = []
        while True:
            try:
                found.append(next(rows))
            except csv.Error:
                continue
            except StopIteration:
                return found

    return contents.map(read)


def read_definitions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Column descriptions from definition files: ``(dataset_id, item, desc)``.

    Such a file describes the columns of one dataset, a row each. The first row with a header word
    for names is the header (else the first row); names and descriptions stand in the columns it
    marks, else in the second one and the one after the names. Of rows with one name the last counts.
    """

    def marked(cells: Column, words: str) -> Column:
        """Where the first cell with one of the words stands, counted from 1; 0 for nowhere."""
        return F.coalesce(F.array_position(F.transform(cells, lambda c: c.rlike(words)), True), F.lit(0))

    files = spark.read.format("binaryFile").load(paths)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = F.transform(F.filter(_cells("content"), lambda r: F.size(r) > 0), lambda r: F.transform(r, lambda c: strip(c)))
    tables = files.select(name.alias("dataset_id"), rows.alias("rows")).where(F.size("rows") > 0)
    header = F.array_position(F.transform("rows", lambda r: F.exists(r, lambda c: c.rlike(NAME_WORDS))), True)
    top = tables.withColumn("top", F.greatest(header, F.lit(1)).cast("int"))
    head = F.element_at("rows", F.col("top"))
    placed = top.withColumn("at", F.when(marked(head, NAME_WORDS) > 0, marked(head, NAME_WORDS)).otherwise(2))
    placed = placed.withColumn(
        "says", F.when(marked(head, DESCRIPTION_WORDS) > 0, marked(head, DESCRIPTION_WORDS)).otherwise(F.col("at") + 1)
    )
    below = F.slice("rows", F.col("top") + 1, F.size("rows"))
    cells = placed.select("dataset_id", "at", "says", F.posexplode(below).alias("pos", "row"))
    cell = lambda place: F.get("row", (F.col(place) - 1).cast("int"))
    named = cells.select("dataset_id", "pos", cell("at").alias("item"), F.coalesce(cell("says"), F.lit("")).alias("desc"))
    return (
        named.where(F.col("item") != "").groupBy("dataset_id", "item").agg(F.max_by("desc", "pos").alias("desc"))
    )
