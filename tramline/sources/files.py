"""City files, the question corpus and result files."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.expressions import number_of
from tramline.functions.fixed_values import MISSING_CELLS
from tramline.operators.clean import normalise_columns
from tramline.operators.setops import union_common
from tramline.schemas import QA_CORPUS

# Separators in the order they are tried, whitespace runs last.
SEPARATORS = [",", "\t", ";", "|"]
WHITESPACE = r"\s+"
#: Stands between no columns, so a line is one of them.
NO_SEPARATOR = "\u0001"


# --- delimited files of unknown layout --------------------------------------

def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header line; repeated names get a number, empty ones their place."""
    fields = header.split() if sep == WHITESPACE else next(csv.reader([header], delimiter=sep))
    names: list[str] = []
    for i, field in enumerate(fields):
        name, again = field or f"Unnamed: {i}", 0
        while name in names:
            again += 1
            name = f"{field}.{again}"
        names.append(name)
    return names


def _fields(bare: Column, sep: str) -> Column:
    """Fields of a line without quoted parts."""
    if sep == WHITESPACE:
        return F.size(F.split(F.trim(bare), WHITESPACE))
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, '"[^"]*"', "q")


def judge_layouts(spark: SparkSession, paths: str | Sequence[str], unit: Column | None = None) -> DataFrame:
    """``(path, header, separator, multiline)`` of delimited files, judged by all their lines.

    A separator fits when it splits the header into several columns and no record into more;
    the first that fits is taken, null if none does or there are no data rows.  All files are
    judged in two aggregates; only those in which a quoted field goes on over a line end are
    read once more, whole.  ``unit`` may put several files under one path.
    """
    place = _decoded(F.col("_metadata.file_path"))
    lines = spark.read.text(paths).select(
        "value", (place if unit is None else unit).alias("path"), place.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
    ).filter(F.trim("value") != "")
    headers = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", F.struct("file", "at")).alias("header"))
    every = [*SEPARATORS, WHITESPACE]

    def widest(records: DataFrame) -> DataFrame:
        bare = _bare(F.col("value"))
        return records.groupBy("path").agg(F.count("*").alias("records"), *[F.max(_fields(bare, sep)).alias(f"w{i}") for i, sep in enumerate(every)])

    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = sorted(r.file for r in lines.filter(quotes % 2 == 1).select("file").distinct().collect())
    judged = widest(lines.filter(~F.col("file").isin(odd)) if odd else lines)
    if odd:
        whole = spark.read.text(odd, wholetext=True).select(F.explode(F.split(_bare(F.col("value")), "\r?\n")).alias("value"), (place if unit is None else unit).alias("path"))
        parts = judged.unionByName(widest(whole.filter(F.trim("value") != "")))
        judged = parts.groupBy("path").agg(F.sum("records").alias("records"), *[F.max(f"w{i}").alias(f"w{i}") for i in range(len(every))])
        broken = lines.filter(F.col("file").isin(odd)).select("path").distinct().withColumn("multiline", F.lit(True))
    else:
        broken = lines.limit(0).select("path", F.lit(True).alias("multiline"))
    choice = F.lit(None).cast("string")
    for i, sep in reversed(list(enumerate(every))):
        own = _fields(_bare(F.col("header")), sep)
        choice = F.when((own > 1) & (own == F.col(f"w{i}")), sep).otherwise(choice)
    return headers.join(judged, "path").join(broken, "path", "left").select(
        "path", "header", F.when(F.col("records") > 1, choice).alias("separator"), F.coalesce("multiline", F.lit(False)).alias("multiline"))


def sniff_separator(lines: Sequence[str]) -> str | None:
    """First separator that gives more than one column and at least one data row, for lines at hand."""
    lines = [line for line in lines if line.strip()]
    if len(lines) < 2:
        return None
    for sep in SEPARATORS:
        widths = [len(fields) for fields in csv.reader(lines, delimiter=sep)]
        if 1 < widths[0] == max(widths):
            return sep
    widths = [len(line.split()) for line in lines]
    return WHITESPACE if 1 < widths[0] == max(widths) else None


def read_delimited(spark: SparkSession, path: str) -> DataFrame | None:
    """A delimited file (or folder of its parts) of unknown separator as text columns, or nothing if none fits."""
    found = judge_layouts(spark, path, unit=F.lit(path)).first()
    if found is None or found.separator is None:
        return None
    return _read(spark, [path], found.separator, found.header, found.multiline)


def _read(spark: SparkSession, paths: Sequence[str], sep: str, header: str, multiline: bool, *keep: Column) -> DataFrame:
    """Text columns of files with one header; the first line of each file is dropped, whatever later lines say."""
    names = header_names(header, sep)
    if sep == WHITESPACE:
        lines = spark.read.csv(list(paths), schema="value string", sep=NO_SEPARATOR, header=True, quote="", enforceSchema=True)
        words = F.split(F.trim("value"), WHITESPACE)
        rows = lines.filter(F.trim("value") != "").select(*[F.get(words, F.lit(i)).alias(f"c{i}") for i in range(len(names))], *keep)
    else:
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        rows = spark.read.csv(list(paths), schema=schema, sep=sep, header=True, quote='"', escape='"', multiLine=multiline, enforceSchema=True)
        rows = rows.select(*[f"c{i}" for i in range(len(names))], *keep)
    cells = [F.when(~F.col(f"c{i}").isin(MISSING_CELLS), F.col(f"c{i}")).alias(n) for i, n in enumerate(names)]
    return rows.select(*cells, *[f"`{c}`" for c in rows.columns[len(names):]])


def promote_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns whose every value is a whole number or a number get that type.

    One aggregate decides for all columns.
    """
    columns = [c for c in (columns or df.columns) if dict(df.dtypes)[c] == "string"]
    if not columns:
        return df
    of = {c: F.col(f"`{c}`") for c in columns}
    checks = [
        e for c in of.values() for e in (
            F.count_if(c.isNotNull() & F.trim(c).try_cast("long").isNull()),
            F.count_if(c.isNotNull() & number_of(c).isNull()),
            F.count(c),
        )
    ]
    row = df.agg(*checks).first()
    types = {}
    for i, c in enumerate(columns):
        not_long, not_double, filled = row[3 * i: 3 * i + 3]
        if filled and not not_long:
            types[c] = F.trim(of[c]).try_cast("long")
        elif filled and not not_double:
            types[c] = number_of(of[c])
    return df.withColumns(types) if types else df


# --- the city directory -----------------------------------------------------

def _decoded(path: Column) -> Column:
    """File paths in metadata are URL-encoded; a plus sign is itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _tags(path: Column) -> dict[str, Column]:
    parts = F.split(path, "/")
    return {"city": F.try_element_at(parts, F.lit(-2)), "source_file": F.try_element_at(parts, F.lit(-1))}


def scan_layouts(spark: SparkSession, root: str) -> DataFrame:
    """``(path, city, source_file, header, separator, multiline)`` of every ``<root>/<city>/*.txt|csv``.

    Files that lie directly in the root (combined outputs) are not listed, so nothing is
    counted twice.
    """
    judged = judge_layouts(spark, f"{root.rstrip('/')}/*/*.{{txt,csv}}")
    return judged.withColumns(_tags(F.col("path"))).select("path", "city", "source_file", "header", "separator", "multiline")


def list_cities(spark: SparkSession, root: str) -> DataFrame:
    """Cities that have files."""
    paths = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*.{{txt,csv}}").select("path")
    return paths.select(_tags(F.col("path"))["city"].alias("city")).distinct()


def read_city_files(spark: SparkSession, root: str) -> list[DataFrame]:
    """All readable city files tagged with ``city`` and ``source_file``.

    One frame per layout (separator and header), however many files share it; the
    driver handles paths and headers, never rows.
    """
    layouts: dict[tuple, list[str]] = {}
    for row in scan_layouts(spark, root).filter("separator IS NOT NULL").orderBy("path").collect():
        layouts.setdefault((row.separator, row.header, row.multiline), []).append(row.path)
    return [read_layout(spark, paths, *layout) for layout, paths in layouts.items()]


def read_layout(spark: SparkSession, paths: Sequence[str], sep: str, header: str, multiline: bool = False) -> DataFrame:
    """Files of one layout as one tagged frame of text columns."""
    df = _read(spark, paths, sep, header, multiline, _decoded(F.col("_metadata.file_path")).alias("_path"))
    return df.withColumns(_tags(F.col("_path"))).drop("_path")


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """All readable city files as one frame: ``city, source_file, cells`` with names in the files' order.

    Files of any layout fit into it, so that later steps are one plan for all of them.
    """
    def cells(df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c not in ("city", "source_file")]
        made = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in names])
        return df.select("city", "source_file", made.alias("cells"))

    empty = spark.createDataFrame([], "city string, source_file string, cells array<struct<name:string,value:string>>")
    return reduce(DataFrame.unionByName, map(cells, read_city_files(spark, root)), empty)


def combine_cities(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack files on their common columns, or all columns if fewer than three agree."""
    return union_common([normalise_columns(df, collapse=True) for df in frames], 3, outer=True)


def write_clean(df: DataFrame, path: str, by: Sequence[str] = ("city",), fmt: str = "csv") -> None:
    """One folder per city (and file).

    The rebalance hint gathers the rows of a folder into files of a good size and splits
    a folder that holds most rows.
    """
    writer = df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def read_clean(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read ``write_clean`` output; the city comes back from the folder names."""
    reader = spark.read.option("basePath", path)
    if fmt == "csv":
        return reader.option("header", True).option("escape", '"').csv(path)
    return reader.format(fmt).load(path)


# --- questions and answers --------------------------------------------------

def read_qa_csv(spark: SparkSession, path: str, required: Sequence[str] = ("question", "answer")) -> DataFrame:
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"CSV must contain columns: {list(required)}; absent: {absent}")
    return df


def save_corpus(corpus: DataFrame, path: str, version: str = "1.0", embeddings: str = "") -> None:
    """Rows as JSON lines plus one metadata row with the count of what was written."""
    corpus.write.mode("overwrite").json(f"{path}/rows")
    written = corpus.sparkSession.read.schema(QA_CORPUS).json(f"{path}/rows")
    written.agg(F.count("*").alias("total_questions")).select(
        F.lit(version).alias("version"),
        F.current_timestamp().alias("created_at"),
        F.struct(
            F.lit("qa_system").alias("type"), F.lit(embeddings).alias("embeddings_model"),
            "total_questions",
        ).alias("model_info"),
    ).write.mode("overwrite").json(f"{path}/meta")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    meta = "version string, created_at timestamp, model_info struct<type:string,embeddings_model:string,total_questions:bigint>"
    return spark.read.schema(QA_CORPUS).json(f"{path}/rows"), spark.read.schema(meta).json(f"{path}/meta")


# --- results ----------------------------------------------------------------

def write_results(df: DataFrame, path: str) -> None:
    """Result records as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_run_summary(runs: DataFrame, path: str) -> None:
    """One record per model run: status, reason or error, results path, rows."""
    runs.write.mode("append").json(path)
