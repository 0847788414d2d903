"""Cleaning of many files at once.

Rows of all files come as ``city, source_file, cells`` (an array of name and value).  Types,
missing shares, modes, medians and fences belong to a (city, file, column), so they are groups
of one plan over the cells and not a plan per file: the number of jobs does not depend on how
many files there are.  What is kept between the steps is one line per file and column, joined
to the rows by file; rows cross the network once, to drop repeated ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.expressions import number_of
from tramline.functions.quantiles import group_quantiles
from tramline.operators.clean import UNKNOWN, normalise_text_column, to_datetime
from tramline.session import materialise

FILE = ["city", "source_file"]
COLUMN = [*FILE, "name"]


def normalised(name: Column) -> Column:
    """Names in lower case with underscores, as an expression."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), " ", "_"), r"(?U)[^\w]", "_")


def column_kinds(rows: DataFrame) -> DataFrame:
    """``kind`` of every column of every file: ``long``, ``double``, ``text``, or ``empty`` without a value."""
    cells = rows.select(*FILE, F.posexplode("cells").alias("at", "cell")).select(*FILE, "at", normalised(F.col("cell.name")).alias("name"), "cell.value")
    found = cells.groupBy(*FILE, "at", "name").agg(
        F.count("value").alias("filled"), F.count_if(F.col("value").isNotNull() & F.trim("value").try_cast("long").isNull()).alias("not_long"),
        F.count_if(F.col("value").isNotNull() & number_of("value").isNull()).alias("not_double"))
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("not_long") == 0, "long").when(F.col("not_double") == 0, "double").otherwise("text")
    return found.select(*FILE, "at", "name", kind.alias("kind"))


@dataclass(frozen=True)
class Cleaned:
    """``rows``: ``city, source_file, cells`` with typed values; ``columns`` with their ``field`` (number, text, moment); ``fences`` per column; ``report`` per file."""

    rows: DataFrame
    columns: DataFrame
    fences: DataFrame
    report: DataFrame


def _per_file(table: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
    """One row per file with an array of its columns' lines, in the order of the columns."""
    return table.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias(name))


def _tidy(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Different rows with a value, of the columns with a value; numbers in one spelling, text in order."""
    spec = _per_file(kinds, ["name", "kind"], "spec")

    def typed(cell: Column, column: Column) -> Column:
        value = cell["value"]
        spelled = F.when(column["kind"] == "long", F.trim(value).try_cast("long").cast("string")).when(
            column["kind"] == "double", number_of(value).cast("string")).otherwise(value)
        return F.struct(column["at"].alias("at"), column["name"].alias("name"), column["kind"].alias("kind"), spelled.alias("value"))

    filled = rows.filter(F.exists("cells", lambda c: c["value"].isNotNull())).join(spec, FILE)
    cells = F.filter(F.zip_with("cells", "spec", typed), lambda c: c["kind"] != "empty")
    # Copies that differ in blanks stay: they are compared before text is put in order.
    once = filled.select(*FILE, cells.alias("cells")).distinct()
    return once.withColumn("cells", F.transform("cells", lambda c: c.withField("value", F.when(c["kind"] == "text", normalise_text_column(c["value"])).otherwise(c["value"]))))


def clean_cells(rows: DataFrame, null_threshold: float = 0.7, exclude: Sequence[str] = ()) -> Cleaned:
    """All steps of a table's cleaning for many files together.

    In order: empty rows and columns, names, repeated rows, text, sparse columns, fills (median
    or mode), dates, fences.  A file with two columns of one name after normalisation is
    reported as failed and the others go on; numbers in ``exclude`` are not capped.
    """
    every = materialise(column_kinds(rows))
    twice = every.filter("kind <> 'empty'").groupBy(*COLUMN).agg(F.count("*").alias("n")).filter("n > 1")
    failed = twice.groupBy(*FILE).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("collide"))
    kinds = every.join(failed, FILE, "left_anti")
    tidy = materialise(_tidy(rows, kinds))
    long = tidy.select(*FILE, F.explode("cells").alias("cell")).select(*FILE, "cell.*")
    dated = F.lower("name").contains("date") | F.lower("name").contains("time")
    shares = long.groupBy(*FILE, "at", "name", "kind").agg(
        F.count("*").alias("total"), F.count("value").alias("filled"), F.count(F.nullif(F.trim("value"), F.lit(""))).alias("said"),
        F.count(F.when(dated & (F.col("kind") == "text"), to_datetime("value"))).alias("read"))
    # A text column in which no value reads as a date, such as times of day, stays text.
    is_date = dated & ((F.col("kind") != "text") | (F.col("said") == 0) | (F.col("read") > 0))
    columns = materialise(shares.filter(F.col("total") - F.col("filled") <= F.col("total") * null_threshold).withColumn("is_date", is_date))
    gaps = columns.filter("filled < total").select(*COLUMN)
    value = F.col("value").cast("double")
    numbers = long.filter("kind <> 'text'").select(*COLUMN, value.alias("value"))
    medians = group_quantiles(numbers.join(gaps, COLUMN, "left_semi"), COLUMN, [0.5]).select(*COLUMN, F.col("value").alias("median"))
    counted = long.filter("kind = 'text' and value is not null").join(gaps, COLUMN, "left_semi").groupBy(*COLUMN, "value").agg(F.count("*").alias("n"))
    modes = counted.groupBy(*COLUMN).agg(F.min(F.struct((-F.col("n")).alias("rank"), "value"))["value"].alias("mode"))
    known = materialise(columns.join(medians, COLUMN, "left").join(modes, COLUMN, "left"))
    capped = known.filter((F.col("kind") != "text") & ~F.col("is_date") & ~F.col("name").isin(list(exclude)))
    whole = numbers.join(capped.select(*COLUMN, "median"), COLUMN).select(*COLUMN, F.coalesce("value", "median").alias("value"))
    quarter = group_quantiles(whole, COLUMN, [0.25, 0.75]).groupBy(*COLUMN).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    fences = quarter.select(*COLUMN, "q1", "q3", F.when(spread > 0, F.col("q1") - 1.5 * spread).alias("low"), F.when(spread > 0, F.col("q3") + 1.5 * spread).alias("high"))
    ready = materialise(known.join(fences, COLUMN, "left"))
    outside = whole.join(ready.select(*COLUMN, "low", "high"), COLUMN).groupBy(*COLUMN).agg(
        F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("capped"))
    fences = ready.filter("q1 is not null").join(outside, COLUMN).select(*COLUMN, "q1", "q3", "low", "high", "capped")
    field = F.when(F.col("is_date"), "moment").when(F.col("kind") == "text", "text").otherwise("number")
    return Cleaned(_filled(tidy, ready), ready.select(*FILE, "at", "name", field.alias("field")), fences, _report(rows, every, tidy, ready, failed))


def _filled(tidy: DataFrame, ready: DataFrame) -> DataFrame:
    spec = _per_file(ready, ["name", "kind", "is_date", "median", "mode", "low", "high"], "spec")

    def cell(column: Column) -> Column:
        # The n-th cell of a row is not the n-th kept column; names tell, which are unique in a file.
        raw = F.element_at(F.filter("cells", lambda c: c["name"] == column["name"]), 1)["value"]
        number = F.coalesce(raw.cast("double"), column["median"])
        inside = F.greatest(F.least(number, column["high"]), column["low"])
        text = F.coalesce(raw, column["mode"], F.lit(UNKNOWN))
        numeric = column["kind"] != "text"
        moment = F.when(numeric, F.timestamp_micros(F.floor(number / 1000).cast("long"))).otherwise(to_datetime(F.when(~numeric, text)))
        return F.struct(
            column["name"].alias("name"), F.when(numeric & ~column["is_date"], inside).alias("number"),
            F.when(~numeric & ~column["is_date"], text).alias("text"), F.when(column["is_date"], moment).alias("moment"))

    return tidy.join(spec, FILE).select(*FILE, F.transform("spec", cell).alias("cells"))


def _report(rows: DataFrame, every: DataFrame, tidy: DataFrame, ready: DataFrame, failed: DataFrame) -> DataFrame:
    """``city, source_file, status, reason, rows_in, rows_out, columns``, one row per file."""
    counts = rows.groupBy(*FILE).agg(F.count("*").alias("rows_in"))
    out = tidy.groupBy(*FILE).agg(F.count("*").alias("rows_out"))
    names = ready.groupBy(*FILE).agg(F.sort_array(F.collect_list("name")).alias("columns"))
    status = F.when(F.col("collide").isNotNull(), "failed").otherwise("cleaned")
    return counts.join(out, FILE, "left").join(names, FILE, "left").join(failed, FILE, "left").select(
        *FILE, status.alias("status"), F.concat(F.lit("columns collide after normalisation: "), "collide").alias("reason"),
        "rows_in", F.coalesce("rows_out", F.lit(0)).alias("rows_out"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def cleaning_report(report: DataFrame) -> DataFrame:
    """Per city: files cleaned and failed, rows in and out, and the columns that all its cleaned files share."""
    shared = F.array_sort(F.filter(F.array_distinct("all"), lambda n: F.size(F.filter(F.col("all"), lambda x: x == n)) == F.col("files")))
    done = F.col("status") == "cleaned"
    return report.groupBy("city").agg(
        F.count_if(done).alias("files"), F.count_if(~done).alias("failed"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"),
        F.flatten(F.collect_list(F.when(done, F.col("columns")))).alias("all"),
    ).select("city", "files", "failed", "rows_in", "rows_out", F.array_join(shared, ",").alias("common_columns"))


def cell_of(name: str) -> Column:
    """The cell of one column; a row of a file without it gives null."""
    return F.get(F.filter("cells", lambda c: c["name"] == name), F.lit(0))


def shared_columns(columns: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(*group, name, field)``: columns that every file of a group has; a column of different kinds is text."""
    files = columns.select(*FILE).distinct().groupBy(*group).agg(F.count("*").alias("files"))
    found = columns.groupBy(*group, "name").agg(F.count("*").alias("n"), F.min("field").alias("field"), F.max("field").alias("other"))
    whole = found.join(files, list(group)) if group else found.withColumn("files", files.scalar())
    return whole.filter("n = files").select(*group, "name", F.when(F.col("field") == F.col("other"), F.col("field")).otherwise("text").alias("field"))


def typed_column(name: str, field: str) -> Column:
    """One column of the rows by its kind; as text, whatever kind it has."""
    cell = cell_of(name)
    return (cell[field] if field != "text" else F.coalesce(cell["text"], cell["number"].cast("string"), cell["moment"].cast("string"))).alias(name)


def stacked(cleaned: Cleaned, min_common: int = 3) -> DataFrame | None:
    """All cleaned files on the columns that every file has; None if, with both tags, they are fewer than ``min_common``.

    Only names come to the driver.
    """
    common = sorted((r["name"], r["field"]) for r in shared_columns(cleaned.columns, []).collect())
    if not common or len(common) + 2 < min_common:
        return None
    return cleaned.rows.select(*FILE, *[typed_column(*c) for c in common])


def layouts(columns: DataFrame, group: Sequence[str]) -> list[tuple[list[tuple[str, str]], DataFrame]]:
    """The different sets of typed columns, each with its groups; there are as many as kinds of files."""
    signature = F.array_sort(F.collect_list(F.struct("name", "field"))).alias("signature")
    sets = materialise(columns.groupBy(*group).agg(signature))
    found = sorted([(c["name"], c["field"]) for c in r["signature"]] for r in sets.select("signature").distinct().collect())
    wanted = lambda one: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("field")) for n, f in one])
    return [(one, sets.filter(F.col("signature") == wanted(one)).select(*group)) for one in found]
