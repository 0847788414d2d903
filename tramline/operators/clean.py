"""Cleaning steps for messy city files, and the fixed order they run in."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions.expressions import strip
from tramline.functions.quantiles import quantile_lookup
from tramline.session import materialise

# Texts that mean "missing", and the fill for text without a mode.
MISSING_TEXTS = ["nan", "NaN", "None", ""]
UNKNOWN = "Unknown"

DATE_FORMATS = [
    "yyyy-M-d[ H:mm[:ss[.SSSSSS]]]", "yyyy-M-d'T'H:mm[:ss[.SSSSSS]][XXX]", "yyyy/M/d[ H:mm[:ss]]",
    "M/d/yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]",
]


# --- columns ----------------------------------------------------------------

def normalise_name(name: str, collapse: bool = False) -> str:
    clean = re.sub(r"[^\w]", "_", name.strip().lower().replace(" ", "_"))
    return re.sub(r"_+", "_", clean) if collapse else clean


def normalise_columns(df: DataFrame, collapse: bool = False) -> DataFrame:
    names = [normalise_name(c, collapse) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after normalisation: {twice}")
    return df.toDF(*names)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the text columns."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return numeric, text


def schema_report(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row per expected column: wanted and found type, and whether they agree."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, kind, found.get(c), found.get(c) == kind) for c, kind in expected.items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, expected string, actual string, ok boolean"
    )


def validate_schema(df: DataFrame, expected: dict[str, str]) -> bool:
    """Every expected column is there with that type; more columns are fine."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    return all(found.get(c) == kind for c, kind in expected.items())


# --- rows and missing values ------------------------------------------------

def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def null_shares(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column, in one pass; an empty table counts as all null."""
    row = df.agg(
        F.count("*"), *[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    ).first()
    total = row[0]
    return {c: (row[i + 1] / total if total else 1.0) for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Drop columns with strictly more than ``threshold`` nulls."""
    return df.drop(*[c for c, share in null_shares(df).items() if share > threshold])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c, share in null_shares(df).items() if share == 1.0])


def deduplicate(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows before, after, and removed by whole-row deduplication."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
        F.count("*").alias("rows_out"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("removed"),
    )


def normalise_text_column(c: str | Column) -> Column:
    """Trim, turn missing-value words into null, then squeeze blanks, in this order."""
    text = strip(c)
    kept = F.when(~text.isin(MISSING_TEXTS), text)
    return F.regexp_replace(kept, r"(?U)\s+", " ")


def normalise_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns if columns is not None else split_columns(df)[1]
    return df.withColumns({c: normalise_text_column(c) for c in columns})


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column as text; the smallest on a tie."""
    values = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .filter("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), "value"))
    return values.groupBy("column").agg(best.alias("best")).select("column", "best.value")


def impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers get the median, anything else its mode, or ``Unknown`` without one.

    Medians and modes are one value per column and reach the rows as scalar
    subqueries.  A filled integer column turns into a double, as a median may fall
    between two integers.
    """
    columns = list(columns if columns is not None else df.columns)
    numeric = [f.name for f in df.schema if f.name in columns and is_numeric(f.dataType)]
    other = [c for c in columns if c not in numeric]
    filled = {}
    if numeric:
        median = quantile_lookup(df, numeric, [0.5])
        filled |= {c: F.coalesce(F.col(c).cast("double"), median(c, 0.5)) for c in numeric}
    if other:
        lookup = (
            modes(df, other)
            .agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("lookup"))
            .scalar()
        )
        for c in other:
            kind = df.schema[c].dataType
            mode = F.coalesce(F.try_element_at(lookup, F.lit(c)), F.lit(UNKNOWN))
            filled[c] = F.coalesce(F.col(c), mode.try_cast(kind))
    return df.withColumns(filled)


def simple_clean(df: DataFrame) -> DataFrame:
    """Drop empty rows, show everything as text, and fill gaps with ``Unknown``."""
    kept = df.dropna("all")
    return kept.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in df.columns]
    )


# --- dates and outliers -----------------------------------------------------

def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]


def to_datetime(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to timestamp by the first format that fits; null when none does."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def coerce_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Timestamps for columns named like a date or time; numbers are epoch nanoseconds.

    A text column in which no filled value reads as a date, such as times of day, stays
    as it is; one pass over the text columns tells.
    """
    columns = columns if columns is not None else date_columns(df)
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if texts:
        filled = df.agg(*[F.struct(F.count(F.nullif(F.trim(f"`{c}`"), F.lit(""))).alias("filled"), F.count(to_datetime(c)).alias("read")).alias(f"c{i}") for i, c in enumerate(texts)]).first()
        columns = [c for c in columns if c not in texts or not (filled[texts.index(c)].filled and not filled[texts.index(c)].read)]
    out = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            out[c] = to_datetime(c)
        elif is_numeric(kind):
            out[c] = F.timestamp_micros(F.floor(F.col(c) / 1000).cast("long"))
        elif isinstance(kind, T.DateType):
            out[c] = F.col(c).cast("timestamp")
    return df.withColumns(out) if out else df


def _fences(df: DataFrame, columns: Sequence[str]) -> Callable[[str], tuple[Column, Column, Column]]:
    quantile = quantile_lookup(df, columns, [0.25, 0.75])

    def fence(c: str) -> tuple[Column, Column, Column]:
        q1, q3 = quantile(c, 0.25), quantile(c, 0.75)
        spread = q3 - q1
        return spread, q1 - spread * 1.5, q3 + spread * 1.5

    return fence


def cap_outliers(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Clip numbers to the 1.5 IQR fences; a column without spread is left alone."""
    columns = [c for c in (columns or split_columns(df)[0]) if c not in exclude]
    if not columns:
        return df
    fence = _fences(df, columns)
    capped = {}
    for c in columns:
        spread, low, high = fence(c)
        value = F.col(c).cast("double")
        inside = F.when(value < low, low).when(value > high, high).otherwise(value)
        capped[c] = F.when(spread > 0, inside).otherwise(value)
    return df.withColumns(capped)


def outlier_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows outside the fences, per column."""
    fence = _fences(df, columns)
    counts = []
    for c in columns:
        spread, low, high = fence(c)
        counts.append(F.count_if((spread > 0) & ((F.col(c) < low) | (F.col(c) > high))).alias(c))
    return df.agg(*counts).unpivot([], list(columns), "column", "capped")


# --- the whole sequence -----------------------------------------------------

def tag_source(df: DataFrame, city: str, source_file: str) -> DataFrame:
    return df.withColumns({"city": F.lit(city), "source_file": F.lit(source_file)})


def clean_table(
    df: DataFrame, city: str | None = None, source_file: str | None = None,
    null_threshold: float = 0.7, exclude: Sequence[str] = (),
) -> DataFrame:
    """All steps in order: empty rows and columns, names, duplicates, text, sparse
    columns, fills, dates, outliers, tags.

    Duplicates go before text is trimmed, so copies that differ in blanks survive.
    Which columns stay depends on the data, so the table is checkpointed once after
    the text step; the later passes read that instead of repeating the shuffle.
    """
    shaped = normalise_columns(drop_empty_columns(drop_empty_rows(df)))
    tidy = materialise(normalise_text(deduplicate(shaped)))
    shares = null_shares(tidy)
    kept = tidy.drop(*[c for c, share in shares.items() if share > null_threshold])
    gaps = [c for c in kept.columns if shares[c] > 0]
    filled = impute(kept, gaps) if gaps else kept
    dated = coerce_dates(filled)
    capped = cap_outliers(dated, exclude=exclude)
    return tag_source(capped, city, source_file) if city is not None else capped
