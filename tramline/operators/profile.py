"""Profiles of a table: counts, distributions, gaps, correlations, bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.quantiles import exact_quantiles

# Columns that say where a row comes from and are no features.
TAGS = ("city", "source_file")


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def extent(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    return df.agg(
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"),
    )


def centre(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    return df.agg(F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))


def _as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )


def value_counts(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """Counts of non-null values per column, the ``k`` largest if given.

    The rank filter lets Spark keep ``k`` rows per map task before the shuffle.
    """
    counts = (
        _as_text(df, columns).filter("value IS NOT NULL")
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    if k is None:
        return counts
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per data type (plan only, reads no rows)."""
    kinds = [(f.dataType.simpleString(),) for f in df.schema]
    return df.sparkSession.createDataFrame(kinds, "dtype string").groupBy("dtype").agg(
        F.count("*").alias("n_columns")
    )


def missing(df: DataFrame, top: int | None = 10) -> DataFrame:
    """Null count per column, most first, with the overall share of empty cells in percent."""
    columns = list(df.columns)
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    overall = F.try_divide(
        reduce(Column.__add__, [F.col(c) for c in columns]) * 100.0, F.col("_rows") * len(columns)
    )
    counts = (
        df.agg(F.count("*").alias("_rows"), *nulls)
        .withColumn("overall_missing_pct", overall)
        .unpivot(["overall_missing_pct"], columns, "column", "missing")
    )
    return counts.orderBy(F.desc("missing"), "column").limit(top) if top else counts


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    basics = (
        numbers.unpivot([], list(columns), "column", "value")
        .groupBy("column")
        .agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(*[
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ])
    )
    return basics.join(quartiles, "column", "left")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle of the Pearson matrix, each pair over the rows where both are set."""
    pairs = list(combinations(columns, 2))

    def pair(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a)).cast("double"), F.when(both, F.col(b)).cast("double"))

    row = df.agg(*[pair(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ])))


def cardinality(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return row.unpivot([], list(columns), "column", "n_distinct")
    values = _as_text(df, columns)
    return values.groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))


def column_stats(df: DataFrame, exact_below: int = 200) -> dict[str, tuple[int, int, int]]:
    """Rows, non-null values and distinct values per column.

    A sketch sizes all columns in one pass; only columns it finds small are counted
    exactly, since no rule asks for more than 50 distinct values.
    """
    row = df.agg(
        F.count("*"), *[F.count(c) for c in df.columns], *[F.approx_count_distinct(c) for c in df.columns]
    ).first()
    n, width = row[0], len(df.columns)
    stats = {c: (n, row[1 + i], row[1 + width + i]) for i, c in enumerate(df.columns)}
    small = [c for c, (_, _, distinct) in stats.items() if distinct <= exact_below]
    if small:
        exact = (
            df.select(*[F.col(c).cast("string").alias(c) for c in small])
            .unpivot([], small, "column", "value").filter("value IS NOT NULL")
            .groupBy("column", "value").agg(F.lit(1).alias("one"))
            .groupBy("column").agg(F.count("*").alias("n"))
        )
        for r in exact.collect():
            stats[r["column"]] = (*stats[r["column"]][:2], r["n"])
    return stats


def categorical_profile(df: DataFrame, max_values: int = 20, k: int = 15) -> DataFrame:
    """Top ``k`` values of every text column with at most ``max_values`` different ones."""
    stats = column_stats(df)
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in TAGS and stats[c][2] <= max_values]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, rank int")
    return value_counts(df, texts, k)


def column_bounds(df: DataFrame, *columns: str) -> Column:
    """Scalar subquery with the smallest and largest value of each column."""
    parts = [e for c in columns for e in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]
    return df.agg(F.struct(*parts).alias("bounds")).scalar()


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; left edge included, the last bin closed on both sides."""
    share = F.try_divide(value - low, high - low)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """All bins with edges and counts, empty ones too."""
    bounds = column_bounds(df, column)
    low, high = bounds[f"{column}_lo"], bounds[f"{column}_hi"]
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(_bin(F.col(column), low, high, bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("bin_from"),
        (low + (F.col("bin") + 1) * width).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def density2d(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Occupied cells of a ``bins`` x ``bins`` grid."""
    bounds = column_bounds(df, x, y)
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(
            _bin(F.col(x), bounds[f"{x}_lo"], bounds[f"{x}_hi"], bins).alias("x_bin"),
            _bin(F.col(y), bounds[f"{y}_lo"], bounds[f"{y}_hi"], bins).alias("y_bin"),
        )
        .agg(F.count("*").alias("n"))
    )


def range_counts(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts over equal-width ranges that include their right edge, numbered from 1."""
    bounds = column_bounds(df, column)
    low, high = bounds[f"{column}_lo"], bounds[f"{column}_hi"]
    share = F.coalesce(F.try_divide(F.col(column) - low, high - low), F.lit(0.0))
    number = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(share * bins))).cast("int")
    width = (high - low) / bins
    # The lowest range is widened by 0.1 % so that it holds the minimum.
    edge = F.when(F.col("range") == 1, low - (high - low) * 0.001).otherwise(
        low + (F.col("range") - 1) * width
    )
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(number.alias("range"))
        .agg(F.count("*").alias("n"))
        .select("range", edge.alias("range_from"), (low + F.col("range") * width).alias("range_to"), "n")
    )


def densest_range(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    return range_counts(df, column, bins).orderBy(F.desc("n"), "range").limit(1)


def preview(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*key).limit(n)
