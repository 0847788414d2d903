"""Preparing model data: scaling, splitting, target discovery, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.expressions import draw
from tramline.functions.fixed_values import CLASSIFICATION_KEYWORDS, REGRESSION_KEYWORDS
from tramline.functions.quantiles import exact_quantiles
from tramline.operators.clean import split_columns
from tramline.operators.profile import TAGS, column_stats

SPLIT_BUCKETS = 4_096


# --- scaling ----------------------------------------------------------------

def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_z``: distance from the mean in population deviations, 0 without spread."""
    parts = [e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    stats = df.agg(F.struct(*parts).alias("stats")).scalar()

    def z(c: str) -> Column:
        std = stats[f"{c}_std"]
        return (F.col(c) - stats[f"{c}_mean"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return df.withColumns({f"{c}_z": z(c) for c in columns})


# --- splitting --------------------------------------------------------------

def test_fraction(rows: int) -> float:
    return min(0.3, max(0.1, 100 / max(rows, 1)))


test_fraction.__test__ = False


def with_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test`` by a hash of the key: no shuffle, the same rows every time."""
    return df.withColumn("is_test", draw(*keys, seed=seed) < fraction)


def split(df: DataFrame, keys: Sequence[str], fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, keys, fraction, seed)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def with_stratified_split(
    df: DataFrame, keys: Sequence[str], label: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test`` with ``round(n * fraction)`` test rows of every label.

    Rows are counted per label and bucket of the draw.  Whole buckets fall on one side;
    only the bucket in which the quota ends is sorted.
    """
    drawn = df.withColumn("_u", draw(*keys, seed=seed)).withColumn(
        "_bucket", F.floor(F.col("_u") * SPLIT_BUCKETS).cast("int")
    )
    per_label = Window.partitionBy(label)
    counts = drawn.groupBy(label, "_bucket").agg(F.count("*").alias("_rows"))
    quota = counts.select(
        label, "_bucket",
        F.round(F.sum("_rows").over(per_label) * fraction).alias("_quota"),
        F.coalesce(
            F.sum("_rows").over(per_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
        "_rows",
    ).select(
        F.col(label).alias("_label"), F.col("_bucket").alias("_b"),
        F.greatest(F.lit(0), F.least(F.col("_quota") - F.col("_before"), F.col("_rows"))).alias("_take"),
        "_rows",
    )
    placed = drawn.join(
        quota, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b"))
    )
    whole = placed.filter((F.col("_take") == 0) | (F.col("_take") == F.col("_rows"))).withColumn(
        "is_test", F.col("_take") > 0
    )
    order = Window.partitionBy(label, "_bucket").orderBy("_u", *keys)
    cut = (
        placed.filter((F.col("_take") > 0) & (F.col("_take") < F.col("_rows")))
        .withColumn("is_test", F.row_number().over(order) <= F.col("_take"))
    )
    return whole.unionByName(cut).drop("_u", "_bucket", "_label", "_b", "_take", "_rows")


def stratified_or_plain(
    df: DataFrame, keys: Sequence[str], label: str, fraction: float, seed: int = 42
) -> DataFrame:
    """Stratified, unless some label has a single row."""
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if smallest is not None and smallest >= 2:
        return with_stratified_split(df, keys, label, fraction, seed)
    return with_split(df, keys, fraction, seed)


# --- targets ----------------------------------------------------------------

def discover_targets(df: DataFrame, limit: int | None = None) -> list[tuple[str, str]]:
    """``(task, column)`` candidates: by keyword first, by variety if no keyword fits.

    The rule reads only the statistics, so the driver handles one row per column.
    """
    stats = column_stats(df)
    numeric, _ = split_columns(df)
    columns = [c for c in df.columns if c not in TAGS]
    targets = []
    for c in columns:
        rows, filled, distinct = stats[c]
        if filled < rows * 0.5:
            continue
        name = c.lower()
        if c in numeric and distinct > 10 and any(k in name for k in REGRESSION_KEYWORDS):
            targets.append(("regression", c))
        if 2 <= distinct <= 50 and any(k in name for k in CLASSIFICATION_KEYWORDS):
            targets.append(("classification", c))
    if not targets:
        targets += [("regression", c) for c in columns if c in numeric and stats[c][2] > 10]
        targets += [("classification", c) for c in columns if 2 <= stats[c][2] <= 20]
    return targets[:limit]


# --- encoding ---------------------------------------------------------------

def fill_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns})


def build_preprocessor(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], wide: Sequence[str] = (),
    hash_size: int = 4_096,
) -> Pipeline:
    """Median fill and scaling for numbers, one-hot for text that ignores unseen values.

    The exact medians of ``df``, and the mean and population deviation of the filled numbers, become part of the pipeline.  One-hot needs the list of
    values on the driver; text columns in ``wide``, with more values than that should
    hold, go to a hashed vector of fixed size instead.
    """
    stages, parts = [], []
    if numeric:
        medians = {r["column"]: r["value"] for r in exact_quantiles(df, numeric, [0.5]).collect()}
        filled = {c: f"coalesce(cast(`{c}` AS DOUBLE), {medians.get(c, 0.0)!r}D)" for c in numeric}
        centre = df.agg(*[F.struct(F.avg(F.expr(e)), F.stddev_pop(F.expr(e))) for e in filled.values()]).first()
        # Population deviation; a column without spread is only centred.
        scaled = ", ".join(f"({e} - {(m or 0.0)!r}D) / {(s or 1.0)!r}D AS `{c}_scaled`" for (c, e), (m, s) in zip(filled.items(), centre))
        stages += [
            SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"{c}_scaled" for c in numeric], outputCol="numbers_scaled"),
        ]
        parts.append("numbers_scaled")
    if categorical:
        index, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep"),
        ]
        parts += hot
    if wide:
        stages.append(FeatureHasher(inputCols=list(wide), outputCol="hashed", numFeatures=hash_size))
        parts.append("hashed")
    if not parts:
        raise ValueError("no features to prepare")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def label_encoder(df: DataFrame, column: str, output: str = "label") -> StringIndexerModel:
    """Text target to 0, 1, 2 ... in alphabetical order."""
    return StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc").fit(df)
