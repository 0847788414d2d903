"""Stacking tables whose columns only partly agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_columns(frames: Sequence[DataFrame]) -> list[str]:
    """Columns present in every frame, in the order of the first."""
    shared = set.intersection(*[set(df.columns) for df in frames])
    return [c for c in frames[0].columns if c in shared]


def with_one_type(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Frames whose equal column names have equal types: double for different numbers, else text."""
    kinds: dict[str, set] = {}
    for df in frames:
        for field in df.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType)
    mixed = {
        c: "double" if all(isinstance(k, T.NumericType) for k in found) else "string" for c, found in kinds.items() if len(found) > 1
    }
    return [df.withColumns({c: F.col(f"`{c}`").cast(mixed[c]) for c in df.columns if c in mixed}) for df in frames]


def union_common(
    frames: Sequence[DataFrame], min_common: int = 3, outer: bool = False
) -> DataFrame | None:
    """Stack the common columns when there are at least ``min_common`` of them.

    With fewer, nothing is stacked, or with ``outer`` everything is, gaps as null.
    Two of the common columns are normally the city and source tags.  A column that is a
    number in one frame and text in another is stacked as text.
    """
    frames = with_one_type(frames)
    shared = common_columns(frames)
    if len(shared) >= min_common:
        return reduce(DataFrame.unionByName, [df.select(*shared) for df in frames])
    if outer:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return None


def append_rows(table: DataFrame, extra: DataFrame) -> DataFrame:
    """Append without deduplication; columns the extra rows lack become null."""
    return table.unionByName(extra.select(*[c for c in extra.columns if c in table.columns]),
                             allowMissingColumns=True)


def cleaning_summary(df: DataFrame, city: str = "city", source_file: str = "source_file") -> DataFrame:
    """Per city: files, records and columns of the combined table."""
    return df.groupBy(city).agg(
        F.count_distinct(source_file).alias("files"),
        F.count("*").alias("records"),
        F.lit(len(df.columns)).alias("columns"),
    )


def file_report(
    before: DataFrame, after: DataFrame, city: str = "city", source_file: str = "source_file"
) -> DataFrame:
    """Rows before and after cleaning, per city and file of the tagged tables."""
    keys = [city, source_file]
    rows_in = before.groupBy(*keys).agg(F.count("*").alias("rows_in"))
    rows_out = after.groupBy(*keys).agg(F.count("*").alias("rows_out"))
    return rows_in.join(rows_out, keys, "left").fillna(0, subset=["rows_out"])
