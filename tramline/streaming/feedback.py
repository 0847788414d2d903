"""Feedback on answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feedback_defaults(df: DataFrame) -> DataFrame:
    """Absent fields become empty text or rating 0."""
    return df.select(
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("rating", F.lit(0)).alias("rating"),
        F.coalesce("feedback", F.lit("")).alias("feedback"),
    )


def feedback_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("question").agg(
        F.count("*").alias("n"), F.avg("rating").alias("avg_rating"),
        F.count_if(F.col("feedback") != "").alias("with_text"),
    )
