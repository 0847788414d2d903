"""Summaries of jobs, deliveries and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.expressions import confidence_band
from tramline.functions.quantiles import exact_quantiles


def run_summary(runs: DataFrame, status: str = "status") -> DataFrame:
    return runs.agg(*[
        F.count_if(F.col(status) == s).alias(s) for s in ("completed", "skipped", "failed")
    ])


def delivery_summary(log: DataFrame, success: str = "success") -> DataFrame:
    """``total_sent`` counts every recipient, delivered or not."""
    return log.agg(
        F.count("*").alias("total_sent"),
        F.count_if(F.col(success)).alias("delivered"),
        F.count_if(~F.coalesce(F.col(success), F.lit(False))).alias("errors"),
    )


def confidence_distribution(log: DataFrame, score: str = "confidence") -> DataFrame:
    return log.groupBy(confidence_band(score).alias("band")).agg(F.count("*").alias("n"))


def usage_statistics(log: DataFrame, seconds: str) -> DataFrame:
    """Requests, mean, median, 95th percentile and slowest response time."""
    basics = log.agg(
        F.count("*").alias("requests"), F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s")
    )
    tails = exact_quantiles(log, [seconds], [0.5, 0.95]).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median_s"),
        F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95_s"),
    )
    both = tails.agg(F.struct(F.max("median_s").alias("median_s"), F.max("p95_s").alias("p95_s"))).scalar()
    return basics.select(
        "requests", "mean_s", both["median_s"].alias("median_s"), both["p95_s"].alias("p95_s"), "max_s"
    )


def corpus_statistics(corpus: DataFrame, kind: str = "type") -> DataFrame:
    """Questions per type, an absent type counting as ``unknown``, with the total."""
    counts = corpus.groupBy(F.coalesce(kind, F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    total = corpus.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("total_questions", total)
