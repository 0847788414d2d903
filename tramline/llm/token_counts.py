"""Exact length histogram: documents by encoded length, and what suffix sums answer from it.

The histogram (one row per length) is the only aggregate over the documents; it is summed
up before its shuffle.  For every context limit the report needs the documents and tokens
at or above a length, which are suffix sums over the histogram: totals, truncated totals
(``sum(min(length, limit))``), documents over the limit and exact quantiles follow.

Scale: one narrow pass and a shuffle of one row per task and length.  The histogram has at
most as many rows as there are different lengths (the longest text bounds them); its
running sums are built in ranges (sums within a range, then offsets of ranges), so no
window spans all rows.

Defined cases: a null or empty text has no ids but the end id; repeated rows count each;
an empty table gives an empty histogram and report rows with zero counts and null
quantiles; limits are distinct positive numbers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.llm.common import utf8
from tramline.llm.encode import encoder
from tramline.session import materialise

RANGE = 4096


def encoded_length(tokenizer: str, text: str = "text", end_ids: int = 1):
    """Number of ids of each text, the end id included."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(tokenizer).encode
        return pa.array([len(encode(t.as_py())) // 4 + end_ids for t in texts], pa.int64())

    return count(utf8(text))


def length_histogram(docs: DataFrame, tokenizer: str, *, text: str = "text") -> DataFrame:
    """``length``, ``docs``: how many documents have each encoded length; checkpointed, since several answers read it."""
    return materialise(docs.select(encoded_length(tokenizer, text).alias("length")).groupBy("length").agg(F.count("*").alias("docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with documents and tokens of this length or more (``docs_from``, ``tokens_from``)."""
    ranged = histogram.withColumn("_range", F.floor(F.col("length") / RANGE)).withColumn("_tokens", F.col("length") * F.col("docs"))
    later = W.partitionBy("_range").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    inner = ranged.withColumns({"_docs_in": F.sum("docs").over(later), "_tokens_in": F.sum("_tokens").over(later)})
    ranges = ranged.groupBy("_range").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    # One row per 4,096 lengths: a few thousand rows even for texts of ten million ids.
    above = W.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select(
        "_range", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t"),
    )
    return inner.join(offsets, "_range").select(
        "length", "docs", (F.col("_docs_in") + F.col("_d")).alias("docs_from"), (F.col("_tokens_in") + F.col("_t")).alias("tokens_from"),
    )


def _totals(sums: DataFrame) -> dict:
    """All documents and tokens, as constant columns."""
    docs, tokens = sums.agg(F.max("docs_from"), F.max("tokens_from")).first()
    return {"all_docs": F.lit(docs or 0).cast("bigint"), "all_tokens": F.lit(tokens or 0).cast("bigint")}


def limit_table(sums: DataFrame) -> DataFrame:
    """Every length as a context limit: ``tokens_truncated`` (longer documents cut) and the documents that fit."""
    return sums.withColumns(_totals(sums)).select(
        "length", "docs", "docs_from", "tokens_from", (F.col("all_docs") - F.col("docs_from") + F.col("docs")).alias("docs_fit"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("tokens_truncated"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, docs_over, tokens_truncated`` for any limits, whether or not a document has that length."""
    limits = sorted(set(limits))
    over = [F.max(F.when(F.col("length") > x, F.struct("docs_from", "tokens_from"))).alias(f"over_{x}") for x in limits]
    one = sums.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("tokens"), *over)
    rows = F.array(*[F.struct(
        F.lit(x).cast("bigint").alias("context_limit"), F.coalesce(F.col(f"over_{x}.docs_from"), F.lit(0)).alias("docs_over"),
        (F.col("tokens") - F.coalesce(F.col(f"over_{x}.tokens_from"), F.lit(0)) + x * F.coalesce(F.col(f"over_{x}.docs_from"), F.lit(0))).alias("tokens_truncated"),
    ) for x in limits])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that at least that share of the documents does not exceed."""
    reached = sums.withColumns(_totals(sums)).withColumn("fit", F.col("all_docs") - F.col("docs_from") + F.col("docs"))
    picked = reached.agg(*[F.min(F.when(F.col("fit") >= F.col("all_docs") * F.lit(s), F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])
    return picked.select(F.explode(rows).alias("r")).select("r.*")
