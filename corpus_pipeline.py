"""Corpus pipeline: documents to packed training windows in five stages.

Each stage takes all documents that its predecessor kept and is written as Parquet and read
again by the next one.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import decontaminate, line_join, pack, quality_rules, simhash
from tramline.llm.queries import tokenizer_path
from tramline.session import new_folder

#: Bytes of text that a stage hands a Python worker at a time; rows alone set no bound where texts are long.
BATCH_BYTES = 8 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a session says that did not set it.
UNSET = "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Lets the session send batches of ``BATCH_BYTES`` at most; one that says another bound keeps it.

    Stages are planned when their caller writes them, so the setting stays after the call.
    It changes memory and no result.
    """
    if spark.conf.get(BATCH_KEY) == UNSET:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rule or as depleted; removes common lines from the others."""
    return quality_rules.without_common_lines(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line resembles."""
    bounded_batches(spark)
    return line_join.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    bounded_batches(spark)
    return simhash.keep_one(docs, width=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts shorter hits out of the others."""
    bounded_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), parts=20, window=13)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows, with their token ids and the ids' digest."""
    bounded_batches(spark)
    return pack.with_digest(pack.pack(docs, tokenizer_path(), capacity=2048, end_id=1))


STAGES = [
    ("quality rules", quality), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("decontamination", decontamination), ("packing", packing),
]

#: Fingerprints and token ids are not to be had in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
