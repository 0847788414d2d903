"""Incoming messages: flatten the payload, choose a reply, answer questions.

Every function takes a batch or a streaming frame alike unless it says otherwise.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark import errors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tramline.functions.fixed_values import (
    ERROR_REPLY, GREETINGS, LOCATION_REPLY, MEDIA_REPLY, MEDIA_TYPES, UNKNOWN_REPLY, WELCOME_REPLY,
)
from tramline.schemas import PAYLOAD
from tramline.session import materialise


def flatten_messages(df: DataFrame, payload: str = "value") -> DataFrame:
    """One row per message of the first change of the first entry.

    A payload without messages gives no row.  The sender name is that of the first
    contact with the sender's id, else ``Unknown``; no join is needed, the contacts
    travel in the same payload.
    """
    parsed = df.withColumn("_p", F.from_json(payload, PAYLOAD))
    change = F.get(F.get(F.col("_p.entry"), F.lit(0))["changes"], F.lit(0))["value"]
    rows = parsed.withColumns({"_contacts": change["contacts"], "_messages": change["messages"]})
    rows = rows.withColumn("_m", F.explode("_messages"))
    sender = F.get(
        F.filter("_contacts", lambda c: c["wa_id"] == F.col("_m.from")), F.lit(0)
    )["profile"]["name"]
    kept = [c for c in df.columns if c != payload]
    return rows.select(
        *kept,
        F.col("_m.id").alias("message_id"),
        F.col("_m.from").alias("sender"),
        F.coalesce(sender, F.lit("Unknown")).alias("sender_name"),
        F.col("_m.type").alias("message_type"),
        F.col("_m.timestamp").alias("sent_at"),
        F.coalesce(F.col("_m.text.body"), F.lit("")).alias("body"),
    )


def route_messages(df: DataFrame, assistant: str = "Transit Assistant", vehicle: str = "minibus") -> DataFrame:
    """Add ``action`` and, where it is fixed, ``reply``.

    ``help`` counts as a greeting and gets the welcome text.
    """
    welcome = WELCOME_REPLY.replace("{assistant}", assistant).replace("{vehicle}", vehicle)
    kind = F.col("message_type")
    greeting = (kind == "text") & F.lower("body").isin(GREETINGS)
    action = (
        F.when(greeting, "welcome").when(kind == "text", "answer")
        .when(kind.isin(MEDIA_TYPES), "refuse").when(kind == "location", "acknowledge")
        .otherwise("unknown")
    )
    reply = (
        F.when(F.col("action") == "welcome", welcome).when(F.col("action") == "refuse", MEDIA_REPLY)
        .when(F.col("action") == "acknowledge", LOCATION_REPLY)
        .when(F.col("action") == "unknown", UNKNOWN_REPLY)
    )
    return df.withColumn("action", action).withColumn("reply", reply)


def dedup_messages(df: DataFrame, key: str = "message_id", time: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of a message; state older than ``delay`` is released."""
    if df.isStreaming:
        return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


#: What a lookup can raise because of the question: bad values and the lookup's own complaints.
#: Lost executors, full disks and the like are none of these.
LOOKUP_ERRORS = (
    errors.AnalysisException, errors.ArithmeticException, errors.ArrayIndexOutOfBoundsException, errors.DateTimeException,
    errors.IllegalArgumentException, errors.NumberFormatException, errors.PythonException, errors.SparkRuntimeException, LookupError, ValueError,
)


def answer_each(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], depth: int = 40) -> DataFrame:
    """Answers of a batch operator; a question it fails for gets the error text, the others their answers.

    The operator runs over all questions at once.  If it fails, the questions are halved by a
    hash until the failing ones are found: some jobs for each of them, none for the others.
    """
    def part(rows: DataFrame, level: int) -> DataFrame:
        try:
            return materialise(answer(rows))
        except LOOKUP_ERRORS:
            if level == depth or rows.limit(2).count() < 2:
                logging.getLogger(__name__).exception("a question could not be answered")
                return rows.withColumn("answer", F.lit(ERROR_REPLY))
        side = F.xxhash64(F.struct("*"), F.lit(level)) % 2 == 0
        halves = [rows.filter(side), rows.filter(~side)]
        found = [part(half, level + 1) for half in halves if not half.isEmpty()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    return part(questions, 0)


def answer_stream(
    questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
) -> StreamingQuery:
    """Answer each micro-batch with a batch operator and append it to ``path``.

    The best answer of a question is an aggregate over all candidates of its batch,
    hence ``foreachBatch``.  The batch number is part of the target folder, so a
    repeated batch overwrites itself.  A failed lookup gives its question the error text and
    does not end the stream; a target that cannot be written fails the batch, which is retried.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            answers = answer_each(batch, answer)
            if "answer" in answers.columns:
                answers = answers.withColumn("answer", F.coalesce("answer", F.lit(ERROR_REPLY)))
            answers.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return (
        questions.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
