"""Messages, rolling demand and feedback, as batch and as drained streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.fixed_values import (
    GREETINGS, LOCATION_REPLY, MEDIA_REPLY, MEDIA_TYPES, UNKNOWN_REPLY, WELCOME_REPLY,
)
from tramline.operators.match import find_best_answer
from tramline.plans.registry import query
from tramline.plans.roles import rounded, table
from tramline.session import new_folder
from tramline.streaming import feedback, messages
from tramline.streaming.demand_stream import event_time, rolling_demand, write_append

KINDS = ["text", "text", "image", "location", "sticker", "audio"]
KIND_SQL = f"{KINDS}[(conv_id + turn) % 6 + 1]"
BODY_SQL = "CASE WHEN turn % 4 = 0 THEN ['hi', 'HELP', 'Start', 'hello'][conv_id % 4 + 1] ELSE text END"


def stream_of(spark, d, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a stream of files.

    The path is written as a pattern: of a plain one Spark takes a base for its batches, which must be a folder.
    """
    batch = table(spark, d, name)
    return spark.readStream.schema(batch.schema).parquet(f"{d.rstrip('/')}/{name}[.]parquet")


def payloads(conversations: DataFrame) -> DataFrame:
    """Webhook documents: the turn itself, a sticker after it, and contacts for some senders.

    Every seventh conversation carries no messages at all.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    body = F.when(turn % 4 == 0, F.get(F.array(*[F.lit(b) for b in ("hi", "HELP", "Start", "hello")]), conv % 4)).otherwise(F.col("text"))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (conv + turn) % 6)

    def message(number: int, kind):
        return F.struct(
            F.concat_ws("-", conv, turn, F.lit(number)).alias("id"),
            F.concat(F.lit("u"), conv.cast("string")).alias("from"),
            kind.alias("type"),
            turn.cast("string").alias("timestamp"),
            F.struct(body.alias("body")).alias("text"),
        )

    contact = F.struct(
        F.concat(F.lit("u"), (conv - conv % 2).cast("string")).alias("wa_id"),
        F.struct(F.concat(F.lit("Name "), F.col("role")).alias("name")).alias("profile"),
    )
    listed = F.array(message(1, kind), message(2, F.lit("sticker")))
    value = F.struct(F.when(conv % 7 != 0, listed).alias("messages"), F.array(contact).alias("contacts"))
    change = F.struct(value.alias("value"))
    entry = F.struct(F.array(change).alias("changes"))
    return conversations.select(F.to_json(F.struct(F.array(entry).alias("entry"))).alias("value"))


FLAT = f"""
    SELECT concat_ws('-', conv_id, turn, k) AS message_id, 'u' || conv_id AS sender,
           CASE WHEN conv_id % 2 = 0 THEN 'Name ' || role ELSE 'Unknown' END AS sender_name,
           CASE k WHEN 1 THEN {KIND_SQL} ELSE 'sticker' END AS message_type, turn::VARCHAR AS sent_at, {BODY_SQL} AS body
    FROM conversations, range(1, 3) r(k) WHERE conv_id % 7 <> 0"""


@query("j1_flat_messages", FLAT)
def flat_messages(spark, d):
    return messages.flatten_messages(payloads(table(spark, d, "conversations")))


@query("j1_flat_messages_streamed", FLAT)
def flat_messages_streamed(spark, d):
    out, state = new_folder(spark, "messages"), new_folder(spark, "messages-state")
    flat = messages.flatten_messages(payloads(stream_of(spark, d, "conversations")))
    write_append(flat, out, state).awaitTermination()
    return spark.read.parquet(out)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


WELCOME = WELCOME_REPLY.replace("{assistant}", "Transit Assistant").replace("{vehicle}", "minibus")


@query("j2_routed_messages", f"""
    SELECT *, CASE action WHEN 'welcome' THEN {_text(WELCOME)} WHEN 'refuse' THEN {_text(MEDIA_REPLY)}
                          WHEN 'acknowledge' THEN {_text(LOCATION_REPLY)} WHEN 'unknown' THEN {_text(UNKNOWN_REPLY)} END AS reply
    FROM (SELECT *, CASE WHEN message_type = 'text' AND lower(body) IN ('{"', '".join(GREETINGS)}') THEN 'welcome'
                         WHEN message_type = 'text' THEN 'answer'
                         WHEN message_type IN ('{"', '".join(MEDIA_TYPES)}') THEN 'refuse'
                         WHEN message_type = 'location' THEN 'acknowledge' ELSE 'unknown' END AS action FROM ({FLAT}))""")
def routed_messages(spark, d):
    return messages.route_messages(messages.flatten_messages(payloads(table(spark, d, "conversations"))))


@query("j4_answered_stream", """
    SELECT vec_id AS question_id, vec_id AS corpus_id, 'label ' || label AS answer, 1.0::DOUBLE AS confidence FROM embeddings""")
def answered_stream(spark, d):
    """Vectors arriving as questions against the stored corpus of the same vectors."""
    out, state = new_folder(spark, "answers"), new_folder(spark, "answers-state")
    vectors = table(spark, d, "embeddings")
    corpus = vectors.select(
        F.col("vec_id").alias("corpus_id"), "embedding",
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("answer"),
        F.lit("general").alias("context"), F.lit("general").alias("type"),
    )
    asked = stream_of(spark, d, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    messages.answer_stream(asked, lambda batch: find_best_answer(batch, corpus), out, state).awaitTermination()
    return rounded(spark.read.parquet(out).select("question_id", "corpus_id", "answer", "confidence"))


ROLLING = """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, user_id, count(*) AS demand
    FROM events GROUP BY 1, 2"""


@query("j5_rolling_demand", ROLLING)
def rolling(spark, d):
    windows = rolling_demand(table(spark, d, "events"), "user_id")
    return windows.select(F.unix_timestamp("window_start").alias("window_start"), "user_id", "demand")


@query("j5_sliding_demand", """
    SELECT epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT - 1800 * k AS window_start, user_id, count(*) AS demand
    FROM events, range(2) r(k) GROUP BY 1, 2""")
def sliding(spark, d):
    windows = rolling_demand(table(spark, d, "events"), "user_id", slide="30 minutes")
    return windows.select(F.unix_timestamp("window_start").alias("window_start"), "user_id", "demand")


@query("j5_rolling_demand_streamed", f"""
    SELECT * FROM ({ROLLING}) WHERE window_start + 3600 <= (SELECT epoch(max(ts)) - 3600 FROM events)""")
def rolling_streamed(spark, d):
    """Only windows the watermark has passed are final and therefore written."""
    out, state = new_folder(spark, "demand"), new_folder(spark, "demand-state")
    windows = rolling_demand(stream_of(spark, d, "events"), "user_id", delay="1 hour")
    write_append(windows, out, state).awaitTermination()
    return spark.read.parquet(out).select(F.unix_timestamp("window_start").alias("window_start"), "user_id", "demand")


@query("j6_feedback_summary", """
    SELECT event_type AS question, count(*) AS n, round(avg(CASE WHEN event_id % 6 = 5 THEN 0 ELSE event_id % 6 END), 6) AS avg_rating,
           count(*) FILTER (event_id % 3 <> 0) AS with_text FROM events GROUP BY 1""")
def feedback_summary(spark, d):
    k = F.col("event_id")
    given = table(spark, d, "events").select(
        F.col("event_type").alias("question"), F.lit(None).cast("string").alias("answer"),
        F.when(k % 6 != 5, (k % 6).cast("int")).alias("rating"), F.when(k % 3 != 0, F.lit("fine")).alias("feedback"),
    )
    return rounded(feedback.feedback_summary(feedback.feedback_defaults(given)))


@query("j7_messages_once", "SELECT event_id AS message_id, user_id FROM events")
def messages_once(spark, d):
    """Every event arrives twice and is kept once."""
    out, state = new_folder(spark, "once"), new_folder(spark, "once-state")
    twice = event_time(stream_of(spark, d, "events")).select(
        F.col("event_id").alias("message_id"), "user_id", F.col("ts").alias("event_time"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"),
    )
    write_append(messages.dedup_messages(twice).drop("delivery"), out, state).awaitTermination()
    return spark.read.parquet(out).select("message_id", "user_id")
