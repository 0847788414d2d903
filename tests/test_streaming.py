"""Streams over files, drained and compared."""

import json

import pytest
from pyspark.sql import functions as F

from tramline.functions.fixed_values import MEDIA_REPLY
from tramline.operators.match import find_best_answer
from tramline.plans import stream_checks
from tramline.sources.snapshots import live_feed
from tramline.streaming import feedback, messages
from tramline.streaming.demand_stream import rolling_demand, write_append


def message(id, kind, body=None, sender="u1"):
    out = {"id": id, "from": sender, "type": kind, "timestamp": "1"}
    return out | ({"text": {"body": body}} if body is not None else {})


def payload(msgs, contacts=()):
    value = {"contacts": list(contacts)} | ({"messages": msgs} if msgs is not None else {})
    return json.dumps({"entry": [{"changes": [{"value": value}, {"value": {"messages": [message("other", "text", "x")]}}]}]})


def payloads(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "value string")


def test_flatten_and_route(spark):
    contact = {"wa_id": "u1", "profile": {"name": "Ama"}}
    kinds = [("a", "text", "HELP"), ("b", "text", "hi"), ("c", "text", "Fare to Tema?"), ("d", "image", None), ("e", "location", None),
             ("f", "sticker", None), ("g", "document", None), ("h", "audio", None), ("i", "video", None)]
    docs = [payload([message(*k) for k in kinds], [contact, {"wa_id": "u1", "profile": {"name": "Second"}}]),
            payload([message("z", "text", "hello", "u9")], [contact]), payload(None), "{}", "not json"]
    rows = {r.message_id: r for r in messages.route_messages(messages.flatten_messages(payloads(spark, *docs))).collect()}
    assert {k: r.action for k, r in rows.items()} == {
        "a": "welcome", "b": "welcome", "c": "answer", "d": "refuse", "e": "acknowledge", "f": "unknown",
        "g": "refuse", "h": "refuse", "i": "refuse", "z": "welcome"}
    assert rows["a"].sender_name == "Ama" and rows["z"].sender_name == "Unknown"
    assert rows["c"].reply is None and rows["d"].reply == MEDIA_REPLY and rows["d"].body == ""


def land(df, folder, n):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch{n}")


def events(spark, *rows):
    return spark.createDataFrame(rows, "stop_id string, ts string").select("stop_id", F.col("ts").cast("timestamp").alias("ts"))


def test_late_rows_are_dropped(spark, tmp_path):
    """The watermark of the second batch passes the first window; a row for it comes too late."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [
        events(spark, ("a", "2024-01-01 08:10:00"), ("a", "2024-01-01 08:50:00")),
        events(spark, ("a", "2024-01-01 12:00:00")),
        events(spark, ("a", "2024-01-01 08:20:00"), ("a", "2024-01-01 12:30:00")),
        events(spark, ("a", "2024-01-01 20:00:00")),
    ]
    for n, batch in enumerate(batches):
        land(batch, folder, n)
        stream = spark.readStream.schema("stop_id string, ts timestamp").parquet(f"{folder}/*")
        write_append(rolling_demand(stream, delay="1 hour"), out, state).awaitTermination()
    rows = {r.window_start.hour: r.demand for r in spark.read.parquet(out).collect()}
    assert rows == {8: 2, 12: 2}


def test_sliding_windows(spark):
    df = rolling_demand(events(spark, ("a", "2024-01-01 08:40:00")), size="1 hour", slide="30 minutes")
    assert sorted(r.window_start.strftime("%H:%M") for r in df.collect()) == ["08:00", "08:30"]


def test_repeated_messages(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n in range(2):
        df = spark.createDataFrame([("m1", "2024-01-01 08:00:00"), ("m1", "2024-01-01 08:01:00"), (f"n{n}", "2024-01-01 08:02:00")], "message_id string, t string")
        land(df.select("message_id", F.col("t").cast("timestamp").alias("event_time")), folder, n)
        stream = spark.readStream.schema("message_id string, event_time timestamp").parquet(f"{folder}/*")
        write_append(messages.dedup_messages(stream), out, state).awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == ["m1", "n0", "n1"]
    batch = spark.createDataFrame([("m1",), ("m1",)], "message_id string")
    assert messages.dedup_messages(batch).count() == 1


def test_answers(spark, tmp_path):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "east", "c", "general"), (2, [0.0, 1.0], "north", "c", "general")],
                                   "corpus_id long, embedding array<double>, answer string, context string, type string")
    asked = spark.createDataFrame([(10, [0.9, 0.1]), (11, [0.1, 0.9])], "question_id long, embedding array<double>")
    land(asked, str(tmp_path / "in"), 0)
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in" / "*"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    messages.answer_stream(stream, lambda b: find_best_answer(b, corpus), out, state).awaitTermination()
    assert {r.question_id: r.answer for r in spark.read.parquet(out).collect()} == {10: "east", 11: "north"}


def test_one_bad_question_does_not_spoil_its_batch(spark, tmp_path):
    asked = spark.createDataFrame([(i, "12" if i != 5 else "x") for i in range(12)], "question_id int, text string")
    land(asked, str(tmp_path / "in"), 0)
    stream = lambda: spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in" / "*"))
    lookup = lambda b: b.withColumn("answer", (F.col("text").cast("int") + F.col("question_id")).cast("string"))
    out = str(tmp_path / "out")
    messages.answer_stream(stream(), lookup, out, str(tmp_path / "state")).awaitTermination()
    found = {r.question_id: r.answer for r in spark.read.parquet(out).collect()}
    assert found == {i: messages.ERROR_REPLY if i == 5 else str(12 + i) for i in range(12)}

    def refuses(batch):
        raise ValueError("no corpus")
    messages.answer_stream(stream(), refuses, str(tmp_path / "refused"), str(tmp_path / "state-2")).awaitTermination()
    assert {r.answer for r in spark.read.parquet(str(tmp_path / "refused")).collect()} == {messages.ERROR_REPLY}


def test_a_target_that_cannot_be_written_fails_the_batch(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a")], "question_id int, answer string")
    land(asked, str(tmp_path / "in"), 0)
    stream = lambda: spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in" / "*"))
    (tmp_path / "file").write_text("not a folder")
    state = str(tmp_path / "state")
    with pytest.raises(Exception):
        messages.answer_stream(stream(), lambda b: b, str(tmp_path / "file"), state).awaitTermination()
    messages.answer_stream(stream(), lambda b: b, str(tmp_path / "out"), state).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_live_feed(spark, tmp_path):
    spark.createDataFrame([("v1", 5.5)], "vehicle string, lat double").write.json(str(tmp_path / "landing"))
    feed = live_feed(spark, str(tmp_path / "landing"), "vehicle string, lat double")
    write_append(feed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0].vehicle == "v1"


def test_feedback(spark):
    df = spark.createDataFrame([("q", None, 4, "good"), ("q", "a", None, None), (None, None, None, None)], "question string, answer string, rating int, feedback string")
    rows = {r.question: (r.n, r.avg_rating, r.with_text) for r in feedback.feedback_summary(feedback.feedback_defaults(df)).collect()}
    assert rows == {"q": (2, 2.0, 1), "": (1, 0.0, 0)}
    assert feedback.feedback_summary(feedback.feedback_defaults(df)).columns[0] == "question"


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_several_files_stream(spark, tmp_path, files):
    """A table is one file or a folder of files; each is a stream of all its rows."""
    turns = spark.createDataFrame([(c, t, "user", f"text {c}") for c in range(1, 7) for t in range(3)], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(9)], "vec_id long, embedding array<float>, label int")
    for name, rows in (("conversations", turns), ("embeddings", vectors)):
        rows.repartition(files).write.parquet(str(tmp_path / ("written" + name)))
        parts = sorted((tmp_path / ("written" + name)).glob("part-*.parquet"))
        assert len(parts) == files
        if files == 1:
            parts[0].rename(tmp_path / f"{name}.parquet")
        else:
            parts[0].parent.rename(tmp_path / f"{name}.parquet")
    flat = stream_checks.flat_messages(spark, str(tmp_path))
    streamed = stream_checks.flat_messages_streamed(spark, str(tmp_path))
    assert sorted(streamed.collect()) == sorted(flat.collect()) and flat.count() == 36
    answers = stream_checks.answered_stream(spark, str(tmp_path)).collect()
    assert sorted((r.question_id, r.corpus_id, r.answer) for r in answers) == [(i, i, f"label {i % 2}") for i in range(9)]
