"""Matching against plain Python."""

import random
import tracemalloc
from difflib import SequenceMatcher, get_close_matches

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramline.operators import match


def words(seed, n):
    rng = random.Random(seed)
    parts = ["Madina", "Circle", "Tema", "Kaneshie", "Lapaz", "Old", "New", "Station", "Terminal", "37", "Junction"]
    made = []
    for _ in range(n):
        text = " ".join(rng.sample(parts, rng.randint(1, 3)))
        made.append("".join(c for c in text if rng.random() > 0.15) + rng.choice(["", "x", " é"]))
    return made


@pytest.mark.parametrize("rows", [(1000, 1000), (7, 5)], ids=["one cell", "many cells"])
def test_fuzzy_names_like_difflib(spark, rows):
    asked, names = sorted(set(words(1, 60))), sorted(set(words(2, 50)))
    found = {
        r.word: (r.name, r.ratio) for r in match.fuzzy_names(
            spark.createDataFrame([(a,) for a in asked], "t string"),
            spark.createDataFrame([(n,) for n in names], "t string"), 0.6, *rows,
        ).collect()
    }
    for word in asked:
        expected = get_close_matches(word, names, n=1, cutoff=0.6)
        assert found.get(word, (None,))[0] == (expected[0] if expected else None)
        if expected:
            assert found[word][1] == pytest.approx(SequenceMatcher(None, expected[0], word).ratio())


def test_closest_names_long_texts():
    """Texts over 200 letters, where common letters no longer start a match."""
    rng = random.Random(3)
    names = ["".join(rng.choice("ab ") for _ in range(260)) for _ in range(6)]
    asked = [n[20:] + "zz" for n in names] + ["nothing like it"]
    for word in asked:
        expected = get_close_matches(word, names, n=1, cutoff=0.3)
        found = match.closest_names([word], names, 0.3)
        assert [f[1] for f in found] == expected


def test_closest_names_compares_few_names(monkeypatch):
    """Names of the same letters all share the letter bound; few of them are compared in full."""
    calls = []

    class Counted(SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(match, "SequenceMatcher", Counted)
    rng = random.Random(5)
    names = sorted({"Stop " + "".join(rng.sample("1234567", 7)) for _ in range(600)} | {"", "long " * 60})
    asked = ["Sop 7654321", "Stp 1234576", "Stop 12x4567", "long " * 50, "🚌" * 70]
    found = {f[0]: f[1:] for f in match.closest_names(asked, names, 0.6)}
    assert len(calls) < 600
    for word in asked:
        best = max((SequenceMatcher(None, name, word).ratio(), name) for name in names)
        assert found.get(word) == ((best[1], best[0]) if best[0] >= 0.6 else None)


def test_fuzzy_cutoff_and_ties(spark):
    names = spark.createDataFrame([("abcdX", 2), ("abcdY", 1), ("abcdY", 0), ("zzzz", 3)], "stop_name string, stop_id int")
    asked = spark.createDataFrame([("abcd",), ("qqqq",), (None,)], "t string")
    rows = {r.t: (r.matched_name, r.matched_stop_id) for r in match.fuzzy_match(asked, names, "t").collect()}
    assert rows == {"abcd": ("abcdY", 0), "qqqq": (None, None), None: (None, None)}


@pytest.mark.parametrize("rows", [10_000, 9], ids=["one cell", "many cells"])
def test_top1_like_brute_force(spark, rows):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(40, 8))
    corpus[17] = corpus[3] * 2.0
    asked = np.vstack([rng.normal(size=(30, 8)), corpus[17:18]])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(corpus).T, 12)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, embedding array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "c long, embedding array<double>")
    found = {r.q: (r.c, r.score) for r in match.top1_similar(left, right, "q", "c", rows=rows).collect()}
    for i, row in enumerate(scores):
        assert found[i][0] == row.argmax()
        assert found[i][1] == pytest.approx(row.max())
    assert found[30][0] == 3


def test_a_cell_of_vectors_takes_little_memory(spark, monkeypatch):
    """Every worker of an executor may hold a whole cell, so the scores of a cell are never there at once."""
    cells = []

    def watched(left, right, left_key, right_key, left_rows, right_rows, best, schema):
        cells.append((best, right_rows))
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(match, "_grid_cells", watched)
    vectors = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    match.top1_similar(vectors, vectors, "id", "id")
    best, rows = cells[0]
    known = np.random.default_rng(4).normal(size=(rows, 8)).astype("float32")
    asked = pd.DataFrame({"q": range(300), "qv": list(known[:300] * 2)})
    tracemalloc.start()
    found = best(asked, pd.DataFrame({"c": range(rows), "cv": list(known)}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["c"].tolist() == list(range(300)) and found["score"].tolist() == [1.0] * 300
    assert peak < 32 << 20


def test_empty_corpus_gives_the_apology(spark):
    left = spark.createDataFrame([(1, [1.0])], "question_id long, embedding array<double>")
    right = spark.createDataFrame([], "corpus_id long, embedding array<double>, answer string, context string, type string")
    row = match.find_best_answer(left, right).collect()[0]
    assert (row.confidence, row.type) == (-1.0, "unknown") and row.answer.startswith("I'm sorry")


@pytest.mark.parametrize("small", [True, False], ids=["broadcast", "shuffled"])
def test_substring_like_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(match, "is_broadcast_size", lambda df: small)
    texts = ["The Fare from Tema to Accra is five", "fare from tema", "x", "ab\tcd  ef", "", "Where is the station located now?"]
    asked = ["fare from tema", "from tema to", "E", "ab", "cd  ef", "b\tc", "", "is the station located", "zz", "zzzz yyyy xxxx",
             "fare  from tema", " tema ", "five", "station located"]
    corpus = spark.createDataFrame(list(enumerate(texts, 10)), "c long, t string")
    questions = spark.createDataFrame(list(enumerate(asked)), "q long, t string")
    found = {r.q: (r.c, r.score) for r in match.substring_match(questions, corpus, "q", "t", "c", "t").collect()}
    for i, q in enumerate(asked):
        hits = [c for c, t in enumerate(texts, 10) if q.lower() in t.lower()]
        assert found[i] == ((hits[0], 1.0) if hits else (10, 0.0)), q


def test_substring_empty_corpus(spark):
    corpus = spark.createDataFrame([], "c long, t string")
    questions = spark.createDataFrame([(1, "a b c")], "q long, t string")
    row = match.substring_match(questions, corpus, "q", "t", "c", "t").collect()[0]
    assert row.c is None and row.score is None


def test_hot_question_is_searched_once(spark):
    """A third of all questions being the same text leaves one row per question."""
    corpus = spark.createDataFrame([(i, f"stop number {i} here") for i in range(50)], "c long, t string")
    asked = spark.range(300).select(F.col("id").alias("q"), F.when(F.col("id") % 3 == 0, "number 7 here").otherwise(
        F.concat(F.lit("stop number "), (F.col("id") % 50).cast("string"), F.lit(" here"))).alias("t"))
    rows = match.substring_match(asked, corpus, "q", "t", "c", "t").collect()
    assert len(rows) == 300 and all(r.c == (7 if r.q % 3 == 0 else r.q % 50) for r in rows)


def test_answers_by_text(spark):
    corpus = spark.createDataFrame([(1, "What is a bus?", "A", "c", "general"), (2, "Fare to Tema please", "B", "c", "fare")],
                                   "corpus_id long, question string, answer string, context string, type string")
    asked = spark.createDataFrame([(10, "fare to tema"), (11, "nothing like it")], "question_id long, question string")
    rows = {r.question_id: (r.answer, r.confidence) for r in match.answer_by_text(asked, corpus).collect()}
    assert rows == {10: ("B", 1.0), 11: ("A", 0.0)}
    rows = match.answer_by_text(asked, corpus.limit(0)).collect()
    assert {(r.confidence, r.type) for r in rows} == {(-1.0, "unknown")}
