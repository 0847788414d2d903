"""Matching questions to stations and answers.

Every comparison of all questions with all candidates runs on a grid: both sides are
cut into parts of bounded size by a hash of their key, each grid cell finds the best
candidate per question with numpy, and an aggregate keeps the best over the cells.
One row per question leaves a cell, never the pairs.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.expressions import strip, title_case
from tramline.functions.fixed_values import NO_ANSWER, OD_HINT, OD_SEPARATOR
from tramline.session import is_broadcast_size

NAMES_PER_CELL = 20_000
QUESTIONS_PER_CELL = 2_000
VECTORS_PER_CELL = 16_384
#: Questions of a cell that are scored at a time, 8 MB of scores against a whole cell.
BLOCK_ROWS = 64
SCORE_DIGITS = 12
#: Longer names are bounded by their letters alone.
LONGEST_CODED = 128


# --- origin and destination -------------------------------------------------

def parse_od(df: DataFrame, text: str) -> DataFrame:
    """``origin to destination`` phrases; anything else carries a format hint."""
    parts = F.split(F.lower(F.col(text)), OD_SEPARATOR)
    asked = F.coalesce(F.lower(F.col(text)).contains(OD_SEPARATOR), F.lit(False))

    def part(i: int) -> Column:
        return F.when(asked, title_case(strip(F.get(parts, F.lit(i)))))

    return df.withColumns({
        "origin": part(0),
        "destination": part(1),
        "status": F.when(asked, "ok").otherwise(OD_HINT),
    })


# --- the grid ---------------------------------------------------------------

def _parts(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(df.count() / rows))


def _grid_cells(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str,
    left_rows: int, right_rows: int, best: Callable, schema: str,
) -> DataFrame:
    n_left, n_right = _parts(left, left_rows), _parts(right, right_rows)

    def part_of(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    placed_left = left.select("*", part_of(left_key, n_left).alias("_row"), every(n_right).alias("_part"))
    placed_right = right.select("*", part_of(right_key, n_right).alias("_part"), every(n_left).alias("_row"))
    return (
        placed_left.groupBy("_row", "_part")
        .cogroup(placed_right.groupBy("_row", "_part"))
        .applyInPandas(best, schema)
    )


# --- fuzzy names ------------------------------------------------------------

def _letter_groups(names: Sequence[str]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Per letter the kinds of names that have it and how often, and the names of each kind.

    Names of the same letters, in whatever order, are one kind.
    """
    kinds, postings = defaultdict(list), defaultdict(list)
    for i, name in enumerate(names):
        kinds["".join(sorted(name))].append(i)
    for at, kind in enumerate(kinds):
        for letter, count in Counter(kind).items():
            postings[letter].append((at, count))
    return {k: np.array(v, dtype=np.int64).T for k, v in postings.items()}, [np.array(rows) for rows in kinds.values()]


def _common_letters(word: str, codes: np.ndarray, letters: dict[str, int]) -> np.ndarray:
    """Length of the longest common subsequence of ``word`` (64 letters at most) with every row of letter numbers.

    One bit per letter of the word, all rows at once; a cleared bit is one more letter in common.
    """
    places = np.zeros(len(letters) + 1, dtype=np.uint64)
    for i, letter in enumerate(word):
        if letter in letters:
            places[letters[letter]] |= np.uint64(1 << i)
    open_ = np.full(len(codes), np.uint64((1 << 64) - 1))
    for column in codes.T:
        met = open_ & places[column]
        open_ = (open_ + met) | (open_ - met)
    return np.bitwise_count(~open_).astype(np.int64)


def closest_names(asked: Sequence[str], names: Sequence[str], cutoff: float) -> list[tuple[str, str, float]]:
    """Best (word, name, ratio) per word with ratio >= cutoff; the larger name on a tie.

    The shared-letter count bounds the ratio from above; it is the same for all names of the same
    letters and counted once for them.  Names are tried from the highest bound down, and of these
    only such whose longest common subsequence, a closer bound, still lets them win.  The
    search ends when no bound can reach the best ratio.
    """
    if not len(names):
        return []
    columns, kinds = _letter_groups(names)
    letters = {c: k for k, c in enumerate(columns)}
    lengths = np.array([len(names[rows[0]]) for rows in kinds], dtype=np.int64)
    codes = np.full((len(names), min(max(map(len, names)), LONGEST_CODED)), len(letters), dtype=np.int32)
    for i, name in enumerate(names):
        if len(name) <= LONGEST_CODED:
            codes[i, :len(name)] = [letters[c] for c in name]
    found = []
    for word in asked:
        shared = np.zeros(len(kinds), dtype=np.int64)
        for letter, count in Counter(word).items():
            if letter in columns:
                which, have = columns[letter]
                shared[which] += np.minimum(have, count)
        total = lengths + len(word)
        bound = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
        likely = np.flatnonzero(bound >= cutoff)
        order = likely[np.argsort(-bound[likely], kind="stable")]
        matcher = SequenceMatcher()
        matcher.set_seq2(word)
        best = (cutoff, "")
        hit = False
        at, step = 0, 8
        while at < len(order) and bound[order[at]] >= best[0]:
            some = order[at:at + step]
            at, step = at + step, min(step * 2, 1024)
            rows = np.concatenate([kinds[k] for k in some])
            kind_of = np.repeat(some, [len(kinds[k]) for k in some])
            most = bound[kind_of]
            coded = lengths[kind_of] <= LONGEST_CODED
            if 0 < len(word) <= 64 and coded.any():
                common = _common_letters(word, codes[rows[coded]], letters)
                most[coded] = np.minimum(most[coded], 2.0 * common / total[kind_of[coded]])
            likely_rows = np.flatnonzero(most >= best[0])
            for i in likely_rows[np.argsort(-most[likely_rows], kind="stable")]:
                if most[i] < best[0]:
                    break
                name = names[rows[i]]
                if hit and most[i] == best[0] and name <= best[1]:
                    continue
                matcher.set_seq1(name)
                ratio = matcher.ratio()
                if ratio >= cutoff and (not hit or (ratio, name) > best):
                    best, hit = (ratio, name), True
        if hit:
            found.append((word, best[1], best[0]))
    return found


def fuzzy_names(
    asked: DataFrame, names: DataFrame, cutoff: float = 0.6,
    asked_rows: int = QUESTIONS_PER_CELL, name_rows: int = NAMES_PER_CELL,
) -> DataFrame:
    """``(word, name, ratio)``: the closest name per distinct word, if close enough.

    ``asked`` and ``names`` have one text column each.  Equal texts have ratio 1 and
    no rival, so a plain join settles them and only the rest is compared.
    """
    words = asked.toDF("word").dropna().distinct()
    known = names.toDF("name").dropna().distinct()
    same = words.join(known, F.col("word") == F.col("name")).withColumn("ratio", F.lit(1.0))
    rest = words.join(known, F.col("word") == F.col("name"), "left_anti")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = closest_names(left["word"].tolist(), right["name"].tolist(), cutoff)
        return pd.DataFrame(rows, columns=["word", "name", "ratio"])

    cells = _grid_cells(
        rest, known, "word", "name", asked_rows, name_rows, best, "word string, name string, ratio double"
    )
    nearest = (
        cells.groupBy("word")
        .agg(F.max(F.struct("ratio", "name")).alias("best"))
        .select("word", "best.name", "best.ratio")
    )
    return same.unionByName(nearest)


def fuzzy_match(
    asked: DataFrame, stations: DataFrame, text: str, name: str = "stop_name",
    order_by: Sequence[str] = ("stop_id",), cutoff: float = 0.6,
) -> DataFrame:
    """Add the first station (by ``order_by``) with the closest name, null without one."""
    matched = fuzzy_names(asked.select(text), stations.select(name), cutoff)
    first = stations.groupBy(F.col(name).alias("name")).agg(F.min(F.struct(*order_by)).alias("row"))
    found = matched.join(first, "name").select(
        F.col("word").alias(text), F.col("name").alias("matched_name"), "ratio",
        *[F.col(f"row.{c}").alias(f"matched_{c}") for c in order_by],
    )
    return asked.join(found, text, "left")


# --- similar questions ------------------------------------------------------

def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.vstack(vectors.to_numpy()).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def top1_similar(
    questions: DataFrame, corpus: DataFrame, question_id: str, corpus_id: str, vector: str = "embedding",
    rows: int = VECTORS_PER_CELL,
) -> DataFrame:
    """``(question_id, corpus_id, score)``: the most similar corpus row by cosine.

    The earliest corpus row wins a tie; scores are compared after rounding to
    ``SCORE_DIGITS`` so that equal vectors tie whatever cell they fall in.
    """
    left = questions.select(F.col(question_id).alias("q"), F.col(vector).alias("qv")).dropna()
    right = corpus.select(F.col(corpus_id).alias("c"), F.col(vector).alias("cv")).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields + right.schema.fields}

    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame({"q": [], "c": [], "score": []})
        known = known.sort_values("c", kind="stable")
        targets = _unit_rows(known["cv"]).T
        unit = _unit_rows(asked["qv"])
        at, score = [], []
        for start in range(0, len(unit), BLOCK_ROWS):
            block = unit[start:start + BLOCK_ROWS] @ targets
            np.round(block, SCORE_DIGITS, out=block)
            first = block.argmax(axis=1)
            at.append(first)
            score.append(block[np.arange(len(block)), first])
        ids = known["c"].to_numpy()[np.concatenate(at)]
        return pd.DataFrame({"q": asked["q"].to_numpy(), "c": ids, "score": np.concatenate(score)})

    cells = _grid_cells(
        left, right, "q", "c", rows, rows, best, f"q {kinds['q']}, c {kinds['c']}, score double"
    )
    top = F.min(F.struct((-F.col("score")).alias("minus"), "c")).alias("top")
    return (
        cells.filter(F.col("score") > -1)
        .groupBy("q").agg(top)
        .select(F.col("q").alias(question_id), F.col("top.c").alias(corpus_id),
                (-F.col("top.minus")).alias("score"))
    )


def find_best_answer(
    questions: DataFrame, corpus: DataFrame, question_id: str = "question_id",
    corpus_id: str = "corpus_id", vector: str = "embedding",
) -> DataFrame:
    """Answer, context and type of the most similar corpus question for each question."""
    hits = top1_similar(questions, corpus, question_id, corpus_id, vector)
    answers = corpus.select(corpus_id, "answer", "context", "type")
    return with_fallback_answer(
        questions.drop(vector).join(hits.join(answers, corpus_id), question_id, "left")
    )


def with_fallback_answer(df: DataFrame) -> DataFrame:
    """An unmatched question gets the apology, confidence -1 and type ``unknown``."""
    hit = F.col("score").isNotNull()
    return df.withColumns({
        "answer": F.when(hit, F.col("answer")).otherwise(NO_ANSWER),
        "context": F.when(hit, F.col("context")).otherwise("unknown"),
        "type": F.when(hit, F.col("type")).otherwise("unknown"),
        "confidence": F.coalesce("score", F.lit(-1.0)),
    }).drop("score")


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(text, " "))


def _inner_words(text: Column) -> Column:
    """Words with a blank on both sides; a text that holds the phrase holds them whole."""
    words = F.split(text, " ")
    return F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))


def _holding(of_question: DataFrame, of_text: DataFrame, known: DataFrame) -> DataFrame:
    """``(asked, hit)``: the earliest text that contains the question.

    ``of_question`` and ``of_text`` list keys such that a text lacks the question unless
    it has all of the question's keys.  Texts are looked up by the question's rarest key
    and then checked as a whole.  The questions' keys are broadcast if they measure
    small, so that texts stay where they are.
    """
    small = is_broadcast_size(of_question)
    wanted = of_question.select("key").distinct()
    texts = F.count("*").alias("texts")
    if small:
        spread = of_text.join(F.broadcast(wanted), "key", "left_semi").groupBy("key").agg(texts)
    else:
        # Count first: a word of every text crosses the shuffle once per task, not per text.
        spread = of_text.groupBy("key").agg(texts).join(wanted, "key", "left_semi")
    rarest = (
        of_question.join(spread, "key")
        .groupBy("asked")
        .agg(F.min(F.struct("texts", "key")).alias("pick"))
        .select("asked", "pick.key")
    )
    return (
        of_text.join(F.broadcast(rarest) if small else rarest, "key")
        .select("c", "asked")
        .join(known, "c")
        .filter(F.col("known").contains(F.col("asked")))
        .groupBy("asked")
        .agg(F.min("c").alias("hit"))
    )


def substring_match(
    questions: DataFrame, corpus: DataFrame, question_id: str, question: str,
    corpus_id: str, text: str,
) -> DataFrame:
    """``(question_id, corpus_id, score)``: the earliest corpus text that contains the question.

    Case is ignored and the score is 1.  Without a hit the earliest corpus row is
    returned with score 0.  Questions of three words or more are looked up by an inner
    word, shorter ones by three, two or one letters.
    """
    asked = questions.select(F.lower(F.col(question)).alias("asked")).filter("asked <> ''").distinct()
    known = corpus.select(F.col(corpus_id).alias("c"), F.lower(F.col(text)).alias("known"))
    inner = asked.withColumn("keys", _inner_words(F.col("asked")))
    hits = _holding(
        inner.filter(F.size("keys") > 0).select("asked", F.explode("keys").alias("key")),
        known.select("c", F.explode(_words(F.col("known"))).alias("key")),
        known,
    )
    rest = inner.filter(F.size("keys") == 0).select("asked", F.length("asked").alias("size"))
    for n in [r.n for r in rest.groupBy(F.least("size", F.lit(3)).alias("n")).count().collect()]:
        short = rest.filter(F.least("size", F.lit(3)) == n).select(
            "asked", F.explode(_grams(F.col("asked"), n)).alias("key")
        )
        texts = known.select("c", F.explode(_grams(F.col("known"), n)).alias("key"))
        hits = hits.unionByName(_holding(short, texts, known))
    earliest = corpus.agg(F.min(corpus_id).alias("first")).scalar()
    return (
        questions.select(question_id, F.lower(F.col(question)).alias("asked"))
        .join(hits, "asked", "left")
        .select(
            question_id,
            F.coalesce("hit", earliest).alias(corpus_id),
            F.when(earliest.isNull(), F.lit(None).cast("double"))
            .when(F.col("hit").isNotNull() | (F.col("asked") == ""), 1.0)
            .otherwise(0.0).alias("score"),
        )
    )


def answer_by_text(
    questions: DataFrame, corpus: DataFrame, question_id: str = "question_id", corpus_id: str = "corpus_id",
    question: str = "question",
) -> DataFrame:
    """Answers without vectors: the earliest corpus question that contains the asked one."""
    hits = substring_match(questions, corpus, question_id, question, corpus_id, question).filter("score IS NOT NULL")
    answers = corpus.select(corpus_id, "answer", "context", "type")
    return with_fallback_answer(questions.join(hits.join(answers, corpus_id), question_id, "left"))
