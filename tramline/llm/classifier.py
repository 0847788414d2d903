"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on every document.  Expectation
maximisation over the counts of vote patterns estimates the share of good documents and
how often each labeller votes what on good and on bad ones; that gives each pattern a
posterior.  Posteriors are the soft labels of a linear scorer over hashed word features
(the lowered word, its shape, a repeat of the word before), whose features are shares of
the document's words.  All documents are scored.

Scale: the votes are one pass and an aggregate to at most ``3 ** labellers`` rows (1,152 here), which is
all that reaches the driver from the whole corpus.  The scorer is fitted on the ``sample``
documents with the least text hashes (a documented bound); scoring is one narrow pass with
a weight vector of fixed size.

Defined cases: a null or empty text has no words, votes like a short text and is scored by
the bias alone; repeated rows count each in the votes, equal texts get equal scores; an
empty table gives no rows; other columns pass through, and ones named like the results are
replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import utf8, worker_store

#: Function words of the four languages of the corpus.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for with was on are this by be or from as at it "
    "de la que el en los las del un una por con para y es "
    "le les des et du dans une pour sur au est qui "
    "der die und den von zu das mit dem ein eine nicht auf für im ist".split()
)
SYMBOLS = re.compile(r"[#*$%&|<>]")
DIMENSIONS = 1 << 18
CACHED_WORDS = 300_000


#: Letters with marks of a sentence around them.
PLAIN_WORD = re.compile(r"[(\[\"']?[^\W\d_]+(?:['-][^\W\d_]+)*[.,;:?!]?[)\]\"']?")


def votes(text: str) -> list[int]:
    """Symbols, capitals, repeats, variety, calls, length, word length, function words, plain words.

    The first seven look for one fault each and abstain without it: a text that lacks one
    fault may have another.  The last two speak for a text as well as against it.
    """
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0, -1, 0, -1, -1]
    low = [w.lower() for w in words]
    faults = [
        len(SYMBOLS.findall(text)) > 0.1 * n,
        sum(map(str.isupper, words)) > 0.4 * n,
        sum(map(eq, words, words[1:])) > 0.2 * n,
        n >= 20 and math.log(len(set(low))) < 0.75 * math.log(n),
        sum(w.endswith("!") for w in words) > 0.2 * n,
        n < 20,
        not 3.5 <= len(text) / n <= 11,
    ]
    fresh = [w for w, before in zip(low, [None, *low]) if w != before]
    function = sum(map(FUNCTION_WORDS.__contains__, fresh)) / n
    plain = sum(PLAIN_WORD.fullmatch(w) is not None for w in fresh) / n
    return [-int(f) for f in faults] + [1 if function >= 0.08 else -1 if function <= 0.03 else 0, 1 if plain >= 0.9 else -1 if plain <= 0.7 else 0]


def patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``pattern, n``: how many documents got each combination of votes."""

    @F.arrow_udf("string")
    def cast(texts: pa.Array) -> pa.Array:
        return pa.array([",".join(map(str, votes(t.as_py().decode("utf-8", "replace")))) for t in texts])

    return docs.select(cast(utf8(text)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


class LabelModel:
    """Two classes; labellers vote independently given the class."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 100):
        self.seen = np.array(sorted(counts), dtype=np.int64).reshape(len(counts), -1 if counts else 0)
        weight = np.array([counts[tuple(p)] for p in self.seen.tolist()], dtype=float)
        # A fault outweighs a vote in favour to begin with.
        self.posterior = 1 / (1 + np.exp(-2.0 * (self.seen.clip(0).sum(axis=1) + 2 * self.seen.clip(max=0).sum(axis=1)))) if len(counts) else np.empty(0)
        for _ in range(rounds if len(counts) else 0):
            self._fit(weight)
            self.posterior = self.predict(self.seen)

    def _fit(self, weight: np.ndarray) -> None:
        good, bad = weight * self.posterior, weight * (1 - self.posterior)
        self.prior = (good.sum() + 1) / (weight.sum() + 2)
        #: chance[c, labeller, vote + 1] with one made-up vote of each kind.
        self.chance = np.stack([
            np.stack([((self.seen == v) * w[:, None]).sum(axis=0) + 1 for v in (-1, 0, 1)], axis=1) / (w.sum() + 3) for w in (bad, good)
        ])

    def predict(self, seen: np.ndarray) -> np.ndarray:
        labeller = np.arange(seen.shape[1])[None, :]
        bad, good = (np.log(self.chance[c][labeller, seen + 1]).sum(axis=1) for c in (0, 1))
        odds = np.log(self.prior) - np.log(1 - self.prior) + good - bad
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """Per labeller: how often it is right when it votes."""
        right = self.prior * self.chance[1][:, 2] + (1 - self.prior) * self.chance[0][:, 0]
        wrong = self.prior * self.chance[1][:, 0] + (1 - self.prior) * self.chance[0][:, 2]
        return right / (right + wrong)


def shape(word: str) -> str:
    """``Thre***`` as ``Aa*``: runs of one kind of character as one."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", kinds)


REPEAT = 0


def features(word: bytes) -> tuple[int, int]:
    known = word.decode("utf-8", "replace")
    return (1 + xxhash.xxh64_intdigest(known.lower(), 1) % (DIMENSIONS - 1), 1 + xxhash.xxh64_intdigest(shape(known), 2) % (DIMENSIONS - 1))


class Weights(dict):
    """Weight of a word: the sum over its features; filled as words come."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        a, b = features(word)
        value = self[word] = float(self.weights[a] + self.weights[b])
        return value


def _examples(label_of: dict[str, float]):
    """Soft label, feature numbers and shares of each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids, shares = [], [], []
            for text in batch.column(0).to_pylist():
                words = text.split()
                tally: Counter = Counter()
                for word, count in Counter(words).items():
                    for f in features(word):
                        tally[f] += count
                tally[REPEAT] += sum(map(eq, words, words[1:]))
                labels.append(label_of[",".join(map(str, votes(text.decode("utf-8", "replace"))))])
                ids.append(list(tally))
                shares.append([c / max(1, len(words)) for c in tally.values()])
            yield pa.record_batch({"label": pa.array(labels, pa.float64()), "ids": pa.array(ids, pa.list_(pa.int32())), "shares": pa.array(shares, pa.list_(pa.float32()))})

    return run


def fit_scorer(docs: DataFrame, label_of: dict[str, float], *, text: str = "text", sample: int = 6000, rounds: int = 120, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer (Adam over the whole sample of different texts)."""
    texts = docs.select(utf8(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    # Copies count once, so the hashes are folded first; texts cross the network only up to the last hash of the sample.
    last = texts.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    chosen = texts.filter(F.col("hash") <= F.lit(last).cast("bigint")).dropDuplicates(["text"]).orderBy("hash", "text").limit(sample).select("text")
    rows = chosen.repartition(32, "text").mapInArrow(_examples(label_of), "label double, ids array<int>, shares array<float>").orderBy("label", F.xxhash64("ids", "shares")).toArrow()
    weights, bias = np.zeros(DIMENSIONS), 0.0
    if not rows.num_rows:
        return weights, bias
    label = rows["label"].to_numpy()
    ids = rows["ids"].combine_chunks()
    number = np.repeat(np.arange(len(label)), np.diff(ids.offsets.to_numpy()))
    at, share = ids.flatten().to_numpy(), rows["shares"].combine_chunks().flatten().to_numpy().astype(float)
    mean, spread, bias_mean, bias_spread = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = np.bincount(number, weights=weights[at] * share, minlength=len(label)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / len(label)
        slope = np.bincount(at, weights=error[number] * share, minlength=DIMENSIONS) + decay * weights
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        bias_mean, bias_spread = 0.9 * bias_mean + 0.1 * error.sum(), 0.99 * bias_spread + 0.01 * error.sum() ** 2
        scale = math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        weights -= rate * scale * mean / (np.sqrt(spread) + 1e-7)
        bias -= rate * scale * bias_mean / (math.sqrt(bias_spread) + 1e-7)
    return weights, bias


def fit_labels(docs: DataFrame, text: str = "text") -> tuple[LabelModel, dict[str, float]]:
    """The label model and the posterior of every pattern; its input is at most 2 ** 7 * 3 ** 2 rows."""
    counts = {tuple(map(int, r.pattern.split(","))): r.n for r in patterns(docs, text).collect()}
    model = LabelModel(counts)
    return model, {",".join(map(str, p)): float(x) for p, x in zip(model.seen.tolist(), model.posterior)}


def classify(docs: DataFrame, *, text: str = "text", keep_from: float = 0.5, **fit) -> DataFrame:
    """All documents with ``score`` (chance of good quality) and ``kept``."""
    _, label_of = fit_labels(docs, text)
    weights, bias = fit_scorer(docs, label_of, text=text, **fit)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    key = uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        store = worker_store("scorer")
        if key not in store:
            store.clear()
            store[key] = Weights(shared.value[0]), float(shared.value[0][REPEAT]), shared.value[1]
        weight, repeat, start = store[key]
        scores = []
        for value in texts:
            words = value.as_py().split()
            total = math.fsum(map(weight.__getitem__, words)) + repeat * sum(map(eq, words, words[1:]))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total / max(1, len(words)) + start)))))
        return pa.array(scores, pa.float64())

    return docs.withColumn("score", score(utf8(text))).withColumn("kept", F.col("score") >= keep_from)
