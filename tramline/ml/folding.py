"""Rows that trees cannot tell apart, folded to one weighted row.

Trees see a number only as one of ``maxBins`` bins.  Of all rows in the same bins they need how many these are and their
mean label: the spread inside cancels in every gain, and a leaf predicts a mean.  Spark's own estimators are fitted on
the folded rows with these weights, so a pass over the rows is needed once instead of at every level of every tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import ceil, factorial, prod
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext, inheritable_thread_target
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.  More groups than this, or than one row in eight, are not worth folding.
MOST_GROUPS, ROWS_PER_GROUP = 16_384, 8
MOST_FEATURES, MOST_CLASSES, MOST_VALUES = 256, 64, 1_024
QUANTILES, RANK_ERROR = 1_024, 1 / 4_096
# A fit on folded rows is a series of tiny jobs, so many run at a time.
THREADS = 8

VALUES = pa.schema([("feature", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])
GROUPS = "key bigint, n double, mean double, m2 double, counts array<double>, sums array<double>"


def foldable(estimator: Estimator) -> bool:
    """Whether the estimator is one of trees that sees nothing but bins, labels and weights, with every row counting once."""
    kind, core = type(estimator), estimator
    if kind is OneVsRest:
        core = estimator.getClassifier()
        if type(core) is not GBTClassifier or estimator.isSet(estimator.weightCol):
            return False
    if type(core) not in (RandomForestRegressor, RandomForestClassifier, GBTRegressor, GBTClassifier):
        return False
    forest = type(core) in (RandomForestRegressor, RandomForestClassifier)
    own = all(e.getFeaturesCol() == "features" and e.getLabelCol() == "label" for e in (estimator, core))
    every = core.getSubsamplingRate() == 1.0 and core.getMinInstancesPerNode() == 1 and core.getMinWeightFractionPerNode() == 0.0
    plain = core.getBootstrap() if forest else not core.isSet(core.validationIndicatorCol)
    squared = type(core) is not GBTRegressor or core.getLossType() == "squared"
    return own and every and plain and squared and not core.isSet(core.weightCol)


# --- bins -------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray | None:
    """Rows of features, or nothing if one is missing or no number."""
    if column.null_count:
        return None
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return values if np.isfinite(values).all() else None


def _values(most: int) -> Callable:
    """How often a task has each value of a feature, null for a feature of more than ``most``; feature -1 if some row cannot be folded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = {}, False
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1)
            bad = bad or x is None or y.null_count > 0 or not np.isfinite(y.to_numpy(zero_copy_only=False)).all()
            if bad or not len(x):
                continue
            for j in range(x.shape[1]):
                known = seen.setdefault(j, {})
                if known is not None:
                    for v, n in zip(*(a.tolist() for a in np.unique(x[:, j] + 0.0, return_counts=True))):
                        known[v] = known.get(v, 0) + n
                    seen[j] = known if len(known) <= most else None
        rows = [(-1, None, 0)] if bad else [(j, v, n) for j, known in seen.items() for v, n in ([(None, 0)] if known is None else known.items())]
        yield pa.RecordBatch.from_pylist([dict(zip(("feature", "value", "n"), r)) for r in rows], schema=VALUES)
    return run


def _representatives(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` of the values, which ascend: the frequent ones, and evenly spaced ranks of the others."""
    if len(values) <= bins:
        return values
    frequent = counts * bins >= counts.sum()
    left, ranks = bins - int(frequent.sum()), np.cumsum(counts[~frequent])
    places = np.searchsorted(ranks, (np.arange(left) + 0.5) * ranks[-1] / left)
    return np.sort(np.concatenate([values[frequent], values[~frequent][np.unique(places)]]))


def levels(rows: DataFrame, bins: int) -> list[np.ndarray] | None:
    """The value that stands for each bin, per feature; a bin ends half-way to the next one's value.

    A feature with at most ``bins`` values keeps all of them, others get evenly spaced ranks of all rows.  The half-way
    points are the split candidates that Spark's trees then take from the folded rows.
    """
    counted = rows.mapInArrow(_values(MOST_VALUES), "feature int, value double, n bigint").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    found: dict[int, dict] = {}
    for r in counted.collect():
        found.setdefault(r.feature, {})[r.value] = r.n
    if not found or -1 in found or len(found) > MOST_FEATURES:
        return None
    kept = {j: _representatives(*(np.array(a) for a in zip(*sorted(values.items()))), bins) for j, values in found.items() if None not in values}
    if many := [j for j in found if j not in kept]:
        flat = rows.select(*[F.get("x", F.lit(j)).alias(f"x{j}") for j in many])
        ranks = [i / QUANTILES for i in range(QUANTILES + 1)]
        for j, ranked in zip(many, flat.approxQuantile([f"x{j}" for j in many], ranks, RANK_ERROR)):
            kept[j] = _representatives(*np.unique(np.array(ranked) + 0.0, return_counts=True), bins)
    return [kept[j] for j in sorted(kept)]


# --- folding ----------------------------------------------------------------

def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """How often a row is drawn by the upper 16 bits of a uniform number; 255 where these do not settle it."""
    steps = np.cumsum([np.exp(-1.0) / factorial(k) for k in range(25)])
    low, high = (np.searchsorted(steps, (np.arange(65_536) + e) / 65_536, side="right") for e in (0.0, 1.0 - 1e-9))
    return np.where(low == high, low, 255).astype(np.uint8), steps


def _draws(rng: np.random.Generator, shape: tuple[int, int], table: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean one, as many as rows drawn with replacement come up."""
    size = shape[0] * shape[1]
    upper = np.frombuffer(rng.bytes(2 * size), np.uint16)
    drawn = table[upper]
    open_ = np.flatnonzero(drawn == 255)
    drawn[open_] = np.searchsorted(steps, (upper[open_] + rng.random(len(open_))) / 65_536, side="right")
    return drawn.reshape(shape)


class _Groups:
    """Counts, means and squared distances from the mean by key, and the draws of every tree."""

    def __init__(self, trees: int, most: int):
        self.index: dict[int, int] = {}
        self.most = most
        self.n, self.mean, self.m2 = np.zeros(most), np.zeros(most), np.zeros(most)
        self.counts, self.sums = np.zeros((most, trees)), np.zeros((most, trees))

    def add(self, keys: np.ndarray, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, draws: Callable) -> bool:
        """Take rows in; false if there are too many groups.  ``draws`` gives counts and sums in the order it is given."""
        order = np.argsort(keys, kind="stable")
        keys, n, mean, m2 = keys[order], n[order], mean[order], m2[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        at = np.array([self.index.setdefault(k, len(self.index)) for k in keys[starts].tolist()])
        if len(self.index) > self.most:
            return False
        total = np.add.reduceat(n, starts)
        centre = np.add.reduceat(n * mean, starts) / total
        off = mean - np.repeat(centre, np.diff(np.r_[starts, len(keys)]))
        spread = np.add.reduceat(m2 + n * off * off, starts)
        before = self.n[at]
        step, after = centre - self.mean[at], before + total
        self.mean[at] += step * total / after
        self.m2[at] += spread + step * step * before * total / after
        self.n[at] = after
        if self.counts.shape[1]:
            counts, sums = draws(order)
            self.counts[at] += np.add.reduceat(counts, starts, axis=0, dtype=np.float64)
            self.sums[at] += np.add.reduceat(sums, starts, axis=0)
        return True

    def batch(self) -> pa.RecordBatch:
        size = len(self.index)
        listed = [_lists(a[:size]) for a in (self.counts, self.sums)]
        plain = [pa.array(a[:size]) for a in (self.n, self.mean, self.m2)]
        return pa.RecordBatch.from_arrays([pa.array(list(self.index), pa.int64()), *plain, *listed], names=["key", "n", "mean", "m2", "counts", "sums"])


def _lists(rows: np.ndarray) -> pa.Array:
    places = np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(places), pa.array(np.ascontiguousarray(rows).reshape(-1)))


TOO_MANY = pa.RecordBatch.from_pylist([{"key": -1, "n": 0.0, "mean": 0.0, "m2": 0.0, "counts": [], "sums": []}], schema=pa.schema([("key", pa.int64()), ("n", pa.float64()), ("mean", pa.float64()), ("m2", pa.float64()), ("counts", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))]))


def _fold_rows(ends: list[np.ndarray], places: list[int], classes: int, trees: int, most: int, seed: int) -> Callable:
    """Groups of the rows of a task; every row is drawn anew for every tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, rng, poisson = _Groups(trees, most), np.random.default_rng([seed, TaskContext.get().partitionId()]), _poisson_table()
        fits = True
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            fits = fits and x is not None and np.isfinite(y).all() and (not classes or bool(((y == np.floor(y)) & (y >= 0) & (y < classes)).all()))
            if not fits or not len(y):
                continue
            keys = sum(np.searchsorted(e, x[:, j], side="left") * p for j, (e, p) in enumerate(zip(ends, places)))
            if classes:
                keys = keys * classes + y.astype(np.int64)

            def draws(order, y=y):
                drawn = _draws(rng, (len(y), trees), *poisson)
                return drawn, drawn * y[order, None]

            fits = groups.add(keys, np.ones(len(y)), y, np.zeros(len(y)), draws)
        yield groups.batch() if fits else TOO_MANY
    return run


def _merge(trees: int, most: int) -> Callable:
    """One row per key out of the groups of all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fits = _Groups(trees, most), True
        for batch in batches:
            keys, n, mean, m2 = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            fits = fits and not (keys < 0).any()
            if not fits or not len(keys):
                continue
            counts, sums = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1) for c in batch.columns[4:])
            fits = groups.add(keys, n, mean, m2, lambda order, c=counts, s=sums: (c[order], s[order]))
        yield groups.batch() if fits else TOO_MANY
    return run


def _numbers(df: DataFrame) -> DataFrame:
    return df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))


@dataclass
class Folded:
    """Groups of rows: the values that stand for their bins, their mean label, how many they are and their squared distances from the mean."""
    x: np.ndarray
    label: np.ndarray
    n: np.ndarray
    m2: np.ndarray
    counts: np.ndarray  # by group and tree: rows that a draw with replacement took
    sums: np.ndarray  # and the sum of their labels
    like: DataFrame

    def frame(self, label: np.ndarray, weight: np.ndarray) -> DataFrame:
        table = pa.table({"x": _lists(self.x), "label": label, "weight": weight})
        df = self.like.sparkSession.createDataFrame(table).select(array_to_vector("x").alias("features"), "label", "weight").coalesce(1)
        for c in ("features", "label"):
            df = df.withMetadata(c, self.like.schema[c].metadata)
        return df


def fold(df: DataFrame, levels: list[np.ndarray], classes: int, trees: int = 0, seed: int = 42) -> Folded | None:
    """The rows by the bins of their features (and by label, if there are classes), drawn for each of ``trees``; nothing if they do not fold."""
    sizes = [len(v) for v in levels]
    if prod(sizes) * max(classes, 1) >= 2**62:
        return None
    ends = [(v[:-1] + v[1:]) / 2.0 for v in levels]
    places = [prod(sizes[j + 1:]) for j in range(len(sizes))]
    tasks = df.sparkSession.sparkContext.defaultParallelism
    found = _numbers(df).mapInArrow(_fold_rows(ends, places, classes, trees, MOST_GROUPS, seed), GROUPS)
    found = found.repartition(tasks, "key").mapInArrow(_merge(trees, MOST_GROUPS), GROUPS).toArrow().sort_by("key")
    keys, n, mean, m2 = (c.to_numpy() for c in found.columns[:4])
    if not len(keys) or keys[0] < 0 or len(keys) > MOST_GROUPS:
        return None
    bins, label = (keys // classes, (keys % classes).astype(float)) if classes else (keys, mean)
    x = np.stack([v[bins // p % s] for v, p, s in zip(levels, places, sizes)], axis=1)
    counts, sums = (c.combine_chunks().flatten().to_numpy().reshape(len(keys), -1) for c in found.columns[4:])
    return Folded(x, label, n, m2, counts, sums, df)


# --- fitting ----------------------------------------------------------------

class FoldedRows:
    """Training and test rows, folded when the first estimator asks."""

    def __init__(self, train: DataFrame, test: DataFrame, classes: bool):
        self.train, self.test, self.classes = train, test, MOST_CLASSES if classes else 0
        self._folded: dict[int, tuple | None] = {}
        self._lock = Lock()

    def _of(self, bins: int, trees: int, seed: int) -> tuple[Folded, Folded | None] | None:
        with self._lock:
            held = self._folded.get(bins, ())
            if held == () or held and held[0].counts.shape[1] < trees:
                found = levels(_numbers(self.train), bins)
                train = found and fold(self.train, found, self.classes, trees, seed)
                worth = train and len(train.n) * ROWS_PER_GROUP <= train.n.sum()
                self._folded[bins] = held = (train, fold(self.test, found, self.classes)) if worth else None
            return held

    def fit(self, estimator: Estimator) -> tuple[Model, float, tuple[float, float | None] | None] | None:
        """The fitted estimator and its scores over all rows of training and test; nothing if the rows do not fold."""
        core = estimator.getClassifier() if type(estimator) is OneVsRest else estimator
        forest = type(core) in (RandomForestRegressor, RandomForestClassifier)
        held = self._of(core.getMaxBins(), core.getNumTrees() if forest and not self.classes else 0, core.getSeed() % 2**32)
        if held is None:
            return None
        train, test = held
        # Spark looks at maxBins ** 2 rows for its split candidates, which must be all.
        wide = {core.maxBins: max(core.getMaxBins(), ceil(len(train.n) ** 0.5))}
        if forest:
            model = self._forest(core, train, wide)
        else:
            rows = train.frame(train.label, train.n).persist()
            if core is estimator:
                model = core.copy({**wide, core.weightCol: "weight"}).fit(rows)
            else:
                model = estimator.copy({estimator.classifier: core.copy(wide), estimator.weightCol: "weight"}).fit(rows)
            rows.unpersist()
        score = _accuracy if self.classes else _squares
        return model, score(model, train)[0], score(model, test) if test else None

    def _forest(self, forest: Estimator, train: Folded, wide: dict) -> Model:
        """Every tree is fitted on its own draw of all rows; the trees become one of Spark's models."""
        trees, seed = forest.getNumTrees(), forest.getSeed()
        # Rows of a class are equal in all a tree sees: the sum of their draws is a Poisson number of mean n.
        rng = np.random.default_rng(seed % 2**32)
        counts = rng.poisson(train.n[:, None], (len(train.n), trees)).astype(float) if self.classes else train.counts
        strategy = forest.getFeatureSubsetStrategy()
        if strategy == "auto" and trees > 1:
            strategy = "sqrt" if self.classes else "onethird"

        def tree(i: int) -> Model:
            weight = counts[:, i]
            label = train.label if self.classes else np.where(weight > 0, train.sums[:, i] / np.maximum(weight, 1), train.label)
            own = {forest.numTrees: 1, forest.bootstrap: False, forest.featureSubsetStrategy: strategy, forest.seed: seed + i, forest.weightCol: "weight"}
            return forest.copy({**wide, **own}).fit(train.frame(label, weight))

        with ThreadPoolExecutor(THREADS) as pool:
            return _joined(forest, list(pool.map(inheritable_thread_target(self.train.sparkSession)(tree), range(trees))))


def _guesses(model: Model, rows: Folded) -> np.ndarray:
    return model.transform(rows.frame(rows.label, rows.n)).select("prediction").toArrow()["prediction"].to_numpy()


def _squares(model: Model, rows: Folded) -> tuple[float, float]:
    """R2 and mean squared error of all rows behind the folded ones."""
    n, mean, total = rows.n, rows.label, rows.n.sum()
    error, spread = (rows.m2.sum() + (n * (mean - v) ** 2).sum() for v in (_guesses(model, rows), (n * mean).sum() / total))
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(1.0 - error / spread), float(error / total)


def _accuracy(model: Model, rows: Folded) -> tuple[float, None]:
    return float(rows.n[_guesses(model, rows) == rows.label].sum() / rows.n.sum()), None


def _joined(forest: Estimator, single: list[Model]) -> Model:
    """One forest of the trees of many."""
    context = SparkContext._active_spark_context
    ml, size = context._jvm.org.apache.spark.ml, single[0].numFeatures
    regression = type(forest) is RandomForestRegressor
    kind = ml.regression.DecisionTreeRegressionModel if regression else ml.classification.DecisionTreeClassificationModel
    trees = context._gateway.new_array(kind, len(single))
    for i, model in enumerate(single):
        trees[i] = model._java_obj.trees()[0]
    if regression:
        joined = RandomForestRegressionModel(ml.regression.RandomForestRegressionModel(forest.uid, trees, size))
    else:
        joined = RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(forest.uid, trees, size, single[0].numClasses))
    return forest._copyValues(joined)
