"""Trees on folded rows say what they say on all rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from tramline.ml import folding, models, prep

ROWS = 120_000


@pytest.fixture(scope="module")
def rows(spark):
    """Two features of few values and one of a value per row, with a price and a class that hang on them."""
    i = F.col("id")
    a, b, c = i % 7, F.floor(i / 7) % 5, F.rand(3) * 10
    df = spark.range(ROWS).select("id", a.alias("a"), b.alias("b"), c.alias("c"), F.randn(4).alias("e"))
    return df.select("id", array_to_vector(F.array(*[F.col(x).cast("double") for x in "abc"])).alias("features"),
                     array_to_vector(F.array(F.col("a").cast("double"), F.col("b").cast("double"))).alias("few"),
                     (F.col("a") * 3 + F.when(F.col("b") > 2, 10).otherwise(0) + F.col("c") + F.col("e") * 4).alias("price"),
                     (F.col("a") + F.col("e") * 2 > 3).cast("double").alias("kind")).localCheckpoint()


def test_fits_see_folded_rows(spark, rows, monkeypatch):
    """Every fit of a large table's trees went over all its rows."""
    seen = []
    for kind in (RandomForestRegressor, GBTRegressor):
        def fit(self, df, params=None, kept=kind.fit):
            seen.append(df.count())
            return kept(self, df)

        monkeypatch.setattr(kind, "fit", fit)
    data = rows.select("id", "features", F.col("price").alias("label"))
    train, test = prep.split(data, ["id"], 0.1)
    small = {"Random Forest": RandomForestRegressor(numTrees=6, seed=1), "Gradient Boosting": GBTRegressor(maxIter=3, seed=1)}
    fitted = models.fit_grid(train, test, "regression", estimators=small)
    assert len(seen) == 7 and max(seen) <= 7 * 5 * 32
    for f in fitted:
        assert f.train_score == pytest.approx(RegressionEvaluator(metricName="r2").evaluate(f.model.transform(train)), rel=1e-9) and f.train_score > 0.5
        assert f.test_score == pytest.approx(RegressionEvaluator(metricName="r2").evaluate(f.model.transform(test)), rel=1e-9)
        assert f.test_mse == pytest.approx(RegressionEvaluator(metricName="mse").evaluate(f.model.transform(test)), rel=1e-9)


def test_classes(spark, rows):
    data = rows.select("id", "features", F.col("kind").alias("label"))
    train, test = prep.split(data, ["id"], 0.1)
    small = {"Random Forest": RandomForestClassifier(numTrees=6, seed=1), "Gradient Boosting": GBTClassifier(maxIter=3, seed=1)}
    for f in models.fit_grid(train, test, "classification", estimators=small):
        for part, score in ((train, f.train_score), (test, f.test_score)):
            assert score == pytest.approx(MulticlassClassificationEvaluator(metricName="accuracy").evaluate(f.model.transform(part)), rel=1e-9) and score > 0.7


@pytest.mark.parametrize("label, boosting", [("price", GBTRegressor), ("kind", GBTClassifier)])
def test_boosting_is_the_same_as_on_all_rows(spark, rows, label, boosting):
    data = rows.select(F.col("few").alias("features"), F.col(label).alias("label"))
    boosting = boosting(maxIter=4, seed=1)
    folded, *_ = folding.FoldedRows(data, data, label == "kind").fit(boosting)
    whole = boosting.fit(data)
    kinds = data.select("features").distinct()
    by_row = [{str(r.features): r.prediction for r in m.transform(kinds).collect()} for m in (folded, whole)]
    assert len(by_row[0]) == 35 and by_row[0] == pytest.approx(by_row[1], rel=1e-6)


def test_forest_draws_every_row(spark, rows, tmp_path):
    """Counts of a group are Poisson numbers of its size, sums those of the rows drawn; the forest is one of Spark's, and is kept."""
    data = rows.select(F.col("few").alias("features"), F.col("price").alias("label")).persist()
    found = folding.fold(data, folding.levels(folding._numbers(data), 32), 0, 200)
    exact = {(r.a, r.b): (r.n, r.m, r.v) for r in rows.groupBy(F.get(folding.vector_to_array("few"), F.lit(0)).alias("a"), F.get(folding.vector_to_array("few"), F.lit(1)).alias("b")).agg(F.count("*").alias("n"), F.avg("price").alias("m"), F.var_pop("price").alias("v")).collect()}
    assert len(found.n) == 35 == len(exact)
    n, mean, spread = map(np.array, zip(*[exact[tuple(x)] for x in found.x]))
    assert (found.n == n).all() and found.label == pytest.approx(mean) and found.m2 / found.n == pytest.approx(spread)
    assert found.counts.mean() == pytest.approx(n.mean(), rel=0.01) and (found.counts.var(axis=1) / n).mean() == pytest.approx(1, abs=0.1)
    of_draw = found.sums / found.counts
    assert of_draw.mean(axis=1) == pytest.approx(mean, rel=0.01) and (of_draw.var(axis=1) * n / spread).mean() == pytest.approx(1, abs=0.1)
    model, *_ = folding.FoldedRows(data, data, False).fit(RandomForestRegressor(numTrees=5, maxDepth=3, seed=7))
    assert isinstance(model, RandomForestRegressionModel) and model.getNumTrees == 5 and len({t.toDebugString for t in model.trees}) == 5
    model.write().save(str(tmp_path / "m"))
    again = RandomForestRegressionModel.load(str(tmp_path / "m"))
    assert model.transform(data).join(again.transform(data).select("features", F.col("prediction").alias("p")).distinct(), "features").filter("prediction != p").isEmpty()


def test_what_does_not_fold(spark, rows):
    """Many features of many values, values that are none, and rows that count otherwise are left to the estimator."""
    wide = rows.select(array_to_vector(F.array(*[F.rand(i) for i in range(4)])).alias("features"), F.col("price").alias("label")).localCheckpoint()
    assert folding.FoldedRows(wide, wide, False).fit(GBTRegressor(maxIter=1)) is None
    gap = rows.select("features", F.when(F.col("id") != 5, F.col("price")).alias("label"))
    assert folding.FoldedRows(gap, gap, False).fit(GBTRegressor(maxIter=1)) is None
    assert not folding.foldable(RandomForestRegressor(minInstancesPerNode=3)) and not folding.foldable(GBTRegressor(subsamplingRate=0.5))
    assert folding.foldable(RandomForestClassifier()) and folding.foldable(models.candidates("classification", 3)["Gradient Boosting"][0])


def test_bins_are_ranks_of_all_rows():
    values, counts = np.arange(1_000.0), np.ones(1_000)
    counts[0] = 9_000
    chosen = folding._representatives(values, counts, 32)
    assert len(chosen) == 32 and chosen[0] == 0 and np.diff(chosen[1:]).max() < 40 and chosen[-1] > 960
    assert (folding._representatives(values[:32], counts[:32], 32) == values[:32]).all()

