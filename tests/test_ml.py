"""Splits, targets, grids, saved models."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tramline.ml import models, prep, registry


def test_standardise_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, flat double")
    rows = prep.standardise(df, ["a", "flat"]).orderBy("a").collect()
    assert [(r.a_z, r.flat_z) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_fraction():
    assert prep.test_fraction(10) == 0.3 and prep.test_fraction(500) == 0.2 and prep.test_fraction(10**6) == 0.1


def test_split_is_stable_and_complete(spark):
    df = spark.range(2000)
    train, test = prep.split(df, ["id"], 0.2)
    assert train.count() + test.count() == 2000 and 330 < test.count() < 470
    assert sorted(test.collect()) == sorted(prep.split(df.repartition(7), ["id"], 0.2)[1].collect())


def test_stratified_counts(spark):
    """One label holds most rows, one holds nulls; every label gets its share."""
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "big").when(F.col("id") < 990, "mid").when(F.col("id") < 995, "tiny").alias("label"))
    marked = prep.with_stratified_split(df, ["id"], "label", 0.2)
    counts = {r.label: (r.n, r.t) for r in marked.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {"big": (700, 140), "mid": (290, 58), "tiny": (5, 1), None: (5, 1)}
    lone = df.withColumn("label", F.when(F.col("id") == 0, "lone").otherwise("rest"))
    assert prep.stratified_or_plain(lone, ["id"], "label", 0.2).count() == 1000


def test_targets(spark):
    df = spark.range(100).select(
        (F.col("id") * 1.5).alias("fare_amount"), (F.col("id") % 5).alias("route"), F.when(F.col("id") < 40, F.col("id")).alias("price"),
        F.lit("x").alias("status"), F.lit("Accra").alias("city"), F.concat(F.lit("n"), F.col("id") % 60).alias("station"))
    assert prep.discover_targets(df) == [("regression", "fare_amount"), ("classification", "route")]
    plain = df.select(F.col("fare_amount").alias("x"), F.col("route").alias("k"), "city")
    assert prep.discover_targets(plain) == [("regression", "x"), ("classification", "k")]
    both = df.select(F.col("fare_amount").alias("cost"), (F.col("route") + F.col("fare_amount") % 12).alias("route_time"))
    assert ("regression", "route_time") in prep.discover_targets(both) and ("classification", "route_time") in prep.discover_targets(both)


def test_preprocessor(spark):
    df = spark.createDataFrame([(1.0, "a", "p q"), (None, None, "r"), (3.0, "b", "s")], "n double, t string, w string")
    df = prep.fill_categories(df, ["t"])
    model = prep.build_preprocessor(df, ["n"], ["t"], wide=["w"], hash_size=16).fit(df)
    unseen = spark.createDataFrame([(2.0, "zz", "new")], "n double, t string, w string")
    row = model.transform(unseen).select(vector_to_array("features").alias("f")).collect()[0].f
    assert row[0] == pytest.approx(0.0) and sum(row[1:4]) == 0.0
    with pytest.raises(ValueError):
        prep.build_preprocessor(df, [], [])


def test_label_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "t string")
    assert [r.label for r in prep.label_encoder(df, "t").transform(df).collect()] == [1.0, 0.0, 1.0]


def test_grid_beats_the_mean(spark):
    df = spark.range(400).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + F.col("id") % 3).alias("label"))
    data = prep.build_preprocessor(df, ["x"], []).fit(df).transform(df).select("id", "features", "label")
    train, test = prep.split(data, ["id"])
    fitted = models.fit_grid(train, test, "regression", estimators={
        "Linear Regression": LinearRegression(), "Random Forest": RandomForestRegressor(numTrees=5, seed=42)},
        ranges={"Random Forest": {"maxDepth": [2, 5]}})
    scores = {f.algorithm: f.test_score for f in fitted}
    assert scores["Linear Regression"] > 0.99 and scores["Random Forest"] > 0.8
    table = models.metrics_table(spark, "label", "regression", fitted)
    assert registry.best_models(table).collect()[0].algorithm == "Linear Regression"
    again = models.fit_grid(train, test, "regression", estimators={"Random Forest": RandomForestRegressor(numTrees=5, maxDepth=5, seed=42)})
    assert again[0].test_score == pytest.approx(scores["Random Forest"])


def test_grid_deals_a_large_table_out(spark):
    """Rows that one file part holds are fitted by all cores, in even shares; a small table keeps its parts."""
    shares = []

    class Noted(LinearRegression):
        def fit(self, df):
            shares.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
            return super().fit(df)

    for n in (120_000, 1_000):
        df = spark.range(n).coalesce(1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7 + F.col("id") * 2.0).alias("label"))
        data = prep.build_preprocessor(df, ["x"], []).fit(df).transform(df).select("features", "label")
        models.fit_grid(data, data.limit(10), "regression", estimators={"Linear Regression": Noted()})
    large, small = shares
    assert len(large) == spark.sparkContext.defaultParallelism and sum(large) == 120_000 and max(large) - min(large) <= len(large)
    assert small == [1_000]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "label double, prediction double")
    row = models.regression_metrics(df).collect()[0]
    assert row.mse == pytest.approx(1 / 3) and row.r2 == pytest.approx(0.5)
    assert models.accuracy(df).collect()[0].accuracy == pytest.approx(2 / 3)
    assert {(r.label, r.prediction): r.n for r in models.confusion(df).collect()} == {(1.0, 1.0): 1, (2.0, 3.0): 1, (3.0, 3.0): 1}


def test_best_ties_and_wins(spark):
    rows = [("t1", "regression", "B", 0.5), ("t1", "regression", "A", 0.5), ("t2", "classification", "B", 0.9), ("t2", "classification", "A", 0.1)]
    metrics = spark.createDataFrame(rows, "target string, task string, algorithm string, test_score double")
    assert {r.target: r.algorithm for r in registry.best_models(metrics).collect()} == {"t1": "A", "t2": "B"}
    assert registry.best_overall(metrics).collect()[0].target == "t2"
    assert {r.algorithm: r.wins for r in registry.wins(metrics).collect()} == {"A": 1, "B": 1}


def test_versions(spark, tmp_path):
    log = spark.createDataFrame([("m", "0.9.9"), ("m", "0.10.1"), ("n", "2.0.0")], "model string, version string")
    names = spark.createDataFrame([("m",), ("n",), ("new",)], "model string")
    assert {r.model: r.next_version for r in registry.next_version(log, names).collect()} == {"m": "0.10.2", "n": "2.0.1", "new": "0.0.1"}
    path = str(tmp_path / "log")
    assert [registry.log_metrics(spark, path, "m", s) for s in (0.1, 0.2)] == ["0.0.1", "0.0.2"]
    assert sorted((r.score, r.version) for r in registry.read_metrics(spark, path).collect()) == [(0.1, "0.0.1"), (0.2, "0.0.2")]


def test_two_writers_get_two_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log")
    with ThreadPoolExecutor(6) as pool:
        given = list(pool.map(lambda _: registry.claim_version(spark, path, "a/b"), range(12)))
    assert sorted(given, key=lambda v: int(v.split(".")[2])) == [f"0.0.{i}" for i in range(1, 13)]


def test_scores_of_unseen_rows(spark):
    rows = spark.createDataFrame([(i, i % 24, i % 24 in (7, 8, 9, 17, 18, 19), 5.0 + i % 7, 0.1 * (i % 5), float(i % 24)) for i in range(400)], "stop_id int, hour int, is_peak boolean, stop_lat double, stop_lon double, demand double")
    _, scores = models.demand_scores(rows, LinearRegression(labelCol="demand"))
    found = {r.part: r for r in scores.collect()}
    assert found["train"].rows + found["test"].rows == 400 and 40 < found["test"].rows < 120
    assert found["test"].r2 > 0.99 and found["test"].mse < 1


def test_three_classes_get_boosting(spark):
    assert set(models.candidates("classification", 3)) == set(models.candidates("classification", 2)) == {"Random Forest", "Logistic Regression", "Gradient Boosting"}
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense(float(i % 3), float(i % 2)), float(i % 3)) for i in range(60)], ["features", "label"])
    boosting = models.candidates("classification", 3)["Gradient Boosting"][0]
    boosting.getClassifier().setMaxIter(3)
    assert models.accuracy(boosting.fit(rows).transform(rows)).first()[0] == 1.0


def test_clusters(spark):
    stops = spark.createDataFrame([(i, float(i % 2) * 10 + i * 0.001, 0.0) for i in range(20)] + [(99, None, 1.0)], "stop_id int, stop_lat double, stop_lon double")
    clustered = models.cluster_stops(stops, k=2)
    groups = {}
    for r in clustered.collect():
        groups.setdefault(r.cluster_id, set()).add(r.stop_id % 2)
    assert len(groups) == 2 and all(len(g) == 1 for g in groups.values())
    assert models.silhouette(clustered) > 0.9
    assert tuple(models.cluster_sizes(clustered, small=11).collect()[0]) == (10.0, 10, 10, 2)
    assert {r.recommendation for r in models.cluster_summary(clustered).collect()} == {"consolidate"}
    assert models.cluster_stops(stops.limit(1)).collect()[0].cluster_id == 0


def test_demand_model(spark, tmp_path):
    grid = spark.range(24 * 10).select(
        (F.col("id") / 24).cast("int").cast("string").alias("stop_id"), (F.col("id") % 24).cast("int").alias("hour"),
        (F.col("id") / 24 * 0.01).alias("stop_lat"), F.lit(0.5).alias("stop_lon"))
    grid = grid.withColumn("is_peak", F.col("hour").between(7, 9)).withColumn("demand", F.when(F.col("is_peak"), 50).otherwise(5))
    model = models.fit_demand(grid)
    stops = spark.createDataFrame([("0", 0.0, 0.5)], "stop_id string, stop_lat double, stop_lon double")
    scored = {r.hour: r for r in models.score_demand(model, stops, confidence=0.9).collect()}
    assert len(scored) == 24 and scored[8].predicted_demand > 40 and scored[3].predicted_demand < 10
    assert scored[8].peak_hour and scored[8].confidence == 0.9
    asked = spark.createDataFrame([("0", 8), ("nowhere", 8)], "stop_id string, hour int")
    rows = {r.stop_id: r.status for r in models.predict_demand(model, asked, stops).collect()}
    assert rows == {"0": "ok", "nowhere": "stop not found"}
    registry.save_best(spark, str(tmp_path), model, spark.createDataFrame([("demand", 0.9)], "model string, score double"))
    loaded, metrics = registry.load_best(spark, str(tmp_path))
    again = {r.hour: r.predicted_demand for r in models.score_demand(loaded, stops).collect()}
    assert again == {h: r.predicted_demand for h, r in scored.items()} and metrics.collect()[0].score == 0.9


def test_run_models(spark, sf_dir, tmp_path):
    """One model completes, one has no data, one fails; all are reported."""
    from tramline.plans import flows, roles

    parts = [f(spark, sf_dir) for f in (roles.routes, roles.trips, roles.stop_times, roles.stops)]
    runs, totals = flows.run_models(spark, *parts, str(tmp_path / "a"))
    assert {r.model: r.status for r in runs.collect()} == {m: "completed" for m in flows.MODELS}
    assert tuple(totals.collect()[0]) == (3, 0, 0)
    lines = spark.read.json(str(tmp_path / "a" / "demand_prediction_results"))
    assert set(lines.columns) >= {"station_id", "hour", "predicted_demand", "peak_hour"}
    parts[2] = parts[2].limit(0)
    parts[3] = parts[3].withColumnRenamed("stop_lat", "nowhere")
    runs, totals = flows.run_models(spark, *parts, str(tmp_path / "b"), ("demand_prediction", "stop_clustering"))
    assert {r.model: (r.status, r.reason is None) for r in runs.collect()} == {
        "demand_prediction": ("skipped", False), "stop_clustering": ("failed", False)}
    assert tuple(totals.collect()[0]) == (0, 1, 1)


def test_efficiency_reads_its_features_once(spark):
    """Fitting goes over the scores many times; the features behind them are computed once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return float(value)

    columns = [F.col("id").alias("route_id"), F.udf(counted, "double")("id").alias("n_stops")]
    columns += [(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(models.FEATURE_COLUMNS) if c != "n_stops"]
    models.fit_efficiency(spark.range(40).select(*columns))
    assert seen.value == 40
