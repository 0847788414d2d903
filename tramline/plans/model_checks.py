"""Model preparation, metrics and fitted models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tramline.ml import models, prep, registry
from tramline.operators.routes import efficiency_score
from tramline.plans import roles
from tramline.plans.demand_checks import demand, features
from tramline.plans.registry import query
from tramline.plans.roles import rounded, table, with_roles
from tramline.session import materialise, new_folder

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("m1_standardised", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0::DOUBLE AS l_quantity_z,
           round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0::DOUBLE AS l_extendedprice_z
    FROM lineitem""")
def standardised(spark, d):
    scaled = prep.standardise(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(scaled.select(*ROW, "l_quantity_z", "l_extendedprice_z"))


def _draw(key: str) -> str:
    return f"('0x' || substr(md5({key} || '|42'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("m2_split", f"SELECT o_orderkey, {_draw('o_orderkey')} < 0.2 AS is_test FROM orders")
def hash_split(spark, d):
    return prep.with_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2)


@query("m2_stratified_split", f"""
    SELECT o_orderkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_draw('o_orderkey')}, o_orderkey)
               <= round(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) AS is_test FROM orders""")
def stratified_split(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return prep.with_stratified_split(orders, ["o_orderkey"], "o_orderpriority", 0.2)


@query("m3_targets", """
    SELECT 'regression' AS task, 'l_extendedprice' AS target FROM lineitem HAVING count(DISTINCT l_extendedprice) > 10
    UNION ALL SELECT 'classification', 'l_linestatus' FROM lineitem HAVING count(DISTINCT l_linestatus) BETWEEN 2 AND 50""")
def targets(spark, d):
    """Candidates among the line item columns, from their statistics."""
    found = prep.discover_targets(table(spark, d, "lineitem"))
    return spark.createDataFrame(found, "task string, target string")


@query("m14_label_encoding", """
    SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label FROM orders""")
def label_encoding(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return prep.label_encoder(orders, "o_orderpriority").transform(orders).select("o_orderkey", "label")


def prepared(spark, d):
    """Line items as model features; the price is the target."""
    rows = table(spark, d, "lineitem").select(
        *ROW, "l_quantity", F.nullif(F.col("l_tax"), F.lit(0.08)).alias("l_tax"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("l_returnflag"), "l_linestatus",
        F.col("l_extendedprice").alias("label"),
    )
    rows = prep.fill_categories(rows, ["l_returnflag", "l_linestatus"])
    pipeline = prep.build_preprocessor(rows, ["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"])
    return pipeline.fit(rows).transform(rows)


@query("m4_prepared_features", """
    WITH t AS (SELECT *, nullif(l_tax, 0.08) AS tax, coalesce(nullif(l_returnflag, 'N'), 'unknown') AS flag FROM lineitem),
         f AS (SELECT *, coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM t)) AS filled FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0::DOUBLE AS quantity,
           round((filled - avg(filled) OVER ()) / stddev_pop(filled) OVER (), 6) + 0.0::DOUBLE AS tax,
           (flag = 'A')::INTEGER::DOUBLE AS flag_a, (flag = 'R')::INTEGER::DOUBLE AS flag_r, (flag = 'unknown')::INTEGER::DOUBLE AS flag_unknown,
           (l_linestatus = 'F')::INTEGER::DOUBLE AS status_f, (l_linestatus = 'O')::INTEGER::DOUBLE AS status_o, 2.0::DOUBLE AS marks, l_extendedprice AS label FROM f""")
def prepared_features(spark, d):
    """Scaled numbers, and the mark of every value in the one-hot part."""
    values = vector_to_array("features")
    # Each text column has one more place, for values that fitting had not seen.
    marks = {"flag_a": 2, "flag_r": 3, "flag_unknown": 4, "status_f": 6, "status_o": 7}
    return rounded(prepared(spark, d).select(
        *ROW, F.get(values, F.lit(0)).alias("quantity"), F.get(values, F.lit(1)).alias("tax"),
        *[F.get(values, F.lit(i)).alias(c) for c, i in marks.items()],
        F.aggregate(F.slice(values, 3, F.size(values) - 2), F.lit(0.0), lambda a, x: a + x).alias("marks"),
        F.col("label"),
    ))


@query("m5_regression_grid")
def regression_grid(spark, d):
    """Three regressors of their own sizes on the line price."""
    train, test = prep.split(prepared(spark, d).select(*ROW, "features", "label"), ROW, 0.2)
    return models.metrics_table(spark, "l_extendedprice", "regression", models.fit_grid(train, test, "regression"))


@query("m5_classification_grid")
def classification_grid(spark, d):
    """Three classifiers of their own sizes on the line status."""
    rows = prepared(spark, d).drop("label").withColumn("label", F.col("l_linestatus_index"))
    assembled = VectorAssembler(inputCols=["numbers_scaled", "l_returnflag_hot"], outputCol="f").transform(rows)
    data = assembled.select(*ROW, F.col("f").alias("features"), "label")
    # Split and features of all rows are made once for both parts.
    marked = prep.stratified_or_plain(data, ROW, "label", prep.test_fraction(data.count())).select("features", "label", "is_test").persist()
    train, test = marked.filter(~F.col("is_test")), marked.filter("is_test")
    classes = data.agg(F.count_distinct("label")).first()[0]
    fitted = models.fit_grid(train, test, "classification", n_classes=classes)
    marked.unpersist()
    return models.metrics_table(spark, "l_linestatus", "classification", fitted)


@query("m7_kept_winner", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, true AS same FROM lineitem")
def kept_winner(spark, d):
    """The winner of a grid, saved with its preparation, says the same after loading, from raw rows."""
    path = new_folder(spark, "winner")
    rows = prep.fill_categories(table(spark, d, "lineitem").withColumn("label", F.col("l_extendedprice")), ["l_returnflag", "l_linestatus"])
    preparation = prep.build_preprocessor(rows, ["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"]).fit(rows)
    train, test = prep.split(preparation.transform(rows).select(*ROW, "features", "label"), ROW, 0.2)
    fitted = models.fit_grid(train, test, "regression", estimators={"Linear Regression": LinearRegression(), "Random Forest": RandomForestRegressor(numTrees=5, seed=42)})
    metrics = models.metrics_table(spark, "l_extendedprice", "regression", fitted)
    best = registry.best_overall(metrics).first().algorithm
    whole = registry.keep_winner(spark, path, preparation, next(f.model for f in fitted if f.algorithm == best), metrics)
    loaded, _ = registry.load_best(spark, path)
    both = loaded.transform(whole.transform(rows).select(*rows.columns, F.col("prediction").alias("before")))
    return both.select(*ROW, (F.col("prediction") == F.col("before")).alias("same"))


def predictions(spark, d):
    """A guess of the price from the quantity, as a model would give it."""
    return table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000.0).alias("prediction")
    )


@query("m6_regression_metrics", """
    SELECT round(1 - avg(pow(label - prediction, 2)) / var_pop(label), 6) AS r2, round(avg(pow(label - prediction, 2)), 2) AS mse
    FROM (SELECT l_extendedprice AS label, l_quantity * 2000.0::DOUBLE AS prediction FROM lineitem)""")
def regression_metrics(spark, d):
    return models.regression_metrics(predictions(spark, d)).select(
        F.round("r2", 6).alias("r2"), F.round("mse", 2).alias("mse")
    )


@query("m6_accuracy", """
    SELECT round(avg((l_linestatus = CASE WHEN l_quantity > 20 THEN 'O' ELSE 'F' END)::INTEGER), 6) AS accuracy FROM lineitem""")
def accuracy(spark, d):
    guess = F.when(F.col("l_quantity") > 20, "O").otherwise("F")
    return rounded(models.accuracy(
        table(spark, d, "lineitem").select(F.col("l_linestatus").alias("label"), guess.alias("prediction"))
    ))


@query("m6_confusion", """
    SELECT l_returnflag AS label, l_linestatus AS prediction, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def confusion(spark, d):
    return models.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("m7_saved_model")
def saved_model(spark, d):
    """A demand model written, read back and used."""
    path = new_folder(spark, "model")
    grid = demand(spark, d)
    model = models.fit_demand(grid, LinearRegression(labelCol="demand"))
    scored = model.transform(grid.withColumn("is_peak", F.col("is_peak").cast("int")))
    registry.save_best(spark, path, model, models.regression_metrics(scored, "demand"))
    loaded, _ = registry.load_best(spark, path)
    return models.score_demand(loaded, roles.stops(spark, d))


@query("m9_efficiency_model")
def efficiency_model(spark, d):
    found = materialise(features(spark, d))
    scored = efficiency_score(found)
    model = models.fit_efficiency(found)
    return rounded(model.transform(scored).select("route_id", "efficiency", "prediction"))


@query("m10_stop_clusters")
def stop_clusters(spark, d):
    return models.cluster_members(models.cluster_stops(roles.stops(spark, d)))


@query("m11_demand_model")
def demand_model(spark, d):
    model = models.fit_demand(demand(spark, d))
    return models.score_demand(model, roles.stops(spark, d))


@query("m12_demand_requests")
def demand_requests(spark, d):
    """Demand asked for the user of every event, most of whom are no stops."""
    model = models.fit_demand(demand(spark, d), LinearRegression(labelCol="demand"))
    asked = table(spark, d, "events").select(F.col("user_id").alias("stop_id"), F.hour("ts").alias("hour")).distinct()
    return rounded(models.predict_demand(model, asked, roles.stops(spark, d)))


@query("m10_cluster_of_stop", with_roles("stops", "SELECT stop_id, 1::BIGINT AS clusters, true AS numbered FROM stops"))
def cluster_of_stop(spark, d):
    """Every stop is in one cluster, and clusters are numbered below their count."""
    clustered = models.cluster_stops(roles.stops(spark, d))
    return clustered.groupBy("stop_id").agg(F.count_distinct("cluster_id").alias("clusters"), F.max(F.col("cluster_id").between(0, 49)).alias("numbered"))


@query("m11_demand_grid", with_roles("stops", "SELECT stop_id AS station_id, hour::INTEGER AS hour, (hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19) AS peak_hour, true AS whole FROM stops, range(24) r(hour)"))
def demand_grid(spark, d):
    """A prediction for every stop and hour, whole and not below zero."""
    model = models.fit_demand(demand(spark, d), LinearRegression(labelCol="demand"))
    return models.score_demand(model, roles.stops(spark, d)).select("station_id", "hour", "peak_hour", (F.col("predicted_demand") >= 0).alias("whole"))


@query("m11_demand_scores")
def demand_scores(spark, d):
    """Scores of the demand model on the rows it was fitted on and on the others."""
    return models.demand_scores(demand(spark, d))[1]


@query("m12_request_status", with_roles("stops", """
    SELECT DISTINCT user_id AS stop_id, hour(ts)::INTEGER AS hour, CASE WHEN stop_id IS NULL THEN 'stop not found' ELSE 'ok' END AS status, stop_id IS NOT NULL AS predicted
    FROM events LEFT JOIN stops ON user_id = stop_id"""))
def request_status(spark, d):
    """Which of the asked stops get a prediction."""
    model = models.fit_demand(demand(spark, d), LinearRegression(labelCol="demand"))
    asked = table(spark, d, "events").select(F.col("user_id").alias("stop_id"), F.hour("ts").alias("hour")).distinct()
    return models.predict_demand(model, asked, roles.stops(spark, d)).select("stop_id", "hour", "status", F.col("prediction").isNotNull().alias("predicted"))


@query("m13_model_log", """
    SELECT event_type AS model, round(avg(value), 6) AS score, '0.0.1' AS version FROM events GROUP BY 1
    UNION ALL SELECT event_type, round(max(value), 6), '0.0.2' FROM events GROUP BY 1""")
def model_log(spark, d):
    """A mean and a largest value logged as two versions of a model per kind of event."""
    path = new_folder(spark, "model-log")
    scores = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.max("value").alias("b")).collect()
    for score in ("a", "b"):
        for row in scores:
            registry.log_metrics(spark, path, row.event_type, row[score])
    return registry.read_metrics(spark, path).select("model", F.round("score", 6).alias("score"), "version")
