"""Models: the comparison grid, demand, route efficiency and stop clusters."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.expressions import is_peak
from tramline.ml.folding import FoldedRows, foldable
from tramline.ml.prep import with_split
from tramline.operators.routes import FEATURE_COLUMNS, efficiency_score
from tramline.session import materialise

DEMAND_FEATURES = ["hour", "is_peak", "stop_lat", "stop_lon"]

# The search ranges.  Trees without a depth limit take Spark's maximum
# of 30; the inverse regularisation C becomes 1 / (C * rows).
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 3, 5]}
BOOST_GRID = {"maxIter": [50, 100, 200], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 5, 7]}
LOGISTIC_GRID = {"C": [0.1, 1.0, 10.0], "elasticNetParam": [1.0, 0.0]}

# Tables of more rows are dealt out and folded.
LARGE = 100_000


# --- comparison grid --------------------------------------------------------

@dataclass
class Fitted:
    algorithm: str
    model: Model
    train_score: float
    test_score: float
    test_mse: float | None = None


def _grid(estimator: Estimator, ranges: dict[str, list], rows: int) -> list:
    builder = ParamGridBuilder()
    for name, values in ranges.items():
        if name == "C":
            builder.addGrid(estimator.regParam, [1.0 / (c * rows) for c in values])
        else:
            builder.addGrid(estimator.getParam(name), values)
    return builder.build()


def candidates(task: str, n_classes: int = 2, seed: int = 42) -> dict[str, tuple[Estimator, dict]]:
    if task == "regression":
        return {
            "Random Forest": (RandomForestRegressor(numTrees=100, seed=seed), FOREST_GRID),
            "Linear Regression": (LinearRegression(), {}),
            "Gradient Boosting": (GBTRegressor(maxIter=100, seed=seed), BOOST_GRID),
        }
    found = {
        "Random Forest": (RandomForestClassifier(numTrees=100, seed=seed), FOREST_GRID),
        "Logistic Regression": (LogisticRegression(maxIter=1000), LOGISTIC_GRID),
    }
    boosting = GBTClassifier(maxIter=100, seed=seed)
    found["Gradient Boosting"] = (boosting if n_classes == 2 else OneVsRest(classifier=boosting), {})
    return found


def _compact(df: DataFrame, rows: int, rows_per_task: int = 100_000) -> DataFrame:
    """Merge the many small partitions of a small table, which every fit would visit again."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, rows // rows_per_task)
    return df.coalesce(wanted)


def _spread(df: DataFrame, rows: int, least: int = LARGE, rows_per_task: int = 500_000) -> DataFrame:
    """Rows of a table over ``least`` rows dealt evenly to at least one task per core.

    Every fit makes hundreds of passes over them, and their files may have fewer or uneven parts (a row group is read by one task).
    """
    if rows <= least:
        return _compact(df, rows)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // rows_per_task))


def fit_grid(
    train: DataFrame, test: DataFrame, task: str, n_classes: int = 2, full_grid: bool = False,
    ranges: dict[str, dict[str, list]] | None = None, estimators: dict[str, Estimator] | None = None,
    folds: int = 3, parallelism: int = 4,
) -> list[Fitted]:
    """Fit every candidate on ``features``/``label``; search with cross-validation.

    The full ranges take up to 27 fits per fold, so they are an option; ``ranges`` may
    give shorter ones per algorithm.  Tables of 100 rows or fewer are fitted as they are.
    Trees of large tables are fitted and scored on rows folded by their bins.
    """
    train, test = (df.select("features", "label") for df in (train, test))
    kept = [train.persist(), test.persist()]
    shares = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    rows = sum(shares)
    test = _compact(test, rows)
    if rows <= LARGE or len(shares) < train.sparkSession.sparkContext.defaultParallelism or max(shares) * len(shares) > 2 * rows:
        train = _spread(train, rows).persist()
        train.count()
        kept[0].unpersist()
        kept[0] = train
    regression = task == "regression"
    evaluator = (
        RegressionEvaluator(metricName="r2") if regression
        else MulticlassClassificationEvaluator(metricName="accuracy")
    )
    wanted = {}
    for name, (estimator, full) in candidates(task, n_classes).items():
        if estimators is None or name in estimators:
            wanted[name] = ((estimators or {}).get(name, estimator), (ranges or {}).get(name, full if full_grid else {}))
    folded = FoldedRows(train, test, not regression)
    fitted = []
    with ThreadPoolExecutor(parallelism) as pool:
        by_fold = inheritable_thread_target(train.sparkSession)(folded.fit)
        begun = {name: pool.submit(by_fold, e) for name, (e, searched) in wanted.items() if rows > LARGE and not searched and foldable(e)}
        for name, (estimator, searched) in wanted.items():
            if name in begun and (found := begun[name].result()):
                model, train_score, of_test = found
            else:
                if searched and rows > 100:
                    search = CrossValidator(
                        estimator=estimator, estimatorParamMaps=_grid(estimator, searched, rows),
                        evaluator=evaluator, numFolds=folds, seed=42, parallelism=parallelism,
                    )
                    model = search.fit(train).bestModel
                else:
                    model = estimator.fit(train)
                train_score, of_test = evaluator.evaluate(model.transform(train)), None
            if of_test is None:
                scored = model.transform(test)
                of_test = evaluator.evaluate(scored), RegressionEvaluator(metricName="mse").evaluate(scored) if regression else None
            fitted.append(Fitted(name, model, train_score, *of_test))
    for df in kept:
        df.unpersist()
    return fitted


def metrics_table(spark, target: str, task: str, fitted: list[Fitted]) -> DataFrame:
    rows = [(target, task, f.algorithm, f.train_score, f.test_score, f.test_mse) for f in fitted]
    return spark.createDataFrame(
        rows, "target string, task string, algorithm string, train_score double, test_score double, test_mse double"
    )


# --- metrics as aggregates --------------------------------------------------

def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2 and mean squared error; the total spread comes from the population variance."""
    error = F.pow(F.col(label) - F.col(prediction), 2)
    return df.agg(
        (F.lit(1.0) - F.try_divide(F.avg(error), F.var_pop(label))).alias("r2"), F.avg(error).alias("mse")
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction), in long form so any number of classes fits."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


# --- demand -----------------------------------------------------------------

def _regression_pipeline(features: list[str], regressor: Estimator) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="skip"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        regressor,
    ])


def demand_scores(demand: DataFrame, regressor: Estimator | None = None, keys: Sequence[str] = ("stop_id", "hour"), fraction: float = 0.2, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The demand model of four fifths of the rows, and its scores on both parts: ``part, rows, r2, mse``."""
    marked = with_split(_with_numeric_peak(demand), list(keys), fraction, seed)
    model = fit_demand(marked.filter(~F.col("is_test")), regressor, seed)
    scored = model.transform(marked).withColumn("part", F.when(F.col("is_test"), "test").otherwise("train"))
    error = F.pow(F.col("demand") - F.col("prediction"), 2)
    return model, scored.groupBy("part").agg(
        F.count("*").alias("rows"), (F.lit(1.0) - F.try_divide(F.avg(error), F.var_pop("demand"))).alias("r2"), F.avg(error).alias("mse"))


def _with_numeric_peak(df: DataFrame) -> DataFrame:
    return df.withColumn("is_peak", F.col("is_peak").cast("int"))


def fit_demand(demand: DataFrame, regressor: Estimator | None = None, seed: int = 42) -> PipelineModel:
    """Demand by hour, peak and place; minute and day are constant and left out."""
    regressor = regressor or GBTRegressor(labelCol="demand", maxIter=100, seed=seed)
    return _regression_pipeline(DEMAND_FEATURES, regressor).fit(_with_numeric_peak(demand))


def score_demand(model: PipelineModel, stops: DataFrame, hours: range = range(24), confidence: float | None = None) -> DataFrame:
    """Predicted demand of every stop at every hour."""
    grid = stops.select(
        F.col("stop_id").alias("station_id"), "stop_lat", "stop_lon",
        F.explode(F.lit(list(hours))).alias("hour"),
    ).withColumn("is_peak", is_peak("hour").cast("int"))
    return model.transform(grid).select(
        "station_id", "hour",
        F.greatest(F.round("prediction"), F.lit(0)).cast("int").alias("predicted_demand"),
        F.lit(confidence).cast("double").alias("confidence"),
        (F.col("is_peak") == 1).alias("peak_hour"),
    )


def predict_demand(model: PipelineModel, requests: DataFrame, stops: DataFrame) -> DataFrame:
    """Demand for asked (stop_id, hour) pairs; an unknown stop has no prediction."""
    located = requests.join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id", "left")
    known = located.filter(F.col("stop_lat").isNotNull()).withColumn("is_peak", is_peak("hour").cast("int"))
    scored = model.transform(known).select("stop_id", "hour", "prediction", F.lit("ok").alias("status"))
    unknown = located.filter(F.col("stop_lat").isNull()).select(
        "stop_id", "hour", F.lit(None).cast("double").alias("prediction"), F.lit("stop not found").alias("status")
    )
    return scored.unionByName(unknown)


# --- route efficiency -------------------------------------------------------

def fit_efficiency(features: DataFrame, noise: bool = False, seed: int = 42) -> PipelineModel:
    """Regressor of the efficiency score over the nine route features.

    Features and scores are checkpointed: the scores read the features twice, fitting reads the scores several times.
    """
    scored = materialise(efficiency_score(materialise(features), noise=noise, seed=seed))
    regressor = GBTRegressor(labelCol="efficiency", maxIter=20, seed=seed)
    return _regression_pipeline(FEATURE_COLUMNS, regressor).fit(scored)


# --- stop clusters ----------------------------------------------------------

def cluster_stops(stops: DataFrame, k: int = 50, seed: int = 42) -> DataFrame:
    """Stops with a ``cluster_id``, from k-means on standardised positions."""
    located = stops.dropna(subset=["stop_lat", "stop_lon"])
    n = located.limit(k).count()
    if n < 2:
        return located.withColumn("cluster_id", F.lit(0))
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=["stop_lat", "stop_lon"], outputCol="position"),
        StandardScaler(inputCol="position", outputCol="features", withMean=True),
        KMeans(k=min(k, n), seed=seed, predictionCol="cluster_id"),
    ])
    return pipeline.fit(located).transform(located).drop("position")


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(predictionCol="cluster_id").evaluate(clustered)


def cluster_sizes(clustered: DataFrame, small: int = 5) -> DataFrame:
    """Mean, largest and smallest cluster, and how many are small."""
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.avg("n").alias("avg_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"),
        F.count_if(F.col("n") < small).alias("small_clusters"),
    )


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Size, centre and recommendation per cluster."""
    return (
        clustered.groupBy("cluster_id")
        .agg(
            F.count("*").alias("n_stops"), F.avg("stop_lat").alias("center_lat"),
            F.avg("stop_lon").alias("center_lon"),
        )
        .withColumn("recommendation", F.when(F.col("n_stops") > 1, "consolidate").otherwise("keep"))
    )


def cluster_members(clustered: DataFrame) -> DataFrame:
    """Members in long form: a cluster may hold more stops than one array should."""
    return clustered.select("cluster_id", "stop_id")
