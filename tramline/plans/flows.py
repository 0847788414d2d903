"""Whole paths made of operators: answering trip questions, combining city files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.ml import models
from tramline.operators import clean, demand, joins, keyed, match, reports, routes as route_ops
from tramline.session import materialise
from tramline.sources import claims, files

NO_ROUTE = "No direct route found between these stations in the data."
NO_FARE = "Fare not available."


def answer_trip_questions(
    questions: DataFrame, stations: DataFrame, routes: DataFrame, trips: DataFrame, fares: DataFrame,
    text: str = "question", fare_order: Sequence[str] = ("id",),
) -> DataFrame:
    """``A to B`` questions to stations, a direct route and a fare.

    Each distinct question is parsed once, each distinct place name is matched once, each distinct station pair is
    routed once; parsed questions and places are checkpointed, since matching and both joins read them again.
    """
    parsed = materialise(match.parse_od(questions.select(text).distinct(), text))
    places = materialise(parsed.select(F.col("origin").alias("place")).unionByName(
        parsed.select(F.col("destination").alias("place"))
    ).dropna().distinct())
    found = materialise(match.fuzzy_match(places, stations, "place", "stop_name", ["id"]).select(
        "place", F.col("matched_id").alias("station"), F.col("matched_name").alias("name")
    ))
    origin = found.select(F.col("place").alias("origin"), F.col("station").alias("from_id"), F.col("name").alias("from_name"))
    destination = found.select(F.col("place").alias("destination"), F.col("station").alias("to_id"), F.col("name").alias("to_name"))
    located = parsed.join(origin, "origin", "left").join(destination, "destination", "left")
    pairs = located.select("from_id", "to_id").dropna().distinct()
    routed = joins.direct_routes(pairs, trips).join(
        routes.select("route_id", "short_name", "long_name"), "route_id", "left"
    )
    priced = joins.fare_lookup(routed, fares, fare_order)
    both = F.col("from_id").isNotNull() & F.col("to_id").isNotNull()
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("from_id").isNull(), F.concat(F.lit("Could not find station matching '"), "origin", F.lit("'.")))
        .when(F.col("to_id").isNull(), F.concat(F.lit("Could not find station matching '"), "destination", F.lit("'.")))
        .otherwise("ok")
    )
    return located.join(priced, ["from_id", "to_id"], "left").select(
        text, status.alias("status"), "from_name", "to_name",
        F.concat(F.col("short_name"), F.lit(" - "), F.col("long_name")).alias("route"),
        F.when(both & F.col("route_id").isNull(), NO_ROUTE).alias("route_note"),
        "fare_amount",
        F.when(both & F.col("fare_amount").isNull(), NO_FARE).alias("fare_note"),
    )


def clean_city_files(
    spark: SparkSession, root: str, out: str, exclude: Sequence[str] = (), null_threshold: float = 0.7,
) -> DataFrame:
    """Clean every city file, then stack per city and over all cities.

    Medians, modes and fences belong to a file; all files are cleaned in one plan, and one write
    takes all files with the same typed columns: ``<out>/by_city/layout=<n>/city=<city>/source_file=<file>``.
    Stacks of at least three common columns go to ``<out>/by_city_combined/layout=<n>/city=<city>``
    and ``<out>/combined``.  Returns status, reason and rows in and out per file; a file that
    cannot be cleaned does not keep the others from it.
    """
    found = keyed.clean_cells(files.read_cells(spark, root), null_threshold, exclude)
    cleaned = replace(found, rows=materialise(found.rows), columns=materialise(found.columns), report=materialise(found.report))
    for n, (columns, keys) in enumerate(keyed.layouts(cleaned.columns, keyed.FILE)):
        rows = cleaned.rows.join(keys, keyed.FILE, "left_semi").select(*keyed.FILE, *[keyed.typed_column(*c) for c in columns])
        rows.write.mode("overwrite").partitionBy(*keyed.FILE).parquet(f"{out}/by_city/layout={n}")
    for n, (columns, cities) in enumerate(keyed.layouts(keyed.shared_columns(cleaned.columns, ["city"]), ["city"])):
        rows = cleaned.rows.join(cities, "city", "left_semi").select(*keyed.FILE, *[keyed.typed_column(*c) for c in columns])
        rows.write.mode("overwrite").partitionBy("city").parquet(f"{out}/by_city_combined/layout={n}")
    every = keyed.stacked(cleaned)
    if every is not None:
        every.write.mode("overwrite").parquet(f"{out}/combined")
    return cleaned.report


def load_cleaned(spark: SparkSession, out: str) -> DataFrame:
    """The model table: the cleaned files, stacked once.

    City and global stacks hold the same rows again and are not read.
    """
    folders = [f"{out}/by_city/{name}" for name in claims.names(spark, f"{out}/by_city")]
    stacked = files.combine_cities([spark.read.parquet(f) for f in folders])
    return clean.drop_empty_columns(clean.drop_empty_rows(stacked))


MODELS = ("route_optimization", "demand_prediction", "stop_clustering")
RUN_SCHEMA = "model string, status string, reason string, results_file string, records_processed long"


def run_models(
    spark: SparkSession, routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame,
    out: str, wanted: Sequence[str] = MODELS,
) -> tuple[DataFrame, DataFrame]:
    """Run the models, write one result folder each and the run table; returns runs and totals.

    A model without input is skipped, a failing one is reported and the others go on.
    """

    def optimise() -> DataFrame:
        return route_ops.route_recommendations(route_ops.route_features(routes, trips, stop_times, stops))

    def predict() -> DataFrame:
        model = models.fit_demand(demand.hourly_demand(stop_times, trips, routes, stops))
        return models.score_demand(model, stops)

    def cluster() -> DataFrame:
        return models.cluster_members(models.cluster_stops(stops))

    steps = {
        "route_optimization": (optimise, routes, "no_route_data"),
        "demand_prediction": (predict, stop_times, "no_schedule_data"),
        "stop_clustering": (cluster, stops, "no_station_data"),
    }
    runs = []
    for name in wanted:
        step, source, reason = steps[name]
        path = f"{out}/{name}_results"
        if source.isEmpty():
            runs.append((name, "skipped", reason, None, None))
            continue
        try:
            files.write_results(step(), path)
            runs.append((name, "completed", None, path, spark.read.text(path).count()))
        except Exception as error:
            runs.append((name, "failed", str(error).splitlines()[0], None, None))
    table = spark.createDataFrame(runs, RUN_SCHEMA)
    files.write_run_summary(table, f"{out}/runs")
    return table, reports.run_summary(table)
