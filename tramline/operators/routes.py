"""Route features, statistics, agencies and the efficiency score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.expressions import draw
from tramline.functions.quantiles import quantile_lookup
from tramline.operators.joins import route_stop_visits, with_agency
from tramline.session import materialise

FEATURE_COLUMNS = [
    "route_type", "n_trips", "n_stops", "avg_stop_sequence", "max_stop_sequence",
    "lat_range", "lon_range", "avg_lat", "avg_lon",
]


def trips_per_route(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Every route with its number of trips, zero included."""
    counts = trips.groupBy("route_id").agg(F.count("*").alias("n"))
    return routes.join(counts, "route_id", "left").select(
        routes["*"], F.coalesce("n", F.lit(0)).alias("trips_count")
    )


def route_features(
    routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame
) -> DataFrame:
    """Trip counts, stop counts, sequences and extent of each route that has stop times.

    Trips without stop times count as trips.  Positions are taken once per distinct
    stop of the route; a route with no located stop gets zeros.  Stop ids are unique in
    ``stops``, so one pass over the (route, stop) rows yields counts and positions.
    """
    visits = route_stop_visits(stop_times, trips)
    per_route = (
        visits.join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id", "left")
        .groupBy("route_id")
        .agg(
            F.count("*").alias("n_stops"),
            F.try_divide(F.sum("sequence_sum"), F.sum("sequence_count")).alias("avg_stop_sequence"),
            F.max("sequence_max").alias("max_stop_sequence"),
            (F.max("stop_lat") - F.min("stop_lat")).alias("lat_range"),
            (F.max("stop_lon") - F.min("stop_lon")).alias("lon_range"),
            F.avg("stop_lat").alias("avg_lat"),
            F.avg("stop_lon").alias("avg_lon"),
        )
    )
    trip_counts = trips.groupBy("route_id").agg(F.count("*").alias("n_trips"))
    return (
        routes.select("route_id", "route_type")
        .join(trip_counts, "route_id")
        .join(per_route, "route_id")
        .select("route_id", *FEATURE_COLUMNS)
        .fillna(0.0, subset=["lat_range", "lon_range", "avg_lat", "avg_lon"])
    )


def route_stats(routes: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Distinct trips with stop times, distinct stops, and trips per stop.

    Stops are counted from one row per (route, stop), trips by asking which of them have stop
    times: the fan-out of trips to stop times is folded once and never doubled.
    """
    known = trips.select("trip_id", "route_id").join(routes.select("route_id"), "route_id", "left_semi")
    visits = route_stop_visits(stop_times, known)
    n_stops = visits.filter("stop_id is not null").groupBy("route_id").agg(F.count("*").alias("n_stops"))
    running = known.distinct().join(stop_times.select("trip_id"), "trip_id", "left_semi")
    n_trips = running.groupBy("route_id").agg(F.count("*").alias("n_trips"))
    stats = n_trips.join(n_stops, "route_id", "left").fillna(0, subset=["n_stops"])
    return stats.withColumn("efficiency", F.try_divide("n_trips", "n_stops"))


def agency_routes(routes: DataFrame, agency: DataFrame, n: int | None = 15) -> DataFrame:
    """Routes per agency, largest first; routes without an agency are left out."""
    named = with_agency(routes.groupBy("agency_id").agg(F.count("*").alias("rows")), agency)
    counts = (
        named.filter(F.col("agency_name").isNotNull())
        .groupBy("agency_name")
        .agg(F.sum("rows").alias("n_routes"))
    )
    return counts.orderBy(F.desc("n_routes"), "agency_name").limit(n) if n else counts


def agency_sizes(routes: DataFrame, agency: DataFrame) -> DataFrame:
    """How many agencies have a given number of routes."""
    return agency_routes(routes, agency, None).groupBy("n_routes").agg(F.count("*").alias("n_agencies"))


def agency_centroids(
    routes: DataFrame, agency: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame
) -> DataFrame:
    """Mean position of the stops an agency visits, each visit counting once.

    Trips learn their agency first; visits fold to (agency, stop) counts right after the
    trip join.
    """
    named = with_agency(routes.select("route_id", "agency_id"), agency).filter(F.col("agency_name").isNotNull())
    of_trip = trips.select("trip_id", "route_id").join(named, "route_id").select("trip_id", "agency_name")
    per_stop = (
        stop_times.select("trip_id", "stop_id").join(of_trip, "trip_id")
        .groupBy("agency_name", "stop_id")
        .agg(F.count("*").alias("visits"))
    )
    return (
        per_stop.join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id")
        .groupBy("agency_name")
        .agg(
            (F.sum(F.col("stop_lat") * F.col("visits")) / F.sum("visits")).alias("avg_lat"),
            (F.sum(F.col("stop_lon") * F.col("visits")) / F.sum("visits")).alias("avg_lon"),
        )
    )


def _normal_noise(key: str, seed: int) -> Column:
    """Standard normal drawn from the key, so every evaluation sees the same value."""
    first, second = draw(key, seed=seed), draw(key, seed=seed + 1)
    return F.sqrt(-2 * F.log(F.lit(1.0) - first)) * F.cos(second * (2 * math.pi))


def efficiency_score(
    features: DataFrame, noise: bool = False, seed: int = 42, key: str = "route_id"
) -> DataFrame:
    """Weighted size of a route as a z-score (sample deviation); lower is better."""
    raw = F.col("n_stops") * 0.3 + F.col("lat_range") * 0.2 + F.col("lon_range") * 0.2
    if noise:
        raw = raw + _normal_noise(key, seed) * 0.1
    scored = features.withColumn("raw_score", raw)
    stats = scored.agg(
        F.struct(F.avg("raw_score").alias("mean"), F.stddev_samp("raw_score").alias("std"))
    ).scalar()
    return scored.withColumn(
        "efficiency", F.try_divide(F.col("raw_score") - stats["mean"], stats["std"])
    ).drop("raw_score")


def route_flags(features: DataFrame) -> DataFrame:
    """Routes with few stops (merge candidates) and with a wide north-south spread.

    The features are checkpointed: the quantiles read them several times.
    """
    features = materialise(features)
    quantile = quantile_lookup(features, ["n_stops", "lat_range"], [0.25, 0.75])
    return features.withColumns({
        "low_stop_count": F.col("n_stops") < quantile("n_stops", 0.25),
        "wide_spread": F.col("lat_range") > quantile("lat_range", 0.75),
    })


def route_recommendations(features: DataFrame) -> DataFrame:
    """Trips per stop now and with the stop count brought down to the median.

    A route at or below the median keeps its stops.  Wide routes are told to look at
    their shape.
    """
    features = materialise(features)
    quantile = quantile_lookup(features, ["n_stops", "lat_range"], [0.5, 0.75])
    excess = F.greatest(F.col("n_stops") - F.ceil(quantile("n_stops", 0.5)), F.lit(0)).cast("long")
    current = F.try_divide(F.col("n_trips"), F.col("n_stops"))
    optimised = F.try_divide(F.col("n_trips"), F.col("n_stops") - F.col("excess"))
    advice = F.array_compact(F.array(
        F.when(F.col("excess") > 0, F.concat(F.lit("Reduce stops by "), F.col("excess").cast("string"))),
        F.when(F.col("lat_range") > quantile("lat_range", 0.75), "Optimize route shape"),
    ))
    return features.withColumn("excess", excess).select(
        "route_id", current.alias("current_efficiency"), optimised.alias("optimized_efficiency"),
        (optimised - current).alias("improvement"), advice.alias("recommendations"),
    )


def improvement_counts(features: DataFrame) -> DataFrame:
    return route_flags(features).agg(
        F.count_if("low_stop_count").alias("consolidate"), F.count_if("wide_spread").alias("wide")
    )


def optimisation_report(features: DataFrame) -> DataFrame:
    return features.agg(
        F.avg("n_stops").alias("avg_stops"), F.avg("n_trips").alias("avg_trips"),
    )
