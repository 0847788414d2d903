"""Joins between trips, fares, schedules and stations.

No side is broadcast by hand: Spark broadcasts a station table by its measured
size and falls back to a sort-merge join, which adaptive execution splits where a
key is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.stops import with_source


def _end(stops: DataFrame, key: str, prefix: str, stop_key: str) -> DataFrame:
    return stops.select(
        F.col(stop_key).alias(key),
        F.col("stop_name").alias(f"{prefix}_station"),
        F.col("stop_lat").alias(f"{prefix}_lat"),
        F.col("stop_lon").alias(f"{prefix}_lon"),
    )


def enrich_trips(
    trips: DataFrame, routes: DataFrame, stops: DataFrame,
    stop_key: str = "stop_id", route_key: str = "route_id",
) -> DataFrame:
    """Names and coordinates of both ends, and the source of the route."""
    sources = routes.select(F.col(route_key).alias("route_id"), "source")
    joined = (
        trips.join(_end(stops, "start_station_id", "start", stop_key), "start_station_id")
        .join(_end(stops, "destination_id", "end", stop_key), "destination_id")
        .join(sources, "route_id", "left")
    )
    return with_source(joined)


def enrich_fares(fares: DataFrame, stops: DataFrame, stop_key: str = "stop_id") -> DataFrame:
    """Names and coordinates of both ends; the source is that of the start."""
    start = stops.select(
        F.col(stop_key).alias("start_station_id"),
        F.col("stop_name").alias("start_station"),
        F.col("stop_lat").alias("start_lat"),
        F.col("stop_lon").alias("start_lon"),
        F.col("gtfs_source").alias("source"),
    )
    return fares.join(start, "start_station_id").join(
        _end(stops, "end_station_id", "end", stop_key), "end_station_id"
    )


def schedule(
    stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame
) -> DataFrame:
    """Stop times with their route, agency and stop position; unmatched rows drop out."""
    return (
        stop_times.join(trips.select("trip_id", "route_id"), "trip_id")
        .join(routes.select("route_id", "agency_id"), "route_id")
        .join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id")
    )


def route_stop_visits(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """One row per (route, stop) with visit counts: the fan-out, folded before it grows.

    Everything about stops of a route is computed from this, so a busy route or stop
    crosses later shuffles as a few rows.
    """
    return (
        stop_times.select("trip_id", "stop_id", "stop_sequence")
        .join(trips.select("trip_id", "route_id"), "trip_id")
        .groupBy("route_id", "stop_id")
        .agg(
            F.count("*").alias("visits"),
            F.count("stop_sequence").alias("sequence_count"),
            F.sum("stop_sequence").alias("sequence_sum"),
            F.max("stop_sequence").alias("sequence_max"),
        )
    )


def stop_times_of(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop times whose trip belongs to one of ``routes``."""
    wanted = trips.join(routes.select("route_id"), "route_id", "left_semi").select("trip_id")
    return stop_times.join(wanted, "trip_id", "left_semi")


def stops_of(stops: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stops visited by the given stop times."""
    return stops.join(stop_times.select("stop_id"), "stop_id", "left_semi")


def direct_routes(
    pairs: DataFrame, trips: DataFrame, trip_key: str = "trip_id"
) -> DataFrame:
    """For each (from_id, to_id): a route with a trip from A and a trip to B.

    The two trips need not be the same one.  The first hit wins, that is the lowest
    starting trip, then the lowest ending trip.  Pairs without a direct route keep
    null columns.

    Trips are folded to one row per (station, route) first, and each pair is expanded
    over the end with fewer routes, so a hub never multiplies with a hub.
    """
    starts = (
        trips.filter(F.col("start_station_id").isNotNull() & F.col("route_id").isNotNull())
        .groupBy(F.col("start_station_id").alias("from_id"), "route_id")
        .agg(F.min(trip_key).alias("trip_from"))
    )
    ends = (
        trips.filter(F.col("destination_id").isNotNull() & F.col("route_id").isNotNull())
        .groupBy(F.col("destination_id").alias("to_id"), "route_id")
        .agg(F.min(trip_key).alias("trip_to"))
    )
    asked = (
        pairs.select("from_id", "to_id").distinct()
        .join(starts.groupBy("from_id").agg(F.count("*").alias("out_routes")), "from_id")
        .join(ends.groupBy("to_id").agg(F.count("*").alias("in_routes")), "to_id")
    )
    by_start = asked.filter(F.col("out_routes") <= F.col("in_routes")).join(starts, "from_id")
    by_end = asked.filter(F.col("out_routes") > F.col("in_routes")).join(ends, "to_id")
    hits = by_start.join(ends, ["to_id", "route_id"]).select(
        "from_id", "to_id", "route_id", "trip_from", "trip_to"
    ).unionByName(
        by_end.join(starts, ["from_id", "route_id"]).select(
            "from_id", "to_id", "route_id", "trip_from", "trip_to"
        )
    )
    # A trip has one route, so the lowest starting trip names the hit on its own.
    first = hits.groupBy("from_id", "to_id").agg(
        F.min_by("route_id", "trip_from").alias("route_id"),
        F.min_by("trip_to", "trip_from").alias("trip_to"),
        F.min("trip_from").alias("trip_from"),
    )
    return pairs.join(first, ["from_id", "to_id"], "left").select(
        pairs["*"], "route_id", "trip_from", "trip_to"
    )


def ordering(columns: Sequence[str]) -> Column:
    """Sort key for ``min_by``: a lone number keeps the aggregate hash-based, a struct sorts."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def fare_lookup(
    pairs: DataFrame, fares: DataFrame, order_by: Sequence[str] = ("id",), amount: str = "fare_amount"
) -> DataFrame:
    """First fare (lowest ``order_by``) of each (from_id, to_id); null if there is none."""
    first = fares.groupBy(
        F.col("start_station_id").alias("from_id"), F.col("end_station_id").alias("to_id")
    ).agg(F.min_by(amount, ordering(order_by)).alias("fare_amount"))
    return pairs.join(first, ["from_id", "to_id"], "left")


def with_agency(routes: DataFrame, agency: DataFrame) -> DataFrame:
    return routes.join(agency.select("agency_id", "agency_name"), "agency_id", "left")


def with_stop_names(df: DataFrame, stops: DataFrame) -> DataFrame:
    """Names for the rows of a top-n list; which side is small is for Spark to measure."""
    return df.join(stops.select("stop_id", "stop_name"), "stop_id")


def lookup_endpoints(pairs: DataFrame, stations: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """Exact-name lookup of (origin, destination); a miss is reported, not dropped."""
    index = stations.groupBy(F.col(name)).agg(F.min(key).alias("station"))
    origin = index.select(F.col(name).alias("origin"), F.col("station").alias("from_id"))
    destination = index.select(F.col(name).alias("destination"), F.col("station").alias("to_id"))
    found = F.col("from_id").isNotNull() & F.col("to_id").isNotNull()
    return (
        pairs.join(origin, "origin", "left")
        .join(destination, "destination", "left")
        .withColumn("status", F.when(found, "ok").otherwise("Stations not found"))
    )


def first_per_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """First row of each group as an aggregate, so a huge group is never sorted in one task."""
    row = F.min(F.struct(*order_by, *[c for c in columns if c not in order_by])).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"row.{c}") for c in columns])
