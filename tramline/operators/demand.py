"""Demand by stop and hour, peaks, headways and service grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.expressions import clock_hour, is_clock, is_peak, seconds_of
from tramline.operators.joins import ordering


def hourly_demand(
    stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame,
    arrival: str = "arrival_time",
) -> DataFrame:
    """Visits per stop and arrival hour, as a stand-in for passengers.

    Routes restrict the trips, the smaller table, before stop times are touched.  Visits
    are then counted per (stop, hour) straight after the trip join, so only those counts
    are shuffled again, and positions are added to them last.
    """
    known = trips.select("trip_id", "route_id").join(routes.select("route_id"), "route_id").select("trip_id")
    demand = (
        stop_times.filter(is_clock(arrival))
        .select("trip_id", "stop_id", clock_hour(arrival).alias("hour"))
        .join(known, "trip_id")
        .groupBy("stop_id", "hour")
        .agg(F.count("*").alias("demand"))
    )
    return demand.join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id").select(
        "stop_id", "hour",
        F.lit(0).alias("minute"), F.lit(0).alias("day_of_week"),
        is_peak("hour").alias("is_peak"), "stop_lat", "stop_lon", "demand",
    )


def demand_by_hour(demand: DataFrame) -> DataFrame:
    return demand.groupBy("hour").agg(F.avg("demand").alias("avg_demand"))


def peak_hour(demand: DataFrame) -> DataFrame:
    """The busiest hour; the earlier one on a tie."""
    return demand_by_hour(demand).orderBy(F.desc("avg_demand"), "hour").limit(1)


def peak_split(demand: DataFrame) -> DataFrame:
    return demand.agg(
        F.avg(F.when(F.col("is_peak"), F.col("demand"))).alias("peak_demand"),
        F.avg(F.when(~F.col("is_peak"), F.col("demand"))).alias("off_peak_demand"),
    )


def top_stops(demand: DataFrame, n: int = 10) -> DataFrame:
    """Stops with the highest mean demand; the lower stop id on a tie."""
    means = demand.groupBy("stop_id").agg(F.avg("demand").alias("avg_demand"))
    return means.orderBy(F.desc("avg_demand"), "stop_id").limit(n)


def demand_by_place(demand: DataFrame) -> DataFrame:
    return demand.groupBy("stop_lat", "stop_lon").agg(F.avg("demand").alias("avg_demand"))


def service_by_hour(stop_times: DataFrame, arrival: str = "arrival_time") -> DataFrame:
    hour = clock_hour(arrival).alias("hour")
    return stop_times.filter(is_clock(arrival)).groupBy(hour).agg(F.count("*").alias("n"))


def trip_durations(stop_times: DataFrame, arrival: str = "arrival_time") -> DataFrame:
    """Minutes between the first and last arrival of each trip."""
    seconds = seconds_of(arrival)
    return (
        stop_times.select("trip_id", seconds.alias("arrival_s"))
        .groupBy("trip_id")
        .agg(((F.max("arrival_s") - F.min("arrival_s")) / 60).alias("duration_min"))
    )


def duration_summary(durations: DataFrame) -> DataFrame:
    """Mean, median and longest trip.

    A duration is a difference of two times of day in whole seconds, so there are at
    most a few hundred thousand distinct ones and the median buffer is bounded.
    """
    return durations.agg(
        F.avg("duration_min").alias("mean_min"),
        F.median("duration_min").alias("median_min"),
        F.max("duration_min").alias("max_min"),
    )


def service_hours(stop_times: DataFrame, arrival: str = "arrival_time") -> DataFrame:
    seconds = seconds_of(arrival)
    return stop_times.agg(
        F.min(seconds).alias("first_arrival_s"), F.max(seconds).alias("last_arrival_s")
    )


def headways(
    stop_times: DataFrame, order_by: tuple[str, ...] = ("trip_id",), arrival: str = "arrival_time"
) -> DataFrame:
    """Seconds since the previous arrival at the same stop, null for the first.

    Arrivals are folded to one row per (stop, second) before the window.  A stop then
    has at most one row per second of a service day, however many trips call there.
    Rows in the same second follow each other at distance 0; only the first of them
    (by ``order_by``) carries the gap.
    """
    rows = stop_times.filter(is_clock(arrival)).withColumn("arrival_s", seconds_of(arrival))
    moments = rows.groupBy("stop_id", "arrival_s").agg(F.min(ordering(order_by)).alias("first_row"))
    gap = F.col("arrival_s") - F.lag("arrival_s").over(
        Window.partitionBy("stop_id").orderBy("arrival_s")
    )
    gaps = moments.withColumn("gap_s", gap)
    leads = ordering(order_by) == F.col("first_row")
    return (
        rows.join(gaps, ["stop_id", "arrival_s"])
        .withColumn("headway_s", F.when(leads, F.col("gap_s")).otherwise(0))
        .drop("first_row", "gap_s")
    )


def service_gaps(stop_times: DataFrame, arrival: str = "arrival_time") -> DataFrame:
    """Per stop: calls, mean and longest headway, from the folded arrivals alone."""
    moments = (
        stop_times.filter(is_clock(arrival))
        .select("stop_id", seconds_of(arrival).alias("arrival_s"))
        .groupBy("stop_id", "arrival_s")
        .agg(F.count("*").alias("calls"))
    )
    gap = F.col("arrival_s") - F.lag("arrival_s").over(
        Window.partitionBy("stop_id").orderBy("arrival_s")
    )
    return (
        moments.withColumn("gap_s", gap)
        .groupBy("stop_id")
        .agg(
            F.sum("calls").alias("calls"),
            F.try_divide(F.sum("gap_s"), F.sum("calls") - 1).alias("mean_headway_s"),
            F.max("gap_s").alias("longest_gap_s"),
        )
    )


def event_gaps(events: DataFrame, key: str, time: str, bucket: str = "hour") -> DataFrame:
    """Seconds between consecutive moments of a key on a calendar time line.

    A key may have any number of moments over the years, so none is sorted as a whole:
    gaps are taken inside calendar buckets, and the first moment of a bucket looks back
    to the last one of the bucket before, found among one row per bucket.
    """
    moments = (
        events.select(key, F.col(time).cast("timestamp").alias("moment"))
        .dropna()
        .groupBy(key, "moment").agg(F.count("*").alias("events"))
        .withColumn("bucket", F.date_trunc(bucket, "moment"))
    )
    ends = moments.groupBy(key, "bucket").agg(F.max("moment").alias("last"))
    before = F.lag("last").over(Window.partitionBy(key).orderBy("bucket"))
    inside = F.lag("moment").over(Window.partitionBy(key, "bucket").orderBy("moment"))
    previous = F.coalesce("inside", "before")
    return (
        moments.withColumn("inside", inside)
        .join(ends.withColumn("before", before).drop("last"), [key, "bucket"])
        .select(
            key, "moment", "events",
            ((F.unix_micros("moment") - F.unix_micros(previous)) / 1_000_000).alias("gap_s"),
        )
    )


def frequency_grid(counts: DataFrame, stop: str = "stop_id", hour: str = "hour", n: int = 20) -> DataFrame:
    """Stop x hour grid for the ``n`` busiest stops, absent cells 0.

    ``counts`` holds one row per (stop, hour) with ``visits``.
    """
    totals = counts.groupBy(stop).agg(F.sum("visits").alias("total"))
    busiest = totals.orderBy(F.desc("total"), stop).limit(n).select(stop)
    grid = (
        counts.join(F.broadcast(busiest), stop)
        .groupBy(stop)
        .pivot(hour, list(range(24)))
        .agg(F.sum("visits"))
        .fillna(0)
    )
    return grid.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})
