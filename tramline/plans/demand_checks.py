"""Demand, routes, agencies, headways."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import demand as demand_ops, joins, profile, routes as route_ops
from tramline.functions.expressions import hour_of, seconds_of
from tramline.plans import roles
from tramline.plans.registry import query
from tramline.plans.roles import rounded, table, with_roles
from tramline.session import new_folder
from tramline.sources import files


def demand(spark, d):
    return demand_ops.hourly_demand(
        roles.stop_times(spark, d), roles.trips(spark, d), roles.routes(spark, d), roles.stops(spark, d)
    )


def features(spark, d):
    return route_ops.route_features(
        roles.routes(spark, d), roles.trips(spark, d), roles.stop_times(spark, d), roles.stops(spark, d)
    )


@query("d3_hourly_demand", with_roles("demand", """
    SELECT stop_id, hour::INTEGER AS hour, 0 AS minute, 0 AS day_of_week, is_peak, stop_lat, stop_lon, demand FROM demand"""))
def hourly_demand(spark, d):
    return demand(spark, d)


@query("d3_event_demand", """
    SELECT user_id, hour(ts)::INTEGER AS hour, count(*) AS demand FROM events GROUP BY 1, 2""")
def event_demand(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(
        F.count("*").alias("demand")
    )


@query("d4_demand_by_hour", with_roles("demand", """
    SELECT hour::INTEGER AS hour, round(avg(demand), 6) AS avg_demand FROM demand GROUP BY 1"""))
def demand_by_hour(spark, d):
    return rounded(demand_ops.demand_by_hour(demand(spark, d)))


@query("d4_peak_hour", with_roles("demand", """
    SELECT hour::INTEGER AS hour, round(avg(demand), 6) AS avg_demand FROM demand GROUP BY 1
    ORDER BY avg(demand) DESC, 1 LIMIT 1"""))
def peak_hour(spark, d):
    return rounded(demand_ops.peak_hour(demand(spark, d)))


@query("d5_peak_split", with_roles("demand", """
    SELECT round(avg(demand) FILTER (is_peak), 6) AS peak_demand,
           round(avg(demand) FILTER (NOT is_peak), 6) AS off_peak_demand FROM demand"""))
def peak_split(spark, d):
    return rounded(demand_ops.peak_split(demand(spark, d)))


@query("f2_top_stops", with_roles("demand", """
    SELECT stop_id, round(avg(demand), 6) AS avg_demand FROM demand GROUP BY 1
    ORDER BY avg(demand) DESC, stop_id LIMIT 10"""))
def top_stops(spark, d):
    return rounded(demand_ops.top_stops(demand(spark, d)))


@query("c11_top_stop_names", with_roles("demand", """
    SELECT stop_id, stop_name, avg_demand FROM (
        SELECT stop_id, round(avg(demand), 6) AS avg_demand FROM demand GROUP BY 1
        ORDER BY avg(demand) DESC, stop_id LIMIT 10) JOIN stops USING (stop_id)"""))
def top_stop_names(spark, d):
    top = demand_ops.top_stops(demand(spark, d))
    return rounded(joins.with_stop_names(top, roles.stops(spark, d)).select("stop_id", "stop_name", "avg_demand"))


@query("d26_demand_by_place", with_roles("demand", """
    SELECT round(stop_lat, 9) AS stop_lat, round(stop_lon, 9) AS stop_lon, round(avg(demand), 9) AS avg_demand
    FROM demand GROUP BY demand.stop_lat, demand.stop_lon"""))
def demand_by_place(spark, d):
    return rounded(demand_ops.demand_by_place(demand(spark, d)), 9)


@query("h2_clock_times", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_linenumber < 6 THEN ((l_partkey % 30) * 3600 + l_linenumber * 60 + l_suppkey % 60)::INTEGER END AS seconds,
           CASE WHEN l_linenumber < 6 THEN ((l_partkey % 30) % 24)::INTEGER END AS hour
    FROM lineitem""")
def clock_times(spark, d):
    """Texts with hours past 24, blanks around, and clocks that are none."""
    clock = F.concat_ws(
        ":", (F.col("l_partkey") % 30).cast("string"), F.col("l_linenumber").cast("string"),
        (F.col("l_suppkey") % 60).cast("string"),
    )
    line = F.col("l_linenumber")
    text = F.when(line < 6, F.concat(F.lit(" "), clock, F.lit(" "))).when(line == 6, "12:61:00").otherwise("noon")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", seconds_of(text).alias("seconds"),
        hour_of(seconds_of(text)).alias("hour"),
    )


@query("d6_route_features", with_roles("features", """
    SELECT route_id, route_type, n_trips, n_stops, round(avg_stop_sequence, 9) AS avg_stop_sequence,
           max_stop_sequence, round(lat_range, 9) AS lat_range, round(lon_range, 9) AS lon_range,
           round(avg_lat, 9) AS avg_lat, round(avg_lon, 9) AS avg_lon FROM features"""))
def route_features(spark, d):
    return rounded(features(spark, d), 9)


@query("d7_route_stats", with_roles("stop_times trips routes", """
    SELECT route_id, count(DISTINCT trip_id) AS n_trips, count(DISTINCT stop_id) AS n_stops,
           round(count(DISTINCT trip_id) / count(DISTINCT stop_id), 6) AS efficiency
    FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id) GROUP BY 1"""))
def route_stats(spark, d):
    return rounded(route_ops.route_stats(
        roles.routes(spark, d), roles.trips(spark, d), roles.stop_times(spark, d)
    ))


@query("d8_trips_per_route", with_roles("routes", """
    SELECT route_id, short_name, count(trip_id) AS trips_count
    FROM routes LEFT JOIN (SELECT o_orderkey AS trip_id, o_custkey * 2 AS route_id FROM orders) USING (route_id)
    GROUP BY 1, 2"""))
def trips_per_route(spark, d):
    """Only every other route number has trips here, so zeros occur."""
    trips = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("route_id"))
    return route_ops.trips_per_route(roles.routes(spark, d), trips).select("route_id", "short_name", "trips_count")


AGENCY_ROUTES = """
    SELECT agency_name, count(*) AS n_routes FROM routes JOIN agency USING (agency_id) GROUP BY 1"""


@query("d9_agency_routes", with_roles("routes agency", AGENCY_ROUTES + " ORDER BY n_routes DESC, agency_name LIMIT 15"))
def agency_routes(spark, d):
    return route_ops.agency_routes(roles.routes(spark, d), roles.agency(spark, d), 15)


@query("d9_agency_sizes", with_roles("routes agency", f"""
    SELECT n_routes, count(*) AS n_agencies FROM ({AGENCY_ROUTES}) GROUP BY 1"""))
def agency_sizes(spark, d):
    return route_ops.agency_sizes(roles.routes(spark, d), roles.agency(spark, d))


@query("d10_agency_centroids", with_roles("stop_times trips routes agency stops", """
    SELECT agency_name, round(avg(stop_lat), 6) AS avg_lat, round(avg(stop_lon), 6) AS avg_lon
    FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id) JOIN agency USING (agency_id)
         JOIN stops USING (stop_id) GROUP BY 1"""))
def agency_centroids(spark, d):
    return rounded(route_ops.agency_centroids(
        roles.routes(spark, d), roles.agency(spark, d), roles.trips(spark, d), roles.stop_times(spark, d),
        roles.stops(spark, d),
    ))


DURATIONS = "SELECT trip_id, (max(arrival_s) - min(arrival_s)) / 60 AS duration_min FROM stop_times GROUP BY 1"


@query("d11_trip_durations", with_roles("stop_times", "SELECT trip_id, round(duration_min, 6) AS duration_min FROM d", d=DURATIONS))
def trip_durations(spark, d):
    return rounded(demand_ops.trip_durations(roles.stop_times(spark, d)))


@query("d11_duration_summary", with_roles("stop_times", """
    SELECT round(avg(duration_min), 6) AS mean_min, round(quantile_cont(duration_min, 0.5), 6) AS median_min,
           round(max(duration_min), 6) AS max_min FROM d""", d=DURATIONS))
def duration_summary(spark, d):
    return rounded(demand_ops.duration_summary(demand_ops.trip_durations(roles.stop_times(spark, d))))


@query("d12_service_hours", with_roles("stop_times", """
    SELECT min(arrival_s)::INTEGER AS first_arrival_s, max(arrival_s)::INTEGER AS last_arrival_s FROM stop_times"""))
def service_hours(spark, d):
    return demand_ops.service_hours(roles.stop_times(spark, d))


@query("d13_service_by_hour", with_roles("stop_times", """
    SELECT hour::INTEGER AS hour, count(*) AS n FROM stop_times GROUP BY 1"""))
def service_by_hour(spark, d):
    return demand_ops.service_by_hour(roles.stop_times(spark, d))


GRID = ", ".join(f"coalesce(sum(visits) FILTER (hour = {h}), 0)::BIGINT AS h{h:02d}" for h in range(24))


@query("d23_frequency_grid", f"""
    WITH c AS (SELECT user_id, hour(ts) AS hour, count(*) AS visits FROM events GROUP BY 1, 2),
         busiest AS (SELECT user_id FROM c GROUP BY 1 ORDER BY sum(visits) DESC, user_id LIMIT 20)
    SELECT user_id, {GRID} FROM c JOIN busiest USING (user_id) GROUP BY 1""")
def frequency_grid(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(
        F.count("*").alias("visits")
    )
    return demand_ops.frequency_grid(counts, "user_id", "hour")


@query("f3_busiest_stops", with_roles("stop_times", """
    SELECT stop_id, count(*) AS n FROM stop_times GROUP BY 1 ORDER BY n DESC, stop_id LIMIT 20"""))
def busiest_stops(spark, d):
    counts = roles.stop_times(spark, d).groupBy("stop_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "stop_id").limit(20)


@query("d25_route_flags", with_roles("features", """
    SELECT route_id, n_stops < (SELECT quantile_cont(n_stops, 0.25) FROM features) AS low_stop_count,
           lat_range > (SELECT quantile_cont(lat_range, 0.75) FROM features) AS wide_spread FROM features"""))
def route_flags(spark, d):
    return route_ops.route_flags(features(spark, d)).select("route_id", "low_stop_count", "wide_spread")


@query("d25_improvement_counts", with_roles("features", """
    SELECT count(*) FILTER (n_stops < (SELECT quantile_cont(n_stops, 0.25) FROM features)) AS consolidate,
           count(*) FILTER (lat_range > (SELECT quantile_cont(lat_range, 0.75) FROM features)) AS wide FROM features"""))
def improvement_counts(spark, d):
    return route_ops.improvement_counts(features(spark, d))


@query("a8_route_results", with_roles("features", """
    SELECT route_id, round(n_trips / n_stops, 6) AS current_efficiency,
           round(n_trips / (n_stops - excess), 6) AS optimized_efficiency,
           round(n_trips / (n_stops - excess) - n_trips / n_stops, 6) + 0.0::DOUBLE AS improvement,
           concat_ws('; ', CASE WHEN excess > 0 THEN 'Reduce stops by ' || excess END,
                     CASE WHEN lat_range > wide THEN 'Optimize route shape' END) AS advice
    FROM (SELECT *, greatest(n_stops - ceil((SELECT quantile_cont(n_stops, 0.5) FROM features)), 0)::BIGINT AS excess,
                 (SELECT quantile_cont(lat_range, 0.75) FROM features) AS wide FROM features)"""))
def route_results(spark, d):
    """Route results written as JSON records and read back."""
    path = new_folder(spark, "route-results")
    files.write_results(route_ops.route_recommendations(features(spark, d)), path)
    back = spark.read.schema(
        "route_id bigint, current_efficiency double, optimized_efficiency double, improvement double, "
        "recommendations array<string>"
    ).json(path)
    return rounded(back.withColumn("advice", F.concat_ws("; ", "recommendations")).drop("recommendations"))


@query("d25_optimisation_report", with_roles("features", """
    SELECT round(avg(n_stops), 6) AS avg_stops, round(avg(n_trips), 6) AS avg_trips FROM features"""))
def optimisation_report(spark, d):
    return rounded(route_ops.optimisation_report(features(spark, d)))


@query("m8_efficiency_score", with_roles("features", """
    SELECT route_id, round((raw - avg(raw) OVER ()) / stddev_samp(raw) OVER (), 6) AS efficiency
    FROM (SELECT route_id, n_stops * 0.3::DOUBLE + lat_range * 0.2::DOUBLE + lon_range * 0.2::DOUBLE AS raw FROM features)"""))
def efficiency_score(spark, d):
    return rounded(route_ops.efficiency_score(features(spark, d)).select("route_id", "efficiency"))


@query("e1_first_trip_per_route", """
    SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_trip_per_route(spark, d):
    return joins.first_per_group(
        table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"]
    )


@query("e2_headways", with_roles("stop_times", """
    SELECT trip_id, stop_id, stop_sequence, row_key,
           (arrival_s - lag(arrival_s) OVER (PARTITION BY stop_id ORDER BY arrival_s, trip_id, stop_sequence, row_key))::INTEGER
               AS headway_s
    FROM stop_times"""))
def headways(spark, d):
    return demand_ops.headways(roles.stop_times(spark, d), ("trip_id", "stop_sequence", "row_key")).select(
        "trip_id", "stop_id", "stop_sequence", "row_key", "headway_s"
    )


@query("e2_service_gaps", with_roles("stop_times", """
    SELECT stop_id, count(*) AS calls, round(avg(gap), 6) AS mean_headway_s, max(gap)::INTEGER AS longest_gap_s
    FROM (SELECT stop_id, arrival_s - lag(arrival_s) OVER (PARTITION BY stop_id ORDER BY arrival_s) AS gap
          FROM stop_times) GROUP BY 1"""))
def service_gaps(spark, d):
    return rounded(demand_ops.service_gaps(roles.stop_times(spark, d)))


@query("e2_event_gaps", """
    SELECT user_id, epoch_us(ts) AS moment, events, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (
               PARTITION BY user_id ORDER BY ts)) / 1000000, 6) AS gap_s
    FROM (SELECT user_id, ts, count(*) AS events FROM events GROUP BY 1, 2)""")
def event_gaps(spark, d):
    gaps = demand_ops.event_gaps(table(spark, d, "events"), "user_id", "ts")
    return rounded(gaps.withColumn("moment", F.unix_micros("moment")))


@query("d1_table_counts", with_roles("stops routes trips stop_times fares", """
    SELECT 'routes' AS "table", count(*) AS rows FROM routes UNION ALL SELECT 'stops', count(*) FROM stops
    UNION ALL SELECT 'trips', count(*) FROM trips UNION ALL SELECT 'stop_times', count(*) FROM stop_times
    UNION ALL SELECT 'fares', count(*) FROM fares"""))
def table_counts(spark, d):
    return profile.table_counts({
        "routes": roles.routes(spark, d), "stops": roles.stops(spark, d), "trips": roles.trips(spark, d),
        "stop_times": roles.stop_times(spark, d), "fares": roles.fares(spark, d),
    })
