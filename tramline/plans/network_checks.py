"""Stations, routes, trips, fares: filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import geo, joins, profile, stops as stop_ops
from tramline.operators.stops import Network
from tramline.plans import roles
from tramline.plans.registry import query
from tramline.plans.roles import haversine_sql, rounded, table, with_roles

CITY = "NATION_3"


def network(spark, d) -> Network:
    return Network(
        stations=roles.stations(spark, d),
        routes=roles.routes(spark, d).withColumnRenamed("route_id", "id"),
        trips=roles.trips(spark, d),
        fares=roles.fares(spark, d),
    )


@query("b1_city_network", with_roles("stations routes trips fares", f"""
    SELECT 'stations' AS "table", count(*) AS rows FROM stations WHERE gtfs_source = '{CITY}'
    UNION ALL SELECT 'routes', count(*) FROM routes WHERE source = '{CITY}'
    UNION ALL SELECT 'trips', count(*) FROM trips WHERE route_id IN (SELECT route_id FROM routes WHERE source = '{CITY}')
    UNION ALL SELECT 'fares', count(*) FROM fares
        WHERE start_station_id IN (SELECT id FROM stations WHERE gtfs_source = '{CITY}')
          AND end_station_id IN (SELECT id FROM stations WHERE gtfs_source = '{CITY}')"""))
def city_network(spark, d):
    scoped = stop_ops.filter_city(network(spark, d), CITY.lower(), ignore_case=True)
    return profile.table_counts({
        "stations": scoped.stations, "routes": scoped.routes, "trips": scoped.trips, "fares": scoped.fares,
    })


FARE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("c7_city_fares_by_start", with_roles("stations fares", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, fare_amount FROM fares
    WHERE start_station_id IN (SELECT id FROM stations WHERE gtfs_source = '{CITY}')"""))
def city_fares_by_start(spark, d):
    scoped = stop_ops.filter_city(network(spark, d), CITY, ends="start")
    return scoped.fares.select(*FARE_KEY, "fare_amount")


@query("b2_normalised_stops", with_roles("stations", """
    SELECT * FROM (
        SELECT coalesce(gtfs_stop_id, id::VARCHAR) AS stop_id, name AS stop_name,
               try_cast(trim(station_latitude) AS DOUBLE) AS stop_lat,
               try_cast(trim(station_longitude) AS DOUBLE) AS stop_lon FROM stations)
    WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL"""))
def normalised_stops(spark, d):
    return stop_ops.normalise_stops(roles.stations(spark, d)).select("stop_id", "stop_name", "stop_lat", "stop_lon")


@query("b3_renamed_routes", with_roles("routes", """
    SELECT route_id, short_name AS route_short_name, long_name AS route_long_name, route_type FROM routes"""))
def renamed_routes(spark, d):
    return stop_ops.rename_routes(roles.routes(spark, d)).select(
        "route_id", "route_short_name", "route_long_name", "route_type"
    )


@query("b4_bus_stops", with_roles("stations", "SELECT id, name FROM stations WHERE is_bus_stop"))
def bus_stops(spark, d):
    return stop_ops.bus_stops(roles.stations(spark, d)).select("id", "name")


@query("b5_station_search", """
    SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE '%RING%'
    ORDER BY p_name, p_partkey LIMIT 20""")
def station_search(spark, d):
    return stop_ops.search_text(
        table(spark, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "RING",
        ["p_name", "p_partkey"],
    )


@query("b6_trips_with_both_ends", with_roles("trips", """
    SELECT trip_id, start_station_id, destination_id FROM trips
    WHERE start_station_id IS NOT NULL AND destination_id IS NOT NULL"""))
def trips_with_both_ends(spark, d):
    return stop_ops.require_endpoints(
        roles.trips(spark, d).select("trip_id", "start_station_id", "destination_id"),
        ["start_station_id", "destination_id"],
    )


@query("b7_peak_flag", """
    SELECT event_id, hour(ts)::INTEGER AS hour, hour(ts) IN (7, 8, 9, 17, 18, 19) AS is_peak FROM events""")
def peak_flag(spark, d):
    return stop_ops.with_peak_flag(
        table(spark, d, "events").select("event_id", F.hour("ts").alias("hour")), "hour"
    )


@query("b8_stop_types", with_roles("stops", """
    SELECT stop_id, CASE WHEN contains(stop_name, 'Terminal') THEN 'Terminal'
                         WHEN contains(stop_name, 'Station') THEN 'Station' ELSE 'Regular' END AS stop_type,
           contains(lower(stop_name), 'terminal') AS is_terminal FROM stops"""))
def stop_types(spark, d):
    return stop_ops.with_stop_type(roles.stops(spark, d), "stop_name").select("stop_id", "stop_type", "is_terminal")


@query("b8_terminal_counts", with_roles("stops", """
    SELECT count(*) FILTER (contains(lower(stop_name), 'terminal')) AS terminal_stops,
           count(*) FILTER (NOT contains(lower(stop_name), 'terminal')) AS regular_stops FROM stops"""))
def terminal_counts(spark, d):
    return stop_ops.terminal_counts(roles.stops(spark, d), "stop_name")


@query("b9_route_name_patterns", """
    SELECT count(*) FILTER (regexp_full_match(name, '[A-Z0-9]+')) AS alphanumeric,
           count(*) FILTER (regexp_full_match(name, '[A-Z]+')) AS letters
    FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'R' || c_custkey WHEN 1 THEN c_mktsegment
                                    WHEN 2 THEN c_name END AS name FROM customer)""")
def route_name_patterns(spark, d):
    k = F.col("c_custkey")
    named = table(spark, d, "customer").select(
        F.when(k % 4 == 0, F.concat(F.lit("R"), k.cast("string"))).when(k % 4 == 1, F.col("c_mktsegment"))
        .when(k % 4 == 2, F.col("c_name")).alias("name")
    )
    return stop_ops.name_pattern_counts(named, "name")


def trips_with_gaps(spark, d):
    """Trips of which some have no route."""
    route = F.col("route_id")
    return roles.trips(spark, d).withColumn("route_id", F.when(route % 50 != 7, route))


@query("c1_trips_enriched", with_roles("trip_ends routes", """
    SELECT e.trip_id, start_station, end_station, start_lat, start_lon, end_lat, end_lon,
           coalesce(r.source, 'unknown') AS source
    FROM trip_ends e LEFT JOIN routes r ON r.route_id = CASE WHEN e.route_id % 50 <> 7 THEN e.route_id END"""))
def trips_enriched(spark, d):
    return joins.enrich_trips(trips_with_gaps(spark, d), roles.routes(spark, d), roles.stops(spark, d)).select(
        "trip_id", "start_station", "end_station", "start_lat", "start_lon", "end_lat", "end_lon", "source"
    )


@query("b10_trips_by_source", with_roles("trips routes", """
    SELECT coalesce(r.source, 'unknown') AS source, count(*) AS n
    FROM trips t LEFT JOIN routes r ON r.route_id = CASE WHEN t.route_id % 50 <> 7 THEN t.route_id END GROUP BY 1"""))
def trips_by_source(spark, d):
    sources = roles.routes(spark, d).select("route_id", "source")
    trips = trips_with_gaps(spark, d).select("route_id").groupBy("route_id").agg(F.count("*").alias("n"))
    return stop_ops.with_source(trips.join(sources, "route_id", "left")).groupBy("source").agg(
        F.sum("n").alias("n")
    )


@query("c2_fares_enriched", with_roles("fares stops", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a.stop_name AS start_station, b.stop_name AS end_station,
           a.stop_lat AS start_lat, b.stop_lon AS end_lon, a.gtfs_source AS source, fare_amount
    FROM fares f JOIN stops a ON a.stop_id = f.start_station_id JOIN stops b ON b.stop_id = f.end_station_id"""))
def fares_enriched(spark, d):
    return joins.enrich_fares(roles.fares(spark, d), roles.stops(spark, d)).select(
        *FARE_KEY, "start_station", "end_station", "start_lat", "end_lon", "source", "fare_amount"
    )


@query("c3_schedule", with_roles("stop_times trips routes stops", """
    SELECT st.trip_id, st.stop_id, st.stop_sequence, st.row_key, r.route_id, r.agency_id, s.stop_lat, s.stop_lon
    FROM stop_times st JOIN trips t ON t.trip_id = st.trip_id JOIN routes r ON r.route_id = t.route_id
         JOIN stops s ON s.stop_id = st.stop_id"""))
def schedule(spark, d):
    return joins.schedule(
        roles.stop_times(spark, d), roles.trips(spark, d), roles.routes(spark, d), roles.stops(spark, d)
    ).select("trip_id", "stop_id", "stop_sequence", "row_key", "route_id", "agency_id", "stop_lat", "stop_lon")


@query("c4_stop_times_of_agency", with_roles("stop_times trips routes", """
    SELECT trip_id, stop_id, stop_sequence, row_key FROM stop_times
    WHERE trip_id IN (SELECT trip_id FROM trips JOIN routes USING (route_id) WHERE agency_id = 'BUILDING')"""))
def stop_times_of_agency(spark, d):
    routes = roles.routes(spark, d).filter(F.col("agency_id") == "BUILDING")
    return joins.stop_times_of(roles.stop_times(spark, d), roles.trips(spark, d), routes).select(
        "trip_id", "stop_id", "stop_sequence", "row_key"
    )


@query("c4_stops_of_agency", with_roles("stop_times trips routes stops", """
    SELECT stop_id, stop_name FROM stops WHERE stop_id IN (
        SELECT stop_id FROM stop_times JOIN trips USING (trip_id) JOIN routes USING (route_id)
        WHERE agency_id = 'BUILDING')"""))
def stops_of_agency(spark, d):
    routes = roles.routes(spark, d).filter(F.col("agency_id") == "BUILDING")
    visited = joins.stop_times_of(roles.stop_times(spark, d), roles.trips(spark, d), routes)
    return joins.stops_of(roles.stops(spark, d), visited).select("stop_id", "stop_name")


def asked_pairs(spark, d):
    """Every station pair that has a fare."""
    return roles.fares(spark, d).select(
        F.col("start_station_id").alias("from_id"), F.col("end_station_id").alias("to_id")
    ).distinct()


PAIRS = "SELECT DISTINCT start_station_id AS from_id, end_station_id AS to_id FROM fares"


@query("c5_direct_routes", with_roles("fares trips", """
    SELECT from_id, to_id, hit.r AS route_id, hit.a AS trip_from, hit.b AS trip_to
    FROM pairs LEFT JOIN (
        SELECT x.start_station_id AS from_id, y.destination_id AS to_id,
               min({'a': x.trip_id, 'b': y.trip_id, 'r': x.route_id}) AS hit
        FROM trips x JOIN trips y ON x.route_id = y.route_id
        WHERE x.start_station_id IS NOT NULL AND y.destination_id IS NOT NULL GROUP BY 1, 2)
    USING (from_id, to_id)""", pairs=PAIRS))
def direct_routes(spark, d):
    return joins.direct_routes(asked_pairs(spark, d), roles.trips(spark, d))


@query("c6_fare_lookup", with_roles("fares trips", """
    SELECT from_id, to_id, fare_amount FROM pairs LEFT JOIN (
        SELECT start_station_id AS from_id, end_station_id AS to_id, fare_amount FROM fares
        QUALIFY row_number() OVER (PARTITION BY start_station_id, end_station_id
                                   ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1)
    USING (from_id, to_id)""", pairs="""
    SELECT DISTINCT start_station_id AS from_id, destination_id AS to_id FROM trips
    WHERE start_station_id IS NOT NULL AND destination_id IS NOT NULL"""))
def fare_lookup(spark, d):
    pairs = roles.trips(spark, d).dropna(subset=["start_station_id", "destination_id"]).select(
        F.col("start_station_id").alias("from_id"), F.col("destination_id").alias("to_id")
    ).distinct()
    return joins.fare_lookup(pairs, roles.fares(spark, d), FARE_KEY)


@query("c8_routes_with_agency", with_roles("routes agency", """
    SELECT route_id, routes.agency_id, agency_name FROM routes LEFT JOIN agency ON routes.agency_id = agency.agency_id"""))
def routes_with_agency(spark, d):
    return joins.with_agency(roles.routes(spark, d), roles.agency(spark, d)).select(
        "route_id", "agency_id", "agency_name"
    )


@query("c9_route_stop_visits", with_roles("stop_times trips", """
    SELECT route_id, stop_id, count(*) AS visits, max(stop_sequence) AS sequence_max
    FROM stop_times JOIN trips USING (trip_id) GROUP BY 1, 2"""))
def route_stop_visits(spark, d):
    return joins.route_stop_visits(roles.stop_times(spark, d), roles.trips(spark, d)).select(
        "route_id", "stop_id", "visits", "sequence_max"
    )


@query("c14_near_stops", with_roles("city_areas stops", f"""
    SELECT area_id, count(*) AS n_near, min({{'m': round(m, 3), 's': stop_id}}).s AS nearest_stop,
           min(round(m, 3)) AS nearest_m
    FROM (SELECT area_id, stop_id, {haversine_sql('lat', 'lon', 'stop_lat', 'stop_lon')} AS m FROM city_areas, stops)
    WHERE m <= 2000 GROUP BY 1"""))
def near_stops(spark, d):
    found = geo.near_stops(roles.city_areas(spark, d), roles.stops(spark, d), 2000)
    return found.select("area_id", "n_near", "nearest_stop", "nearest_m")


@query("c14_near_duplicates", with_roles("stops", f"""
    SELECT a.stop_id, count(*) AS n_near FROM stops a JOIN stops b ON a.stop_id <> b.stop_id
    WHERE {haversine_sql('a.stop_lat', 'a.stop_lon', 'b.stop_lat', 'b.stop_lon')} <= 1700 GROUP BY 1"""))
def near_duplicates(spark, d):
    return geo.near_duplicates(roles.stops(spark, d), 1700).select("stop_id", "n_near")


@query("c14_coverage_gaps", with_roles("city_areas stops", f"""
    SELECT area_id, lat, lon FROM city_areas WHERE NOT EXISTS (
        SELECT 1 FROM stops WHERE {haversine_sql('lat', 'lon', 'stop_lat', 'stop_lon')} <= 1500)"""))
def coverage_gaps(spark, d):
    return geo.coverage_gaps(roles.city_areas(spark, d), roles.stops(spark, d), 1500)


@query("c15_trip_lengths", with_roles("trip_ends", f"""
    SELECT trip_id, round({haversine_sql('start_lat', 'start_lon', 'end_lat', 'end_lon')}, 4) AS length_m FROM trip_ends"""))
def trip_lengths(spark, d):
    ends = joins.enrich_trips(roles.trips(spark, d), roles.routes(spark, d), roles.stops(spark, d))
    return rounded(geo.with_length(ends).select("trip_id", "length_m"), 4)


@query("c16_exact_name_lookup", """
    WITH asked AS (
        SELECT o_orderkey, 'Supplier#' || lpad((o_custkey % 120)::VARCHAR, 9, '0') AS origin,
               'Supplier#' || lpad((o_orderkey % 130)::VARCHAR, 9, '0') AS destination FROM orders)
    SELECT o_orderkey, a.s_suppkey AS from_id, b.s_suppkey AS to_id,
           CASE WHEN a.s_suppkey IS NULL OR b.s_suppkey IS NULL THEN 'Stations not found' ELSE 'ok' END AS status
    FROM asked LEFT JOIN supplier a ON a.s_name = origin LEFT JOIN supplier b ON b.s_name = destination""")
def exact_name_lookup(spark, d):
    def named(key, n):
        return F.concat(F.lit("Supplier#"), F.lpad((F.col(key) % n).cast("string"), 9, "0"))

    asked = table(spark, d, "orders").select(
        "o_orderkey", named("o_custkey", 120).alias("origin"), named("o_orderkey", 130).alias("destination")
    )
    return joins.lookup_endpoints(asked, table(spark, d, "supplier"), "s_name", "s_suppkey").select(
        "o_orderkey", "from_id", "to_id", "status"
    )
