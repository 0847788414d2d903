"""Transit roles played by the given tables, as DataFrames and as SQL.

Both forms use the same expressions, so a query and its SQL see the same network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw stations: text positions with blanks, bad values and gaps."""
    k = F.col("s_suppkey")
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        F.when(k % 7 != 0, F.concat(F.lit("Road "), F.col("s_nationkey").cast("string"))).alias("station_address"),
        F.when(k % 41 == 7, "abc").when(k % 41 != 8, F.concat(F.lit(" 5."), (k % 37 + 50).cast("string"), F.lit(" ")))
        .alias("station_latitude"),
        F.concat(F.lit("-0."), (k % 53 + 10).cast("string")).alias("station_longitude"),
        F.when(k % 3 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("gtfs_stop_id"),
        F.col("n_name").alias("gtfs_source"),
        (k % 4 != 0).alias("is_bus_stop"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, " Terminal").when(k % 5 == 1, " Station").when(k % 5 == 2, " old terminal")
    return table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        k.alias("stop_id"),
        F.concat("s_name", F.coalesce(kind, F.lit(""))).alias("stop_name"),
        (F.lit(5.5) + (k % 37) * F.lit(0.01)).alias("stop_lat"),
        (F.lit(-0.3) + (k % 53) * F.lit(0.01)).alias("stop_lon"),
        F.col("n_name").alias("gtfs_source"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").alias("route_id"),
        F.col("c_name").alias("short_name"),
        F.concat_ws(" ", "c_mktsegment", F.lit("line"), "c_name").alias("long_name"),
        (F.col("c_nationkey") % 4).alias("route_type"),
        F.col("c_mktsegment").alias("agency_id"),
        F.col("n_name").alias("source"),
    )


def agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies by segment; one segment has no agency record."""
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").filter(segment != "MACHINERY").select(
        segment.alias("agency_id"), F.concat(F.lit("Agency "), segment).alias("agency_name")
    ).distinct()


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips; some lack a start, some a destination."""
    key, route = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("trip_id"),
        route.alias("route_id"),
        F.nullif(route % 97, F.lit(96)).alias("start_station_id"),
        F.nullif(key % 89, F.lit(88)).alias("destination_id"),
        F.col("o_orderpriority").alias("transport_type"),
    )


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times with text clocks, hours up to 26."""
    hour = F.lpad((F.col("l_partkey") % 27).cast("string"), 2, "0")
    minute = F.lpad(F.col("l_linenumber").cast("string"), 2, "0")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_suppkey").alias("stop_id"),
        F.col("l_linenumber").alias("stop_sequence"),
        F.concat_ws(":", hour, minute, F.lit("00")).alias("arrival_time"),
        F.concat_ws(":", hour, minute, F.lit("30")).alias("departure_time"),
        F.col("l_partkey").alias("row_key"),
    )


def fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_suppkey").alias("start_station_id"),
        (F.col("l_partkey") % 100).alias("end_station_id"),
        F.col("l_extendedprice").alias("fare_amount"),
        F.col("l_returnflag").alias("transport_type"),
    )


def city_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest spread over and around the network."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("area_id"),
        (F.lit(5.45) + (k % 101) * F.lit(0.005)).alias("lat"),
        (F.lit(-0.35) + (k % 113) * F.lit(0.006)).alias("lon"),
    )


SQL = {
    "stations": """
        SELECT s_suppkey AS id, s_name AS name,
               CASE WHEN s_suppkey % 7 <> 0 THEN 'Road ' || s_nationkey END AS station_address,
               CASE WHEN s_suppkey % 41 = 7 THEN 'abc'
                    WHEN s_suppkey % 41 <> 8 THEN ' 5.' || (s_suppkey % 37 + 50) || ' ' END AS station_latitude,
               '-0.' || (s_suppkey % 53 + 10) AS station_longitude,
               CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || s_suppkey END AS gtfs_stop_id,
               n_name AS gtfs_source, s_suppkey % 4 <> 0 AS is_bus_stop
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "stops": """
        SELECT s_suppkey AS stop_id,
               s_name || CASE s_suppkey % 5 WHEN 0 THEN ' Terminal' WHEN 1 THEN ' Station'
                                            WHEN 2 THEN ' old terminal' ELSE '' END AS stop_name,
               5.5::DOUBLE + (s_suppkey % 37) * 0.01::DOUBLE AS stop_lat,
               -0.3::DOUBLE + (s_suppkey % 53) * 0.01::DOUBLE AS stop_lon,
               n_name AS gtfs_source
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "routes": """
        SELECT c_custkey AS route_id, c_name AS short_name, c_mktsegment || ' line ' || c_name AS long_name,
               c_nationkey % 4 AS route_type, c_mktsegment AS agency_id, n_name AS source
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "agency": """
        SELECT DISTINCT c_mktsegment AS agency_id, 'Agency ' || c_mktsegment AS agency_name
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "trips": """
        SELECT o_orderkey AS trip_id, o_custkey AS route_id,
               nullif(o_custkey % 97, 96) AS start_station_id, nullif(o_orderkey % 89, 88) AS destination_id,
               o_orderpriority AS transport_type
        FROM orders""",
    "stop_times": """
        SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_linenumber AS stop_sequence,
               (l_partkey % 27) * 3600 + l_linenumber * 60 AS arrival_s,
               (l_partkey % 27) % 24 AS hour, l_partkey AS row_key
        FROM lineitem""",
    "fares": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS start_station_id,
               l_partkey % 100 AS end_station_id, l_extendedprice AS fare_amount, l_returnflag AS transport_type
        FROM lineitem""",
    "city_areas": """
        SELECT c_custkey AS area_id, 5.45::DOUBLE + (c_custkey % 101) * 0.005::DOUBLE AS lat,
               -0.35::DOUBLE + (c_custkey % 113) * 0.006::DOUBLE AS lon
        FROM customer""",
}

# Derived relations that several checks start from.
SQL["demand"] = """
        SELECT st.stop_id, st.hour, s.stop_lat, s.stop_lon,
               (st.hour BETWEEN 7 AND 9 OR st.hour BETWEEN 17 AND 19) AS is_peak, count(*) AS demand
        FROM stop_times st JOIN trips t ON st.trip_id = t.trip_id
             JOIN routes r ON t.route_id = r.route_id JOIN stops s ON st.stop_id = s.stop_id
        GROUP BY ALL"""
SQL["features"] = """
        SELECT v.route_id, r.route_type, tc.n_trips, v.n_stops, v.avg_stop_sequence, v.max_stop_sequence,
               coalesce(p.lat_range, 0) AS lat_range, coalesce(p.lon_range, 0) AS lon_range,
               coalesce(p.avg_lat, 0) AS avg_lat, coalesce(p.avg_lon, 0) AS avg_lon
        FROM (SELECT t.route_id, count(DISTINCT st.stop_id) AS n_stops,
                     avg(st.stop_sequence) AS avg_stop_sequence, max(st.stop_sequence) AS max_stop_sequence
              FROM stop_times st JOIN trips t ON st.trip_id = t.trip_id GROUP BY 1) v
        JOIN routes r ON r.route_id = v.route_id
        JOIN (SELECT route_id, count(*) AS n_trips FROM trips GROUP BY 1) tc ON tc.route_id = v.route_id
        LEFT JOIN (SELECT route_id, max(stop_lat) - min(stop_lat) AS lat_range,
                          max(stop_lon) - min(stop_lon) AS lon_range,
                          avg(stop_lat) AS avg_lat, avg(stop_lon) AS avg_lon
                   FROM (SELECT DISTINCT t.route_id, s.stop_id, s.stop_lat, s.stop_lon
                         FROM stop_times st JOIN trips t ON st.trip_id = t.trip_id
                              JOIN stops s ON s.stop_id = st.stop_id)
                   GROUP BY 1) p ON p.route_id = v.route_id"""
SQL["trip_ends"] = """
        SELECT t.trip_id, t.route_id, a.stop_name AS start_station, b.stop_name AS end_station,
               a.stop_lat AS start_lat, a.stop_lon AS start_lon, b.stop_lat AS end_lat, b.stop_lon AS end_lon
        FROM trips t JOIN stops a ON a.stop_id = t.start_station_id JOIN stops b ON b.stop_id = t.destination_id"""

NEEDS = {
    "demand": ["stop_times", "trips", "routes", "stops"],
    "features": ["stop_times", "trips", "routes", "stops"],
    "trip_ends": ["trips", "stops"],
}


def with_roles(names: str, body: str, **extra: str) -> str:
    """``body`` with the named roles, what they need, and further relations in front."""
    order: list[str] = []
    for name in names.split():
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in order:
                order.append(needed)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


HAVERSINE = (
    "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1}))"
    " * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return HAVERSINE.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine; adding 0.0 drops the sign of -0.0."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])
