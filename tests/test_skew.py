"""A third of all rows on one key: joins are split at run time and results stay whole."""

import pytest
from pyspark.sql import functions as F

from tramline.operators import demand, joins, routes

ROWS = 200_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def hot(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    key = F.col("id")
    trips = spark.range(ROWS // 10).select(
        key.alias("trip_id"), F.when(key % 3 == 0, 7).otherwise(key % 900).alias("route_id"),
        F.when(key % 3 == 1, 1).otherwise(key % 50).alias("start_station_id"),
        F.when(key % 3 == 2, 2).otherwise(key % 60).alias("destination_id"))
    calls = spark.range(ROWS).select(
        F.when(key % 3 == 0, 12).otherwise(F.pmod(F.xxhash64(key), F.lit(ROWS // 10))).alias("trip_id"),
        F.when(key % 5 < 2, 3).otherwise(F.pmod(F.hash(key), F.lit(60))).cast("long").alias("stop_id"),
        (key % 9).cast("int").alias("stop_sequence"),
        F.when(key % 3 == 1, "08:00:00").otherwise(F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":15:00"))).alias("arrival_time"))
    lines = spark.range(900).select(key.alias("route_id"), F.lit(3).alias("route_type"), F.lit("g").alias("agency_id"), F.lit("Accra").alias("source"))
    stops = spark.range(60).select(key.alias("stop_id"), F.lit("s").alias("stop_name"), (key * 0.1).alias("stop_lat"), (key * 0.1).alias("stop_lon"))
    yield calls, trips, lines, stops
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def final_plan(df) -> str:
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return execution.executedPlan().toString().split("Initial Plan")[0]


def test_schedule_is_split_and_whole(hot):
    calls, trips, lines, stops = hot
    df = joins.schedule(calls, trips, lines, stops)
    assert "skew=true" in final_plan(df)
    assert df.count() == ROWS


def test_demand_is_split_and_whole(hot):
    calls, trips, lines, stops = hot
    df = demand.hourly_demand(calls, trips, lines, stops)
    assert "skew=true" in final_plan(df)
    assert df.agg(F.sum("demand")).first()[0] == ROWS


def test_route_features_of_a_hot_route(hot):
    calls, trips, lines, stops = hot
    df = routes.route_features(lines, trips, calls, stops)
    assert "skew=true" in final_plan(df)
    visited = {r.trip_id: r.route_id for r in trips.collect()}
    seen = {}
    for r in calls.select("trip_id", "stop_id").distinct().collect():
        seen.setdefault(visited[r.trip_id], set()).add(r.stop_id)
    assert {r.route_id: r.n_stops for r in df.collect()} == {k: len(v) for k, v in seen.items()}


def test_headways_of_a_hot_second(hot):
    calls, *_ = hot
    df = demand.headways(calls.withColumn("row", F.monotonically_increasing_id()), ("trip_id", "stop_sequence", "row"))
    rows = df.groupBy("stop_id").agg(F.count("*").alias("n"), F.count_if(F.col("headway_s").isNull()).alias("firsts"), F.sum("headway_s").alias("span"))
    limits = {r.stop_id: r for r in demand.service_gaps(calls).collect()}
    for r in rows.collect():
        assert (r.n, r.firsts) == (limits[r.stop_id].calls, 1)
        assert r.span == round((limits[r.stop_id].mean_headway_s or 0) * (r.n - 1))


def test_direct_routes_between_hubs(hot):
    calls, trips, *_ = hot
    pairs = trips.select(F.col("start_station_id").alias("from_id"), F.col("destination_id").alias("to_id")).distinct()
    found = {(r.from_id, r.to_id): (r.route_id, r.trip_from, r.trip_to) for r in joins.direct_routes(pairs, trips).collect()}
    starts, ends = {}, {}
    for t in trips.collect():
        starts.setdefault((t.start_station_id, t.route_id), t.trip_id)
        ends.setdefault((t.destination_id, t.route_id), t.trip_id)
    for (a, b), hit in found.items():
        both = [(starts[(a, r)], ends[(b, r)], r) for s, r in starts if s == a and (b, r) in ends]
        first = min(both)
        assert hit == (first[2], first[0], first[1])
