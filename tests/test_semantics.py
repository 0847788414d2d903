"""Small hand-made frames, one rule each."""

import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tramline.functions import expressions as X
from tramline.operators import corpus, demand, joins, profile, reports, routes, setops, stops
from tramline.operators.match import parse_od


def one(df):
    return df.collect()[0]


def column(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


# --- clocks, peaks, names ---------------------------------------------------

@pytest.mark.parametrize("text, seconds", [
    ("07:30:15", 27015), ("7:5:3", 25503), ("25:10:00", 90600), (" 06:00:00 ", 21600), ("00:00:00", 0),
    ("12:60:00", None), ("12:00:60", None), ("noon", None), ("12:00", None), ("1:2:3:4", None), ("", None),
    (None, None), ("-1:00:00", None),
])
def test_clock(spark, text, seconds):
    row = one(spark.createDataFrame([(text,)], "t string").select(
        X.seconds_of("t").alias("s"), X.clock_hour("t").alias("h"), X.hour_of(X.seconds_of("t")).alias("h2")))
    assert row.s == seconds
    assert row.h == row.h2 == (None if seconds is None else seconds // 3600 % 24)


def test_peak_hours(spark):
    hours = spark.createDataFrame([(h,) for h in range(24)], "hour int")
    flagged = stops.with_peak_flag(hours, "hour").filter("is_peak")
    assert column(flagged, "hour", "hour") == [7, 8, 9, 17, 18, 19]


def test_stop_types(spark):
    names = ["Circle Terminal", "old terminal", "Tema Station", "Terminal Station", None]
    df = stops.with_stop_type(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string"), "n")
    assert column(df, "stop_type", "i") == ["Terminal", "Regular", "Station", "Terminal", "Regular"]
    assert column(df, "is_terminal", "i") == [True, True, False, True, False]


def test_route_name_patterns(spark):
    df = spark.createDataFrame([("R1",), ("AB",), ("a1",), (None,)], "n string")
    assert tuple(one(stops.name_pattern_counts(df, "n"))) == (2, 1)


@pytest.mark.parametrize("text", ["37/airport", "new  market", "o'neil's", "a1b2", "ÉCOLE élan", "x"])
def test_title_case_like_python(spark, text):
    assert one(spark.createDataFrame([(text,)], "t string").select(X.title_case("t").alias("t"))).t == text.title()


def test_parse_od(spark):
    asked = ["Madina to Circle", " a  TO  b to c", "no phrase", "tomorrow", None]
    df = parse_od(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, q string"), "q")
    rows = df.orderBy("i").collect()
    assert (rows[0].origin, rows[0].destination, rows[0].status) == ("Madina", "Circle", "ok")
    assert (rows[1].origin, rows[1].destination) == ("A", "B")
    assert all(r.origin is None and r.status != "ok" for r in rows[2:])


def test_confidence_edges(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.41,), (0.4,), (-1.0,)], "s double")
    assert column(df.select(X.confidence_band("s").alias("b")), "b") == ["High", "Medium", "Medium", "Low", "Low"]


def test_haversine_and_vectors(spark):
    row = one(spark.range(1).select(
        X.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
        X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("right"),
        X.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0))).alias("zero"),
        X.mean_pool(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)))).alias("mean")))
    assert row.half == pytest.approx(math.pi * X.EARTH_RADIUS_M)
    assert row.right == 0 and row.zero is None and row["mean"] == [2.0, 4.0]


# --- stations ---------------------------------------------------------------

RAW = "id long, name string, gtfs_stop_id string, station_latitude string, station_longitude string"


def raw_stations(spark):
    return spark.createDataFrame([
        (1, "A", "S1", " 5.55 ", "-0.2"), (2, "B", None, "5.6", "-0.3"), (3, "C", "S3", "abc", "-0.3"),
        (4, "D", "S4", None, "-0.3"), (5, "E", "S5", "NaN", "1"),
    ], RAW)


def test_normalised_stops(spark):
    rows = stops.normalise_stops(raw_stations(spark)).orderBy("id").collect()
    assert [(r.stop_id, r.stop_lat, r.coordinates.lon) for r in rows] == [("S1", 5.55, -0.2), ("2", 5.6, -0.3)]


def test_strict_stops_fail(spark):
    with pytest.raises(SparkRuntimeException):
        stops.normalise_stops(raw_stations(spark), strict=True).collect()


def test_search_wildcards(spark):
    df = spark.createDataFrame([(1, "50% off"), (2, "50x off")], "id int, n string")
    assert column(stops.search_text(df, ["n"], "50%", ["id"]), "id") == [1, 2]
    assert column(stops.search_text(df, ["n"], "50%", ["id"], escape=True), "id") == [1]


def test_city_scope(spark):
    stations = spark.createDataFrame([(1, "Accra"), (2, "Accra"), (3, "Kumasi")], "id long, gtfs_source string")
    lines = spark.createDataFrame([(10, "Accra"), (11, "Kumasi")], "id long, source string")
    trips = spark.createDataFrame([(100, 10), (101, 11), (102, None)], "trip_id long, route_id long")
    fares = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 3, 1)], "id long, start_station_id long, end_station_id long")
    net = stops.Network(stations, lines, trips, fares)
    both = stops.filter_city(net, "Accra")
    assert column(both.trips, "trip_id") == [100] and column(both.fares, "id") == [1]
    assert column(stops.filter_city(net, "Accra", ends="start").fares, "id", "id") == [1, 2]
    assert stops.filter_city(net, "accra").stations.count() == 0
    assert stops.filter_city(net, "accra", ignore_case=True).stations.count() == 2
    assert stops.filter_city(net, None) is net


# --- joins ------------------------------------------------------------------

def test_direct_routes(spark):
    """The two trips may differ, the lowest wins, pairs without a route stay."""
    trips = spark.createDataFrame([
        (1, 7, 100, 300), (2, 7, 400, 200), (3, 8, 100, 200), (4, None, 100, 999), (5, 9, None, 200),
    ], "trip_id long, route_id long, start_station_id long, destination_id long")
    pairs = spark.createDataFrame([(100, 200), (100, 300), (400, 999), (1, 2)], "from_id long, to_id long")
    rows = {(r.from_id, r.to_id): (r.route_id, r.trip_from, r.trip_to) for r in joins.direct_routes(pairs, trips).collect()}
    assert rows == {(100, 200): (7, 1, 2), (100, 300): (7, 1, 1), (400, 999): (None, None, None), (1, 2): (None, None, None)}
    assert joins.direct_routes(pairs, trips.limit(0)).filter("route_id IS NULL").count() == 4


def test_fare_lookup_takes_the_first(spark):
    fares = spark.createDataFrame([(2, 1, 2, 9.0), (1, 1, 2, 4.0)], "id long, start_station_id long, end_station_id long, fare_amount double")
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "from_id long, to_id long")
    assert column(joins.fare_lookup(pairs, fares), "fare_amount", "from_id") == [4.0, None]


def test_trips_without_route_are_unknown(spark):
    places = spark.createDataFrame([(1, "A", 5.0, 0.0), (2, "B", 5.1, 0.1)], "stop_id long, stop_name string, stop_lat double, stop_lon double")
    lines = spark.createDataFrame([(7, "Accra")], "route_id long, source string")
    trips = spark.createDataFrame([(1, 7, 1, 2), (2, None, 2, 1), (3, 7, None, 1)], "trip_id long, route_id long, start_station_id long, destination_id long")
    rows = joins.enrich_trips(trips, lines, places).orderBy("trip_id").collect()
    assert [(r.trip_id, r.start_station, r.source) for r in rows] == [(1, "A", "Accra"), (2, "B", "unknown")]


# --- demand and routes ------------------------------------------------------

def tiny_network(spark):
    calls = spark.createDataFrame([
        (1, "a", 1, "08:00:00"), (1, "b", 2, "08:30:00"), (2, "a", 1, "08:10:00"), (2, "x", 3, "25:00:00"), (9, "a", 1, "08:00:00"),
    ], "trip_id long, stop_id string, stop_sequence int, arrival_time string")
    trips = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "trip_id long, route_id long")
    lines = spark.createDataFrame([(7, 3, "g1"), (8, 3, None), (9, 3, "g2")], "route_id long, route_type int, agency_id string")
    places = spark.createDataFrame([("a", 5.0, 0.0), ("b", 5.5, 0.25)], "stop_id string, stop_lat double, stop_lon double")
    return calls, trips, lines, places


def test_hourly_demand(spark):
    calls, trips, lines, places = tiny_network(spark)
    rows = demand.hourly_demand(calls, trips, lines, places).orderBy("stop_id").collect()
    assert [(r.stop_id, r.hour, r.demand, r.is_peak) for r in rows] == [("a", 8, 2, True), ("b", 8, 1, True)]


def test_peak_hour_tie_takes_the_earlier(spark):
    df = spark.createDataFrame([("a", 9, 4), ("a", 8, 4), ("b", 7, 1)], "stop_id string, hour int, demand long")
    assert one(demand.peak_hour(df)).hour == 8


def test_route_features(spark):
    """All trips count; a stop without position counts as stop; routes without calls drop out."""
    calls, trips, lines, places = tiny_network(spark)
    row = one(routes.route_features(lines, trips, calls, places))
    assert (row.route_id, row.n_trips, row.n_stops, row.max_stop_sequence) == (7, 3, 3, 3)
    assert (row.avg_stop_sequence, row.lat_range, row.avg_lat, row.avg_lon) == (1.75, 0.5, 5.25, 0.125)
    assert one(routes.route_features(lines, trips, calls, places.limit(0))).avg_lat == 0
    stats = one(routes.route_stats(lines, trips, calls))
    assert (stats.n_trips, stats.n_stops, stats.efficiency) == (2, 3, pytest.approx(2 / 3))


def test_trips_per_route_with_zero(spark):
    _, trips, lines, _ = tiny_network(spark)
    assert column(routes.trips_per_route(lines, trips), "trips_count", "route_id") == [3, 1, 0]


def test_agencies_without_name_are_left_out(spark):
    _, _, lines, _ = tiny_network(spark)
    agency = spark.createDataFrame([("g1", "One"), ("g2", "Two")], "agency_id string, agency_name string")
    assert column(routes.agency_routes(lines, agency), "agency_name") == ["One", "Two"]
    assert tuple(one(routes.agency_sizes(lines, agency))) == (1, 2)


def test_headways_with_ties(spark):
    calls = spark.createDataFrame([
        (3, "a", "08:00:00"), (1, "a", "08:00:00"), (2, "a", "08:10:00"), (4, "b", "09:00:00"), (5, "a", "bad"),
    ], "trip_id long, stop_id string, arrival_time string")
    rows = {(r.stop_id, r.trip_id): r.headway_s for r in demand.headways(calls).collect()}
    assert rows == {("a", 1): None, ("a", 3): 0, ("a", 2): 600, ("b", 4): None}
    gaps = {r.stop_id: (r.calls, r.mean_headway_s, r.longest_gap_s) for r in demand.service_gaps(calls).collect()}
    assert gaps == {"a": (3, 300.0, 600), "b": (1, None, None)}


def test_event_gaps_across_buckets(spark):
    times = ["2024-01-01 08:10:00", "2024-01-01 08:10:00", "2024-01-01 08:50:00", "2024-01-01 11:00:00", "2024-01-03 11:00:00.5"]
    events = spark.createDataFrame([("a", t) for t in times] + [("b", times[0]), (None, times[0]), ("b", None)], "k string, t string")
    events = events.withColumn("t", F.col("t").cast("timestamp"))
    rows = {(r.k, r.moment.strftime("%d %H:%M")): (r.events, r.gap_s) for r in demand.event_gaps(events, "k", "t").collect()}
    assert rows == {("a", "01 08:10"): (2, None), ("a", "01 08:50"): (1, 2400.0), ("a", "01 11:00"): (1, 7800.0),
                    ("a", "03 11:00"): (1, 172800.5), ("b", "01 08:10"): (1, None)}


def test_efficiency_score_noise_is_repeatable(spark):
    df = spark.range(200).selectExpr("id route_id", "id % 7 n_stops", "id % 3 * 0.1 lat_range", "id % 5 * 0.1 lon_range")
    scored = routes.efficiency_score(df)
    stats = one(scored.agg(F.avg("efficiency").alias("m"), F.stddev_samp("efficiency").alias("s")))
    assert stats.m == pytest.approx(0, abs=1e-12) and stats.s == pytest.approx(1)
    noisy = routes.efficiency_score(df, noise=True)
    assert column(noisy, "efficiency", "route_id") == column(noisy.repartition(3), "efficiency", "route_id")
    assert column(noisy, "efficiency", "route_id") != column(scored, "efficiency", "route_id")


def test_route_flags_are_strict(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0), (4, 4, 1.0)], "route_id int, n_stops int, lat_range double")
    rows = routes.route_flags(df).orderBy("route_id").collect()
    assert [r.low_stop_count for r in rows] == [True, False, False, False]
    assert [r.wide_spread for r in rows] == [False, False, False, True]


# --- bins -------------------------------------------------------------------

def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,), (None,)], "v double")
    assert column(profile.histogram(df, "v", 4), "n", "bin") == [1, 1, 1, 1]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert column(profile.histogram(flat, "v", 2), "n", "bin") == [2, 0]


def test_ranges_include_their_right_edge(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (10.0,)], "v double")
    rows = profile.range_counts(df, "v").orderBy("range").collect()
    assert [(r.range, r.n) for r in rows] == [(1, 2), (2, 1), (10, 1)]
    assert rows[0].range_from == pytest.approx(-0.01)
    assert one(profile.densest_range(df, "v")).range == 1


def test_value_counts_top(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("b", 3), (None, 3)], "x string, y int")
    rows = [(r["column"], r.value, r.n) for r in profile.value_counts(df, ["x", "y"], 1).orderBy("column").collect()]
    assert rows == [("x", "a", 2), ("y", "1", 2)]


# --- stacking, pairs, channels ----------------------------------------------

def test_union_common(spark):
    a = spark.createDataFrame([(1, "x", "c", "f")], "n int, only_a string, city string, source_file string")
    b = spark.createDataFrame([(2, "c", "g", "y")], "n int, city string, source_file string, only_b string")
    assert setops.union_common([a, b]).columns == ["n", "city", "source_file"]
    assert setops.union_common([a.drop("n"), b.drop("n")]) is None
    outer = setops.union_common([a.drop("n"), b.drop("n")], outer=True)
    assert set(outer.columns) == {"only_a", "only_b", "city", "source_file"} and outer.count() == 2


def test_one_bad_pair_rejects_the_batch(spark):
    good = spark.createDataFrame([("q", "a")], "question string, answer string")
    bad = good.unionByName(spark.createDataFrame([("q", "")], good.schema))
    assert one(corpus.validate_pairs(good)).accepted
    assert not one(corpus.validate_pairs(bad)).accepted
    assert not one(corpus.validate_pairs(good.limit(0))).accepted
    keep, drop = corpus.split_pairs(bad)
    assert (keep.count(), drop.count()) == (1, 1)


def test_channels(spark):
    df = spark.createDataFrame([
        (c, "Where & <when>?", "Here", 0.9, "ctx", "general") for c in ("whatsapp", "telegram", "web", "api", "fax")
    ], "channel string, question string, answer string, confidence double, context string, type string")
    rows = {r.channel: r for r in corpus.format_answer(df, "channel").collect()}
    assert "✅ *Confidence:* High" in rows["whatsapp"].response
    assert "Where &amp; &lt;when&gt;?" in rows["telegram"].response
    assert rows["web"].response == "Here" and '"confidence":0.9' in rows["api"].response
    assert rows["fax"].response is None and "whatsapp, telegram, web, api" in rows["fax"].error


def test_help_on_the_chat_channel(spark):
    df = spark.createDataFrame([("whatsapp", "HELP", "x", 0.1), ("web", "help", "y", 0.1)], "channel string, question string, answer string, confidence double")
    rows = {r.channel: r for r in corpus.format_answer(df, "channel", "Desk").collect()}
    assert rows["whatsapp"].response.startswith("🚌 *Desk Help*") and rows["whatsapp"].response_type == "help"
    assert (rows["web"].response, rows["web"].response_type) == ("y", "answer")


@pytest.mark.parametrize("text, value", [
    ("5.5", 5.5), (" 5. ", 5.0), (".5", 0.5), ("1e3", 1000.0), ("-2", -2.0), ("5.5d", None), ("5f", None), ("0x1p3", None),
    ("1_0", None), ("", None), ("NaN", None), (None, None), ("inf", float("inf")),
])
def test_plain_numbers(spark, text, value):
    assert one(spark.createDataFrame([(text,)], "t string").select(X.number_of("t").alias("v"))).v == value


def test_question_templates(spark):
    stations = spark.createDataFrame([(i, f"S{i}", "Accra", None) for i in range(40)], "id long, name string, gtfs_source string, station_address string")
    lines = spark.createDataFrame([(1, "R1", "A to B", "Accra")], "id long, short_name string, long_name string, source string")
    made = corpus.generate_questions(stations, lines, vehicle="shared taxi")
    assert made.filter("type = 'station_info'").count() == 8 * 40
    assert corpus.generate_questions(stations, lines, limit=30).filter("type = 'station_info'").count() == 8 * 30
    assert made.filter("type = 'route_info'").count() == 5
    trips = made.filter("type = 'trip_planning'")
    assert 0 < trips.count() <= 250 and trips.count() % 5 == 0
    assert made.filter("type = 'general'").count() == 5
    assert made.filter("answer LIKE '%{%' OR question LIKE '%{%'").count() == 0
    assert made.filter("answer LIKE '%Located in Accra%'").count() > 0
    again = corpus.trip_questions(stations.repartition(5), vehicle="shared taxi")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, trips.collect()))


def test_summaries(spark):
    runs = spark.createDataFrame([("completed",), ("failed",), ("failed",), ("odd",)], "status string")
    assert tuple(one(reports.run_summary(runs))) == (1, 0, 2)
    log = spark.createDataFrame([(True,), (False,), (None,)], "success boolean")
    assert tuple(one(reports.delivery_summary(log))) == (3, 1, 2)
