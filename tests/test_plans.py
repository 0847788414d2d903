"""Plans that must not appear whatever the data size."""

import pytest
from pyspark.sql import functions as F

from tramline.plans import roles
from tramline.plans.catalog import QUERIES
from tramline.plans.flows import answer_trip_questions
from tramline.session import new_folder
from tramline.sources.snapshots import write_bucketed

# Fitting models and draining streams are actions of their own.
EAGER = ("m5", "m7", "m9", "m10", "m11", "m12", "a", "j1_flat_messages_streamed", "j4", "j5_rolling_demand_streamed", "j7")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(EAGER)])
def test_no_cross_join_and_no_row_udf(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["d13_top_values"](spark, sf_dir))
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_linestatus:string>" in plan


def test_filter_reaches_the_scan(spark, sf_dir):
    scoped = roles.trips(spark, sf_dir).filter("transport_type = '1-URGENT'")
    plan = plan_of(scoped)
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_bucketed_tables_join_without_shuffle(spark, sf_dir):
    trips = roles.trips(spark, sf_dir).select("trip_id", "route_id")
    calls = roles.stop_times(spark, sf_dir).select("trip_id", "stop_id")
    for name, df in (("bucketed_trips", trips), ("bucketed_calls", calls)):
        write_bucketed(df, name, "trip_id", 4, new_folder(spark, name))
    joined = spark.table("bucketed_calls").join(spark.table("bucketed_trips").hint("merge"), "trip_id")
    assert "Exchange" not in plan_of(joined)
    assert joined.count() == calls.join(trips, "trip_id").count()


def test_ranks_are_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["d13_top_values"](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_lists_are_not_sorted_as_a_whole(spark, sf_dir):
    for name in ("f2_top_stops", "f4_preview", "b5_station_search", "d9_agency_routes"):
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf_dir)), name


def test_no_whole_column_percentile(spark, sf_dir):
    """Only the bounded time-of-day median may use the buffer-everything aggregate."""
    for name in ("d15_describe", "d17_imputed", "d18_outliers_capped", "d25_route_flags", "d32_usage_statistics"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "percentile(" not in plan and "median(" not in plan, name


def test_trip_questions_are_read_once(spark):
    """Matching and joining go over the questions again and again; what makes them runs once."""
    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return f"Stp{i} to Stop{i + 1}"

    asked = spark.range(6).select(F.udf(text, "string")("id").alias("question"))
    stations = spark.createDataFrame([(i, f"Stop{i}") for i in range(8)], "id long, stop_name string")
    trips = spark.createDataFrame([(1, 5, 2, 3)], "trip_id long, route_id long, start_station_id long, destination_id long")
    routes = spark.createDataFrame([(5, "r5", "line 5")], "route_id long, short_name string, long_name string")
    fares = spark.createDataFrame([(1, 2, 3, 4.5)], "id long, start_station_id long, end_station_id long, fare_amount double")
    rows = {r.question: r for r in answer_trip_questions(asked, stations, routes, trips, fares).collect()}
    assert len(rows) == 6 and rows["Stp2 to Stop3"].route == "r5 - line 5" and rows["Stp2 to Stop3"].fare_amount == 4.5
    assert rows["Stp4 to Stop5"].route is None and rows["Stp4 to Stop5"].from_name == "Stop4"
    assert seen.value == 6
