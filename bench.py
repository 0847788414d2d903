"""Times the headline queries and prints one JSON line.

Every query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
Results go to a no-op sink, so all rows and columns are computed and none kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tramline.plans.catalog import QUERIES  # noqa: E402
from tramline.session import build_session  # noqa: E402

HEADLINE = [
    "c1_trips_enriched", "c2_fares_enriched", "c3_schedule", "c5_direct_routes", "c6_fare_lookup",
    "c12_fuzzy_stations", "c13_similar_questions", "c13_substring_answers", "c14_near_stops",
    "d3_hourly_demand", "d6_route_features", "d7_route_stats", "d10_agency_centroids", "d13_top_values",
    "d15_describe", "d16_correlations", "d17_imputed", "d18_outliers_capped", "d20_histogram",
    "d23_frequency_grid", "d25_route_flags", "e2_headways", "e2_service_gaps", "j2_routed_messages",
    "j5_rolling_demand", "m1_standardised", "m2_stratified_split",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "*"))
    times = {}
    for name in names:
        def run(q=QUERIES[name]):
            return q(spark, sf_dir)

        seconds(run)
        times[name] = round(statistics.median(seconds(run) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "sum of median seconds per headline query",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
