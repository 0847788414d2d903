"""Grid search against brute force, also far north, across the date line and with copies."""

import numpy as np
import pytest

from tramline.functions.expressions import EARTH_RADIUS_M
from tramline.operators import geo


def metres(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(np.sqrt(h), 1))


CASES = {
    "equator": (0.0, 0.0, 0.05, 700), "accra": (5.6, -0.2, 0.1, 1500), "north": (78.0, 15.0, 0.3, 5000),
    "date line": (-17.0, 179.99, 0.1, 3000), "pole": (89.7, 0.0, 180.0, 30000), "wide": (45.0, 3.0, 5.0, 200000),
}


CASES["grid"] = (0.0, 10.0, 0.02, 1111.95)


def scatter(case, n, seed):
    lat, lon, spread, _ = CASES[case]
    rng = np.random.default_rng(seed)
    lats = np.clip(lat + rng.uniform(-1, 1, n) * min(spread, 0.29 if case == "pole" else spread), -90, 90)
    lons = (lon + rng.uniform(-1, 1, n) * spread + 180) % 360 - 180
    if case == "grid":
        lats, lons = np.round(lats, 3), np.round(lons, 3)
    lats[: n // 3], lons[: n // 3] = lats[0], lons[0]
    return lats, lons


@pytest.mark.parametrize("broadcast", [True, False], ids=["broadcast", "dealt"])
@pytest.mark.parametrize("case", CASES)
def test_like_brute_force(spark, monkeypatch, case, broadcast):
    monkeypatch.setattr(geo, "is_broadcast_size", lambda df: broadcast)
    monkeypatch.setattr(geo, "HOT_SHARE", 4)
    radius = CASES[case][3]
    plat, plon = scatter(case, 90, 1)
    slat, slon = scatter(case, 60, 2)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(plat, plon))], "p int, lat double, lon double")
    stops = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(slat, slon))], "stop_id int, stop_lat double, stop_lon double")
    near = {r.p: (r.n_near, r.nearest_m) for r in geo.near_stops(points, stops, radius).collect()}
    gaps = {r.p for r in geo.coverage_gaps(points, stops, radius).collect()}
    for i in range(len(plat)):
        d = metres(plat[i], plon[i], slat, slon)
        hits = (d <= radius).sum()
        assert near.get(i, (0,))[0] == hits
        assert (i in gaps) == (hits == 0)
        if hits:
            assert near[i][1] == pytest.approx(d.min(), abs=1e-2)
    copies = {r.stop_id: r.n_near for r in geo.near_duplicates(stops, radius).collect()}
    for i in range(len(slat)):
        d = np.delete(metres(slat[i], slon[i], slat, slon), i)
        assert copies.get(i, 0) == (d <= radius).sum()


def test_dense_cluster(spark):
    """Thousands of places around one corner are counted without pairing them."""
    rng = np.random.default_rng(3)
    n = 3000
    lats, lons = 5.6 + rng.uniform(0, 1e-6, n), -0.2 + rng.uniform(0, 1e-6, n)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lats, lons))] + [(n, 5.601, -0.2), (n + 1, 5.7, -0.2)]
    stops = spark.createDataFrame(rows, "stop_id int, stop_lat double, stop_lon double")
    found = {r.stop_id: r.n_near for r in geo.near_duplicates(stops, 200).collect()}
    assert found == {i: n for i in range(n + 1)}
