import math

import numpy as np
import pytest

from tramline.functions import quantiles
from tramline.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]


def check(spark, values):
    rows = [(None if v is None else float(v),) for v in values]
    df = spark.createDataFrame(rows, "x double")
    found = {r.p: r.value for r in exact_quantiles(df, ["x"], PROBS).collect()}
    clean = np.array([v for v in values if v is not None and not math.isnan(v)], dtype=float)
    for p in PROBS:
        assert found[p] == pytest.approx(np.quantile(clean, p), rel=1e-12, abs=1e-12), p


@pytest.mark.parametrize("values", [
    [1, 2, 3, 10],
    [5],
    [7, 7, 7, 7],
    [1, None, 2, float("nan"), 9],
    list(range(1000)) * 3,
    [1e-300, 1e300, -1e300, 0, 3, 3, 3],
    [0] * 900 + [1e9] * 3,
    [1.7e308, -1.7e308, 1.0, 2.0, 0.5, -3.0],
], ids=["small", "one", "equal", "gaps", "repeats", "extremes", "hot", "widest"])
def test_like_numpy(spark, values):
    check(spark, values)


def test_random_shapes(spark):
    rng = np.random.default_rng(7)
    check(spark, list(rng.lognormal(0, 3, 5000)) + [0.0] * 2500)


def test_exact_when_the_sketch_is_useless(spark, monkeypatch):
    """With a tiny sketch and no margin the ranks fall outside the bracket and are still found."""
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 8)
    monkeypatch.setattr(quantiles, "RANK_MARGIN", 0.0)
    monkeypatch.setattr(quantiles, "ENOUGH", 20)
    monkeypatch.setattr(quantiles.group_quantiles, "__defaults__", (20,))
    check(spark, list(np.random.default_rng(1).normal(0, 1, 2000)))


@pytest.mark.parametrize("values", [
    [0.0] * 500 + [1.0] * 500,
    [0.0] * 600 + list(range(1, 400)),
    [5.0] * 1000,
    list(np.random.default_rng(2).lognormal(0, 8, 3000)),
    [*np.random.default_rng(3).integers(0, 3, 3000), float("inf"), float("-inf"), float("inf")],
], ids=["two", "heavy", "equal", "long tail", "few"])
def test_rounds_end_in_small_brackets(spark, values, monkeypatch):
    """Whatever the distribution, no more than ``enough`` different values are sorted at the end."""
    enough, seen = 50, []
    picked = quantiles._picked

    def watched(rows, targets, keys):
        distinct = rows.join(targets, keys).filter("value > lo and value < hi").groupBy(*keys, "p").agg({"value": "count"}).collect()
        seen.extend(r[2] for r in distinct)
        return picked(rows, targets, keys)

    monkeypatch.setattr(quantiles, "_picked", watched)
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 2.0), ("c", None)], "k string, value double")
    found = {(r.k, r.p): r.value for r in quantiles.group_quantiles(rows, ["k"], PROBS, enough).collect()}
    assert max(seen, default=0) <= enough
    for p in PROBS:
        lower = np.sort(np.array(values, float))[int(np.floor(p * (len(values) - 1)))]
        exact = np.quantile(np.array(values, float), p) if np.isfinite(values).all() else lower
        assert found["a", p] == pytest.approx(exact, rel=1e-12) or not np.isfinite(values).all() and found["a", p] >= lower
        assert found["b", p] == pytest.approx(1 + p)
    assert ("c", 0.5) not in found


def test_several_columns_and_empty(spark):
    df = spark.range(1, 101).selectExpr("cast(id as int) a", "cast(null as double) b")
    rows = exact_quantiles(df, ["a", "b"], [0.5]).collect()
    assert [(r["column"], r["value"]) for r in rows] == [("a", 50.5)]


def test_infinite_values(spark):
    values = [(float("-inf"),), (1.0,), (2.0,), (3.0,), (float("inf"),)]
    df = spark.createDataFrame(values, "x double")
    found = {r.p: r.value for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    assert found[0.25] == 1.0 and found[0.5] == 2.0 and found[0.75] == 3.0


def test_rows_of_a_group_stay_where_they_are(spark):
    """A group may hold most rows: the few lines that steer go to the rows, never the rows to one task by their group."""
    rows = spark.range(4000).selectExpr("'a' as k", "cast(id % 997 as double) as value").localCheckpoint()
    found = quantiles.group_quantiles(rows, ["k"], [0.25, 0.5], 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert {r.p: r.value for r in found.collect()} == {p: float(np.quantile(np.arange(4000) % 997, p)) for p in (0.25, 0.5)}
