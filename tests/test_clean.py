"""Cleaning steps, one rule each, and the whole sequence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tramline.operators import clean, profile


def test_column_names():
    names = [" Stop Name ", "Fare (GHS)", "Ünique-ID", "a__b"]
    assert [clean.normalise_name(n) for n in names] == ["stop_name", "fare__ghs_", "ünique_id", "a__b"]
    assert [clean.normalise_name(n, collapse=True) for n in names] == ["stop_name", "fare_ghs_", "ünique_id", "a_b"]


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError, match="a_b"):
        clean.normalise_columns(spark.range(1).selectExpr("id `a b`", "id `a-b`"))


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "x")], "n long, t string")
    assert clean.validate_schema(df, {"n": "bigint"})
    assert not clean.validate_schema(df, {"n": "int"})
    assert not clean.validate_schema(df, {"absent": "string"})
    report = {r["column"]: (r.actual, r.ok) for r in clean.schema_report(df, {"n": "int", "t": "string", "z": "int"}).collect()}
    assert report == {"n": ("bigint", False), "t": ("string", True), "z": (None, False)}
    assert clean.split_columns(df) == (["n"], ["t"])


def test_sparse_threshold_is_strict(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 70, 1).alias("at70"), F.when(F.col("id") >= 71, 1).alias("at71"), F.col("id"))
    assert clean.drop_sparse_columns(df).columns == ["at70", "id"]


def test_text_order(spark):
    texts = ["  a \t b ", " nan ", "None", "", "NaN", "nano", None, " "]
    df = clean.normalise_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"))
    assert [r.t for r in df.orderBy("i").collect()] == ["a b", None, None, None, None, "nano", None, None]


def test_copies_that_differ_in_blanks_survive(spark):
    df = spark.createDataFrame([("a",), ("a",), (" a",)], "t string")
    assert clean.clean_table(df).count() == 2


def test_impute(spark):
    df = spark.createDataFrame(
        [(1, "b", None, True), (2, "a", None, None), (10, "a", None, True), (None, "b", None, False), (3, None, None, None)],
        "n int, t string, e string, f boolean")
    rows = clean.impute(df).collect()
    assert [r.n for r in rows] == [1.0, 2.0, 10.0, 2.5, 3.0]
    assert rows[4].t == "a" and rows[0].e == "Unknown" and rows[1].f is True


def test_simple_clean(spark):
    df = spark.createDataFrame([(1, None), (None, None), (None, "x")], "n int, t string")
    assert sorted(map(tuple, clean.simple_clean(df).collect())) == [("1", "Unknown"), ("Unknown", "x")]


def test_dates(spark):
    texts = ["2024-03-01", "2024-03-01 10:20:30", "2024-03-01T10:20:30", "03/25/2024", "25-03-2024", "2024/03/01", "x", "2024-13-01", None]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "i int, start_date string, n int")
    rows = clean.coerce_dates(df).orderBy("i").collect()
    days = [r.start_date.date() if r.start_date else None for r in rows]
    march = dt.date(2024, 3, 1)
    assert days == [march, march, march, dt.date(2024, 3, 25), dt.date(2024, 3, 25), march, None, None, None]
    number = clean.coerce_dates(spark.createDataFrame([(1_700_000_000_000_000_000,)], "time_ns long")).collect()[0]
    assert number.time_ns.year == 2023


def test_outliers(spark):
    values = [1, 2, 3, 4, 5, 1000, -1000]
    df = spark.createDataFrame([(i, float(v), 5.0) for i, v in enumerate(values)], "id int, v double, flat double")
    rows = clean.cap_outliers(df, exclude=["id"]).orderBy("id").collect()
    assert [r.v for r in rows] == [1, 2, 3, 4, 5, 9.0, -3.0]
    assert {r.flat for r in rows} == {5.0} and [r.id for r in rows] == list(range(7))
    assert {r["column"]: r.capped for r in clean.outlier_counts(df, ["v", "flat"]).collect()} == {"v": 2, "flat": 0}


def test_capping_keeps_values_inside_the_fences(spark):
    df = spark.range(500).select((F.pow(F.col("id") % 97 - 40, 3)).alias("v"))
    q = {r.p: r.value for r in clean.quantile_lookup.__globals__["exact_quantiles"](df, ["v"], [0.25, 0.75]).collect()}
    spread = q[0.75] - q[0.25]
    out = clean.cap_outliers(df).agg(F.min("v"), F.max("v")).first()
    assert out[0] >= q[0.25] - 1.5 * spread and out[1] <= q[0.75] + 1.5 * spread


def test_whole_sequence(spark):
    df = spark.createDataFrame([
        (1, " Circle ", "2024-01-01", None, None), (2, "Tema", "bad", None, None), (2, "Tema", "bad", None, None),
        (None, "nan", "2024-01-03", None, "rare"), (4, "Tema", None, None, None), (None, None, None, None, None),
    ], "Fare int, `Stop Name` string, `Start Date` string, nothing string, rare string")
    out = clean.clean_table(df, "Accra", "stops.csv")
    assert out.columns == ["fare", "stop_name", "start_date", "city", "source_file"]
    rows = sorted((r.fare, r.stop_name, r.start_date) for r in out.filter("start_date IS NOT NULL").collect())
    assert out.count() == 4 and out.filter("fare IS NULL OR stop_name IS NULL").count() == 0
    assert (1.0, "Circle", dt.datetime(2024, 1, 1)) in rows and (2.0, "Tema", dt.datetime(2024, 1, 3)) in rows


def test_duplicates_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "n int, t string")
    once = clean.deduplicate(df)
    assert once.count() == clean.deduplicate(once).count() == 2
    assert tuple(clean.duplicate_report(df).collect()[0]) == (4, 2, 2)
    assert tuple(clean.duplicate_report(df.limit(0)).collect()[0]) == (0, 0, 0)


def test_missing_and_types(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    rows = {r["column"]: (r.missing, r.overall_missing_pct) for r in profile.missing(df).collect()}
    assert rows == {"a": (1, 75.0), "b": (2, 75.0)}
    assert {r.dtype: r.n_columns for r in profile.type_counts(df).collect()} == {"int": 1, "string": 1}


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 100.0), (50.0, None)], "a double, b double")
    row = profile.correlations(df, ["a", "b"]).collect()[0]
    assert (row.column_a, row.column_b) == ("b", "a") and row["corr"] == pytest.approx(1.0)


def test_approximate_cardinality(spark):
    rows = profile.cardinality(spark.range(1000), ["id"], approximate=True).collect()
    assert abs(rows[0].n_distinct - 1000) < 150


def test_times_of_day_stay_text(spark):
    df = spark.createDataFrame([("08:00:00", "2024-01-05 10:30", 1), ("25:10:00", "1/5/2024", 2), (None, "2024-01-05T10:30:00Z", 3), ("", "05-01-2024", 4)], "arrival_time string, start_date string, k int")
    out = clean.coerce_dates(df).orderBy("k")
    assert dict(out.dtypes)["arrival_time"] == "string" and dict(out.dtypes)["start_date"] == "timestamp"
    assert [str(r.start_date)[:16] for r in out.collect()] == ["2024-01-05 10:30", "2024-01-05 00:00", "2024-01-05 10:30", "2024-05-01 00:00"]


def test_mixed_types_stack_as_text(spark):
    from tramline.operators.setops import union_common

    a = spark.createDataFrame([("x", "f", 1.5, 1)], "city string, source_file string, fare double, n int")
    b = spark.createDataFrame([("y", "g", "free", 2.5)], "city string, source_file string, fare string, n double")
    both = union_common([a, b]).orderBy("city")
    assert [tuple(r) for r in both.collect()] == [("x", "f", "1.5", 1.0), ("y", "g", "free", 2.5)]


def test_files_cleaned_together_like_one_by_one(spark):
    """Every file of a mixed set comes out as ``clean_table`` makes it alone."""
    import random

    from tramline.operators import clean, keyed
    from tramline.sources import files as sources

    random.seed(4)
    tables = {
        ("A", "x.csv"): (["Stop ID", "Fare", "Kind", "Empty", "Update Date"], [
            (str(i % 40), random.choice(["1", "2.5", "900", None, " 3"]), random.choice([" a ", "b  c", "nan", None]), None, random.choice(["2024-01-02", "2024-02-03 04:05:06", None])) for i in range(120)]),
        ("A", "y.csv"): (["Stop ID", "Fare", "Mostly"], [(str(i), str(i * i), "v" if i % 9 == 0 else None) for i in range(50)] + [("7", "49", None)] * 3 + [(None, None, None)]),
        ("B", "z.txt"): (["stop id", "departure_time", "note"], [(f"s{i}", f"{i % 24:02d}:15:00", random.choice(["p", "q"])) for i in range(30)]),
    }
    rows, alone = None, {}
    for (city, name), (header, data) in tables.items():
        frame = spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in header))
        cells = frame.select(F.lit(city).alias("city"), F.lit(name).alias("source_file"), F.array(*[F.struct(F.lit(h).alias("name"), F.col(f"`{h}`").alias("value")) for h in header]).alias("cells"))
        rows = cells if rows is None else rows.unionByName(cells)
        alone[city, name] = clean.clean_table(sources.promote_types(frame), exclude=["stop_id"])
    collide = spark.createDataFrame([("B", "bad.csv", [("A b", "1"), ("a_b", "2")])], rows.schema)
    cleaned = keyed.clean_cells(rows.unionByName(collide), exclude=["stop_id"])
    found = {}
    for r in cleaned.rows.collect():
        found.setdefault((r.city, r.source_file), []).append(tuple(sorted((c["name"], str(next((v for v in (c.number, c.text, c.moment) if v is not None), None))) for c in r.cells)))
    assert set(found) == set(alone)
    for key, frame in alone.items():
        expected = [tuple(sorted((c, str(float(v)) if isinstance(v, (int, float)) else str(v)) for c, v in r.asDict().items())) for r in frame.collect()]
        assert sorted(found[key]) == sorted(expected)
    report = {(r.city, r.source_file): r for r in cleaned.report.collect()}
    assert report["B", "bad.csv"].status == "failed" and "a_b" in report["B", "bad.csv"].reason
    assert (report["A", "y.csv"].rows_in, report["A", "y.csv"].rows_out, report["A", "y.csv"].columns) == (54, 50, ["fare", "stop_id"])
    summary = {r.city: r for r in keyed.cleaning_report(cleaned.report).collect()}
    assert (summary["A"].files, summary["A"].failed, summary["A"].common_columns) == (2, 0, "fare,stop_id")
    assert (summary["B"].files, summary["B"].failed) == (1, 1)
    both = keyed.stacked(cleaned)
    assert keyed.stacked(cleaned, 4) is None
    assert both.columns == ["city", "source_file", "stop_id"] and both.count() == sum(f.count() for f in alone.values())
