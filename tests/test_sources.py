"""Files, snapshots, corpora and freshness."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tramline.plans import flows
from tramline.schemas import ROUTES, STATIONS
from tramline.sources import files, snapshots


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)
    return full


@pytest.mark.parametrize("lines, sep", [
    (["a,b", "1,2"], ","), (["a\tb", "1\t2"], "\t"), (["a;b", "1;2"], ";"), (["a|b", "1|2"], "|"),
    (["a  b", "1    2"], r"\s+"), (["a,b", "1;2,3,4"], None), (["a", "1"], None), (["a,b"], None), ([], None),
    (['a,b', '"x,y",2'], ","), (["a,b;c", "1,2,3;4"], ";"), (["a,b", "1"], ","),
])
def test_sniffing(lines, sep):
    assert files.sniff_separator(lines) == sep


def city_root(tmp_path):
    root = str(tmp_path / "raw")
    write(root, "Accra/stops.txt", "Stop ID,Stop Name,Fare\n1,Circle,2.5\n2,Tema,3.5\n2,Tema,3.5\n3, Lapaz ,\n")
    write(root, "Accra/routes.csv", "Stop ID;Stop Name;Kind\n1;\"a;b\";x\n2;c;y\n")
    write(root, "Kumasi/sub stops+1.csv", "Stop ID|Stop Name|Fare\n9|Kejetia|4\n")
    write(root, "Kumasi/blank.txt", "Stop ID  Stop\n")
    write(root, "Kumasi/runs.txt", "stop_id   stop_name  fare\n\n4   Adum    7\n")
    write(root, "Kumasi/empty.csv", "")
    write(root, "Kumasi/notes.md", "a,b\n1,2\n")
    write(root, "all_combined.csv", "Stop ID,Stop Name,Fare\n1,Circle,2.5\n")
    return root


def test_layouts(spark, tmp_path):
    rows = {(r.city, r.source_file): r.separator for r in files.scan_layouts(spark, city_root(tmp_path)).collect()}
    assert rows == {
        ("Accra", "stops.txt"): ",", ("Accra", "routes.csv"): ";", ("Kumasi", "sub stops+1.csv"): "|",
        ("Kumasi", "blank.txt"): None, ("Kumasi", "runs.txt"): r"\s+",
    }


def test_cities(spark, tmp_path):
    assert sorted(r.city for r in files.list_cities(spark, city_root(tmp_path)).collect()) == ["Accra", "Kumasi"]


def test_city_files(spark, tmp_path):
    frames = files.read_city_files(spark, city_root(tmp_path))
    rows = {(r["city"], r["source_file"]): n for df in frames for r, n in [(x, x["count"]) for x in df.groupBy("city", "source_file").count().collect()]}
    assert rows == {("Accra", "stops.txt"): 4, ("Accra", "routes.csv"): 2, ("Kumasi", "sub stops+1.csv"): 1, ("Kumasi", "runs.txt"): 1}
    quoted = next(df for df in frames if "Kind" in df.columns)
    assert sorted(r["Stop Name"] for r in quoted.collect()) == ["a;b", "c"]
    runs = next(df for df in frames if "stop_id" in df.columns).collect()[0]
    assert (runs.stop_id, runs.stop_name, runs.fare, runs.city) == ("4", "Adum", "7", "Kumasi")


def test_clean_and_reload_counts_rows_once(spark, tmp_path):
    out = str(tmp_path / "out")
    root = city_root(tmp_path)
    write(root, "Kumasi/twice.csv", "A b,a_b\n1,2\n")
    report = flows.clean_city_files(spark, root, out, exclude=["stop_id"])
    assert {(r.city, r.source_file) for r in report.filter("status = 'failed'").collect()} == {("Kumasi", "twice.csv")}
    report = report.filter("status = 'cleaned'")
    counts = {(r.city, r.source_file): (r.rows_in, r.rows_out) for r in report.collect()}
    assert counts[("Accra", "stops.txt")] == (4, 3) and len(counts) == 4
    combined = spark.read.parquet(f"{out}/combined")
    loaded = flows.load_cleaned(spark, out)
    assert combined.count() == loaded.count() == sum(o for _, o in counts.values())
    assert set(combined.columns) == {"stop_id", "stop_name", "city", "source_file"}
    assert spark.read.parquet(f"{out}/by_city_combined/*/city=Accra").count() == 5
    lapaz = spark.read.parquet(f"{out}/by_city/*/city=Accra/source_file=stops.txt").filter("stop_name = 'Lapaz'").collect()[0]
    assert lapaz.fare == 3.0


def test_single_delimited_file(spark, tmp_path):
    path = write(str(tmp_path), "x.txt", "a   b\n1   x\n2.5   y\n")
    df = files.promote_types(files.read_delimited(spark, path))
    assert df.dtypes == [("a", "double"), ("b", "string")] and df.count() == 2
    assert files.read_delimited(spark, write(str(tmp_path), "y.txt", "only\none\n")) is None


def test_type_promotion(spark):
    df = spark.createDataFrame([("1", " 2.5", "x", None), ("2", "3", "4", None)], "a string, b string, c string, d string")
    assert [t for _, t in files.promote_types(df).dtypes] == ["bigint", "double", "string", "string"]


def test_clean_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Accra", "f1", 'say "hi", ok'), ("Kumasi", "f2", "x")], "city string, source_file string, t string")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        files.write_clean(df, path, ("city", "source_file"), fmt)
        back = files.read_clean(spark, path, fmt).select(*df.columns)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_qa_csv(spark, tmp_path):
    path = write(str(tmp_path), "qa.csv", 'question,answer\n"Fare, A to B?","4, or ""5"""\n')
    assert files.read_qa_csv(spark, path).collect()[0].answer == '4, or "5"'
    with pytest.raises(ValueError, match="answer"):
        files.read_qa_csv(spark, write(str(tmp_path), "bad.csv", "question\nx\n"))


def test_corpus(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a", "c", "general")], "question string, answer string, context string, type string")
    files.save_corpus(rows, str(tmp_path / "c"), "2.0", "some-model")
    corpus, meta = files.load_corpus(spark, str(tmp_path / "c"))
    assert corpus.collect() == rows.collect()
    info = meta.collect()[0]
    assert (info.version, info.model_info.total_questions, info.model_info.embeddings_model) == ("2.0", 1, "some-model")
    assert info.created_at is not None


def test_json_dumps(spark, tmp_path):
    for name, rows in (("stations", [{"id": 1, "name": "Circle", "gtfs_source": "Accra"}]),
                       ("routes", [{"id": 2, "short_name": "R1", "created_at": "2024-01-02T00:00:00"}]), ("trips", []), ("fares", [])):
        write(str(tmp_path), f"dump/{name}/part.json", "\n".join(map(json.dumps, rows)))
    tables = snapshots.read_all_dumps(spark, str(tmp_path / "dump"))
    assert tables["stations"].schema == STATIONS and tables["stations"].count() == 1 and tables["trips"].count() == 0
    path = str(tmp_path / "dump" / "routes")
    assert snapshots.read_json_dump(spark, path, ROUTES, "created_at", "2024-01-02").count() == 1
    assert snapshots.read_json_dump(spark, path, ROUTES, "created_at", "2024-01-03").count() == 0


def test_freshness(spark):
    log = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-01 00:00:00")], "dataset string, t string")
    log = log.select("dataset", F.col("t").cast("timestamp").alias("synced_at"))
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string")
    def stale(**kw):
        rows = snapshots.refresh_status(log, "2024-01-03 00:00:00", names, **kw).collect()
        return sorted(r.dataset for r in rows if r.stale)
    assert stale() == ["b", "c"]
    assert stale(force=True) == ["a", "b", "c"]
    assert stale(max_age_hours=23) == ["a", "b", "c"]


def test_refresh(spark, tmp_path):
    def fails():
        raise RuntimeError("no data")
    readers = {"good": lambda: spark.range(3), "bad": fails}
    target, log = str(tmp_path / "snap"), str(tmp_path / "log")
    assert snapshots.refresh_snapshots(spark, readers, target, log, "2024-01-01 00:00:00") == {"good": "success", "bad": "failed"}
    assert snapshots.refresh_snapshots(spark, readers, target, log, "2024-01-01 12:00:00") == {"good": "cached", "bad": "failed"}
    assert snapshots.refresh_snapshots(spark, readers, target, log, "2024-01-03 12:00:00")["good"] == "success"
    assert snapshots.read_snapshot(spark, target, "good", ["id"], ["id"]).count() == 3


def test_versions_of_a_snapshot(spark, tmp_path):
    """Readers see whole versions; a failed write leaves the old rows, and its number is not given again."""
    target = str(tmp_path / "snap")
    read = lambda: snapshots.read_snapshot(spark, target, "t", ["id"]).count()
    assert snapshots.commit_snapshot(spark.range(3), target, "t") == "000000000001"
    begun = spark.read.parquet(snapshots.current_path(spark, target, "t"))
    with pytest.raises(Exception, match="broken"):
        snapshots.commit_snapshot(spark.range(100).withColumn("id", F.when(F.col("id") > 50, F.raise_error(F.lit("broken"))).otherwise(F.col("id"))), target, "t")
    assert read() == 3
    assert snapshots.commit_snapshot(spark.range(5), target, "t") == "000000000003" and read() == 5 and begun.count() == 3
    snapshots.commit_snapshot(spark.range(7), target, "t")
    assert read() == 7 and len(os.listdir(f"{target}/t.versions/data")) == 2


def test_results(spark, tmp_path):
    path = str(tmp_path / "results")
    files.write_results(spark.createDataFrame([("r1", 0.5)], "route_id string, score double"), path)
    assert spark.read.json(path).collect()[0].score == 0.5
    runs = spark.createDataFrame([("demand", "completed", None, path, 1)], "model string, status string, reason string, results_file string, records_processed long")
    for _ in range(2):
        files.write_run_summary(runs, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


def test_whole_files_are_judged(spark, tmp_path):
    """A wider line far down, a data line like the header, missing words, quoted line ends, names twice or with a dot."""
    root = str(tmp_path / "raw")
    write(root, "A/wide.csv", "a,b\n" + "1,2\n" * 60 + "1,2,3\n")
    write(root, "A/semi.csv", "a;b\n" + "1;2,5\n" * 60 + "1;2,3,4\n")
    write(root, "A/same.txt", "name fare\nname fare\nx 1\n")
    write(root, "A/lines.csv", 'id,note\n1,"two\nlines, here"\n2,plain\n')
    write(root, "B/words.csv", "fare,fare,x.y\nNA,1,NULL\n2,n/a,v\n3,,None\n")
    found = {r.source_file: (r.separator, r.multiline) for r in files.scan_layouts(spark, root).collect()}
    assert found == {"wide.csv": (None, False), "semi.csv": (";", False), "same.txt": (r"\s+", False), "lines.csv": (",", True), "words.csv": (",", False)}
    rows = {(r.source_file, tuple((c.name, c.value) for c in r.cells)) for r in files.read_cells(spark, root).collect()}
    assert {r for f, r in rows if f == "same.txt"} == {(("name", "name"), ("fare", "fare")), (("name", "x"), ("fare", "1"))}
    assert {r for f, r in rows if f == "lines.csv"} == {(("id", "1"), ("note", "two\nlines, here")), (("id", "2"), ("note", "plain"))}
    assert {r for f, r in rows if f == "words.csv"} == {
        (("fare", None), ("fare.1", "1"), ("x.y", None)), (("fare", "2"), ("fare.1", None), ("x.y", "v")), (("fare", "3"), ("fare.1", None), ("x.y", None))}
    typed = files.promote_types(files.read_delimited(spark, f"{root}/B/words.csv"))
    assert typed.dtypes == [("fare", "bigint"), ("fare.1", "bigint"), ("x.y", "string")]
    assert files.read_delimited(spark, f"{root}/A/wide.csv") is None
