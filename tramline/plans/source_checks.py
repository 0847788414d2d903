"""Sources and sinks: every query writes the given tables out and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators import keyed
from tramline.operators.setops import union_common
from tramline.plans.registry import query
from tramline.plans.roles import table
from tramline.session import new_folder
from tramline.sources import files, snapshots
from tramline.streaming.demand_stream import write_append

CITY_SEPARATORS = [",", "\t", ";", "|", ","]


def customers_by_region(spark, d) -> DataFrame:
    return (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "c_mktsegment", F.col("r_name").alias("city"))
    )


BY_REGION = """SELECT c_custkey, c_name, c_mktsegment, r_name AS city
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query("a2_city_files", BY_REGION)
def city_files(spark, d):
    """A folder per region, each with another separator, found, sniffed and stacked."""
    root = new_folder(spark, "cities")
    customers = customers_by_region(spark, d)
    regions = [r.r_name for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    for city, sep in zip(regions, CITY_SEPARATORS):
        customers.filter(F.col("city") == city).drop("city").write.csv(f"{root}/{city}", sep=sep, header=True)
    stacked = union_common(files.read_city_files(spark, root))
    return stacked.select(F.col("c_custkey").try_cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment", "city")


@query("a1_delimited_file", "SELECT c_custkey, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer")
def delimited_file(spark, d):
    """Columns divided by blanks, found by trying; numbers get their type back."""
    path = new_folder(spark, "blanks")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").write.csv(path, sep=" ", header=True)
    return files.promote_types(files.read_delimited(spark, path))


@query("a3_sorted_snapshot", "SELECT n_nationkey, n_name FROM nation")
def sorted_snapshot(spark, d):
    return snapshots.read_snapshot(spark, d, "nation", ["n_nationkey", "n_name"], ["n_name"])


@query("f1_fares_by_amount", "SELECT o_orderkey, o_totalprice FROM orders")
def fares_by_amount(spark, d):
    return snapshots.read_snapshot(spark, d, "orders", ["o_orderkey", "o_totalprice"], ["o_totalprice", "o_orderkey"])


ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderdate string, o_orderpriority string"


@query("a4_json_dump", """
    SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def json_dump(spark, d):
    path = new_folder(spark, "dump")
    table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority"
    ).write.json(path)
    return snapshots.read_json_dump(spark, path, ORDER_SCHEMA)


@query("a4_json_dump_of_day", """
    SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders
    WHERE o_orderdate::DATE = DATE '1998-10-03'""")
def json_dump_of_day(spark, d):
    path = new_folder(spark, "dump")
    table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority"
    ).write.json(path)
    return snapshots.read_json_dump(spark, path, ORDER_SCHEMA, "o_orderdate", "1998-10-03")


@query("a5_qa_csv", "SELECT text AS question, role AS answer FROM conversations")
def qa_csv(spark, d):
    path = new_folder(spark, "qa")
    table(spark, d, "conversations").select(F.col("text").alias("question"), F.col("role").alias("answer")).write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return files.read_qa_csv(spark, path)


CORPUS = "SELECT text AS question, role AS answer, 'chat' AS context, 'general' AS type FROM conversations"


def _corpus(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("text").alias("question"), F.col("role").alias("answer"), F.lit("chat").alias("context"),
        F.lit("general").alias("type"),
    )


@query("a6_corpus_saved", CORPUS)
def corpus_saved(spark, d):
    path = new_folder(spark, "corpus")
    files.save_corpus(_corpus(spark, d), path)
    return files.load_corpus(spark, path)[0]


@query("a6_corpus_metadata", "SELECT '1.0' AS version, count(*) AS total_questions FROM conversations")
def corpus_metadata(spark, d):
    path = new_folder(spark, "corpus")
    files.save_corpus(_corpus(spark, d), path)
    return files.load_corpus(spark, path)[1].select("version", "model_info.total_questions")


@query("a7_clean_files", BY_REGION)
def clean_files(spark, d):
    path = new_folder(spark, "clean")
    files.write_clean(customers_by_region(spark, d), path)
    return files.read_clean(spark, path).select(
        F.col("c_custkey").try_cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment", "city"
    )


@query("a8_result_records", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def result_records(spark, d):
    path = new_folder(spark, "results")
    files.write_results(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), path)
    return spark.read.schema("event_type string, n bigint").json(path)


@query("a9_live_feed", "SELECT event_id, user_id, event_type FROM events")
def live_feed(spark, d):
    """Landed JSON snapshots read as a stream into a table."""
    landing, out, state = (new_folder(spark, label) for label in ("landing", "feed", "feed-state"))
    table(spark, d, "events").select("event_id", "user_id", "event_type").write.json(landing)
    feed = snapshots.live_feed(spark, landing, "event_id bigint, user_id bigint, event_type string")
    write_append(feed, out, state).awaitTermination()
    return spark.read.parquet(out)


@query("a10_refresh_status", """
    SELECT event_type || (user_id % 40) AS dataset, max(ts) + INTERVAL 24 HOUR < TIMESTAMP '2024-01-30 12:00:00' AS stale,
           CASE WHEN max(ts) + INTERVAL 24 HOUR < TIMESTAMP '2024-01-30 12:00:00' THEN 'refresh' ELSE 'cached' END AS status
    FROM events GROUP BY 1""")
def refresh_status(spark, d):
    log = table(spark, d, "events").select(
        F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("dataset"), F.col("ts").alias("synced_at")
    )
    return snapshots.refresh_status(log, "2024-01-30 12:00:00").drop("last_synced")


@query("a10_failed_refresh", "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def failed_refresh(spark, d):
    """A refresh that fails while its rows are written; the old ones are still read."""
    target, log = new_folder(spark, "snapshots"), new_folder(spark, "sync-log")
    events = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    broken = events.withColumn("n", F.when(F.col("first") > events.agg(F.min("first")).scalar(), F.raise_error(F.lit("source lost"))).otherwise(0))
    snapshots.refresh_snapshots(spark, {"demand": lambda: events}, target, log, "2024-01-01 00:00:00")
    status = snapshots.refresh_snapshots(spark, {"demand": lambda: broken}, target, log, "2024-01-03 00:00:00")
    if status != {"demand": "failed"}:
        raise RuntimeError(f"the refresh was to fail, but {status}")
    return snapshots.read_snapshot(spark, target, "demand", ["event_type", "n", "first"])


# --- many files of several layouts, cleaned together --------------------------

def messy_cities(spark, d) -> str:
    """Two files per region, of two headers and four separators, with gaps, far values, repeated and empty rows.

    Between tabs an empty row would be a blank line, which is no row.
    """
    root = new_folder(spark, "messy")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("city"))
    regions = [r.r_name for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    customers = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("city", *_messy("c_custkey", "c_acctbal"), F.col("c_mktsegment").alias("Market Segment"))
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("city", *_messy("s_suppkey", "s_acctbal"), F.lit(None).cast("string").alias("Nothing"))
    for rows in (customers, suppliers):
        twice = rows.unionByName(rows.filter(F.col("Key") % 5 == 0)).unionByName(rows.filter((F.col("Key") % 9 == 0) & (F.col("city") != regions[1])).select("city", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:]]))
        for city, sep in zip(regions, CITY_SEPARATORS):
            twice.filter(F.col("city") == city).drop("city").coalesce(1).write.mode("append").csv(f"{root}/{city}", sep=sep, header=True, ignoreLeadingWhiteSpace=False)
    return root


def _messy(key: str, balance: str) -> list:
    k, b = F.col(key), F.col(balance)
    return [k.alias("Key"), F.when(k % 7 != 3, F.when(k % 11 == 4, b * 50).otherwise(b)).alias("Balance ($)")]


def clean_cities(spark, d) -> keyed.Cleaned:
    return keyed.clean_cells(files.read_cells(spark, messy_cities(spark, d)), exclude=["key"])


MESSY = """
    WITH n AS (SELECT n_nationkey, r_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey),
    raw AS (
        SELECT city, 'c' AS file, c_custkey AS key, c_mktsegment AS segment, CASE WHEN c_custkey % 7 <> 3 THEN c_acctbal * CASE WHEN c_custkey % 11 = 4 THEN 50 ELSE 1 END END AS balance
        FROM customer JOIN n ON c_nationkey = n_nationkey
        UNION ALL
        SELECT city, 's', s_suppkey, NULL, CASE WHEN s_suppkey % 7 <> 3 THEN s_acctbal * CASE WHEN s_suppkey % 11 = 4 THEN 50 ELSE 1 END END
        FROM supplier JOIN n ON s_nationkey = n_nationkey),
    whole AS (SELECT city, file, key, segment, coalesce(balance, quantile_cont(balance, 0.5) OVER f) AS balance FROM raw WINDOW f AS (PARTITION BY city, file)),
    quarters AS (SELECT city, file, quantile_cont(balance, 0.25) AS q1, quantile_cont(balance, 0.75) AS q3 FROM whole GROUP BY 1, 2),
    fences AS (SELECT city, file, q1, q3, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) END AS low, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) END AS high FROM quarters),
    clean AS (SELECT city, file, key, segment, greatest(least(balance, high), low) AS balance, coalesce(balance < low OR balance > high, false) AS outside FROM whole JOIN fences USING (city, file))
"""


@query("d18_file_fences", MESSY + """
    SELECT city, 'balance____' AS name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (outside) AS capped
    FROM fences JOIN clean USING (city, file) GROUP BY ALL""")
def file_fences(spark, d):
    """Fences and capped values of the numbers of every file, all files in one plan."""
    rounded = [F.round(c, 6).alias(c) for c in ("q1", "q3", "low", "high")]
    return clean_cities(spark, d).fences.select("city", "name", *rounded, "capped")


@query("d33_cleaning_report", MESSY + """
    SELECT city, count(DISTINCT file) AS files, 0::BIGINT AS failed,
        sum(CASE WHEN key % 5 = 0 THEN 2 ELSE 1 END + CASE WHEN key % 9 = 0 AND city <> (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1 OFFSET 1) THEN 1 ELSE 0 END)::BIGINT AS rows_in, count(*) AS rows_out,
        'balance____,key' || CASE WHEN count(DISTINCT file) = 1 AND min(file) = 'c' THEN ',market_segment' ELSE '' END AS common_columns FROM clean GROUP BY city""")
def cleaning_report(spark, d):
    """Files, rows before and after, and common columns per city."""
    return keyed.cleaning_report(clean_cities(spark, d).report)


@query("a7_cleaned_files", MESSY + "SELECT city, key::DOUBLE AS key, segment, round(balance, 6) AS balance FROM clean WHERE file = 'c'")
def cleaned_files(spark, d):
    """The cleaned rows of the files with a segment."""
    rows = clean_cities(spark, d).rows.filter(F.exists("cells", lambda c: c["name"] == "market_segment"))
    of = keyed.cell_of
    return rows.select("city", of("key")["number"].alias("key"), of("market_segment")["text"].alias("segment"), F.round(of("balance____")["number"], 6).alias("balance"))


@query("a7_combined", MESSY + "SELECT city, key::DOUBLE AS key, round(balance, 6) AS balance FROM clean")
def combined(spark, d):
    """All files on their common columns."""
    return keyed.stacked(clean_cities(spark, d)).select("city", "key", F.round("balance____", 6).alias("balance"))
