"""Cleaning, profiling, bins, stacking, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions.expressions import confidence_band
from tramline.ml import models, registry
from tramline.operators import clean, corpus, profile, reports, setops
from tramline.plans import roles
from tramline.plans.registry import query
from tramline.plans.roles import rounded, table, with_roles

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- cleaning steps ---------------------------------------------------------

def gappy_documents(spark, d):
    """Documents with columns that are empty, 80 % empty and 70 % empty."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias(" Doc ID "), F.col("lang").alias("Lang"), F.col("n_chars").alias("N-Chars"),
        F.lit(None).cast("string").alias("Nothing"),
        F.when(k % 10 >= 8, F.col("source")).alias("Rare"),
        F.when(k % 10 >= 7, F.col("source")).alias("Some"),
    )


@query("b12_normalised_columns", """
    SELECT doc_id, lang, n_chars AS n_chars, NULL::VARCHAR AS nothing,
           CASE WHEN doc_id % 10 >= 8 THEN source END AS rare, CASE WHEN doc_id % 10 >= 7 THEN source END AS some
    FROM documents""")
def normalised_columns(spark, d):
    return clean.normalise_columns(gappy_documents(spark, d))


@query("b13_sparse_columns_dropped", """
    SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 10 >= 7 THEN source END AS some FROM documents""")
def sparse_columns_dropped(spark, d):
    return clean.drop_sparse_columns(clean.normalise_columns(gappy_documents(spark, d)))


@query("b13_empty_rows_and_columns", """
    SELECT CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 5 <> 0 THEN source END AS source
    FROM documents WHERE doc_id % 5 <> 0""")
def empty_rows_and_columns(spark, d):
    k = F.col("doc_id")
    holes = table(spark, d, "documents").select(
        F.when(k % 5 != 0, F.col("lang")).alias("lang"), F.when(k % 5 != 0, F.col("source")).alias("source"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return clean.drop_empty_columns(clean.drop_empty_rows(holes))


@query("b14_text_normalised", r"""
    SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (
        SELECT doc_id, regexp_replace(CASE WHEN raw NOT IN ('nan', 'NaN', 'None', '') THEN raw END, '\s+', ' ', 'g') AS t
        FROM (SELECT doc_id, regexp_replace(
                  CASE doc_id % 9 WHEN 0 THEN ' nan ' WHEN 1 THEN '   ' ELSE '  ' || text || chr(10) END,
                  '^\s+|\s+$', '', 'g') AS raw FROM documents))""")
def text_normalised(spark, d):
    k = F.col("doc_id")
    raw = F.when(k % 9 == 0, " nan ").when(k % 9 == 1, "   ").otherwise(
        F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    )
    text = clean.normalise_text(table(spark, d, "documents").select("doc_id", raw.alias("t")), ["t"])
    return text.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query("b15_dates_coerced", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS order_date FROM orders""")
def dates_coerced(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(k % 5 == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 3, "soon")
    )
    dated = clean.coerce_dates(table(spark, d, "orders").select("o_orderkey", text.alias("order_date")))
    return dated.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query("b18_simple_clean", """
    SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'Unknown') AS o_orderstatus,
           o_orderpriority FROM orders""")
def simple_clean(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"), "o_orderpriority"
    )
    return clean.simple_clean(orders)


def orders_with_gaps(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 6 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 4 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.lit(None).cast("string").alias("note"),
    )


GAPS = """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority,
               NULL::VARCHAR AS note FROM orders"""


def _mode_sql(column: str) -> str:
    return (f"(SELECT {column} FROM g WHERE {column} IS NOT NULL GROUP BY 1 "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


@query("d17_imputed", f"""
    WITH g AS ({GAPS})
    SELECT o_orderkey,
           round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM g)), 6) AS o_totalprice,
           round(coalesce(o_custkey, (SELECT quantile_cont(o_custkey, 0.5) FROM g))::DOUBLE, 6) AS o_custkey,
           coalesce(o_orderstatus, {_mode_sql('o_orderstatus')}) AS o_orderstatus,
           coalesce(o_orderpriority, {_mode_sql('o_orderpriority')}) AS o_orderpriority,
           'Unknown' AS note FROM g""")
def imputed(spark, d):
    columns = ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "note"]
    return rounded(clean.impute(orders_with_gaps(spark, d), columns))


@query("d17_modes", f"""
    WITH g AS ({GAPS})
    SELECT 'o_orderstatus' AS "column", {_mode_sql('o_orderstatus')} AS value
    UNION ALL SELECT 'o_orderpriority', {_mode_sql('o_orderpriority')}""")
def column_modes(spark, d):
    return clean.modes(orders_with_gaps(spark, d), ["o_orderstatus", "o_orderpriority", "note"])


FENCES = """f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"""


@query("d18_outliers_capped", f"""
    WITH {FENCES}
    SELECT event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS value
    FROM events, f""")
def outliers_capped(spark, d):
    return rounded(clean.cap_outliers(table(spark, d, "events").select("event_id", "value"), exclude=["event_id"]))


@query("d18_outlier_counts", f"""
    WITH {FENCES}
    SELECT 'value' AS "column", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS capped
    FROM events, f""")
def outlier_counts(spark, d):
    return clean.outlier_counts(table(spark, d, "events"), ["value"])


@query("d19_deduplicated", "SELECT DISTINCT text, lang FROM documents")
def deduplicated(spark, d):
    return clean.deduplicate(table(spark, d, "documents").select("text", "lang"))


@query("d19_duplicate_report", """
    SELECT sum(c)::BIGINT AS rows_in, count(*) AS rows_out, sum(c - 1)::BIGINT AS removed
    FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang)""")
def duplicate_report(spark, d):
    return clean.duplicate_report(table(spark, d, "documents").select("text", "lang"))


@query("b13_clean_table", """
    WITH g AS (SELECT DISTINCT CASE WHEN doc_id % 10 < 8 THEN '  ' || lang || ' ' END AS lang, source,
                      CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n_chars FROM documents),
         t AS (SELECT trim(lang) AS lang, source, n_chars FROM g),
         i AS (SELECT coalesce(lang, (SELECT lang FROM t WHERE lang IS NOT NULL GROUP BY 1
                                      ORDER BY count(*) DESC, lang LIMIT 1)) AS lang, source,
                      coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM t))::DOUBLE AS n_chars FROM t),
         f AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM i)
    SELECT lang, source, round(least(greatest(n_chars, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS n_chars,
           'Accra' AS city, 'documents.csv' AS source_file FROM i, f""")
def cleaned_table(spark, d):
    k = F.col("doc_id")
    messy = table(spark, d, "documents").select(
        F.when(k % 10 < 8, F.concat(F.lit("  "), F.col("lang"), F.lit(" "))).alias(" LANG"),
        F.col("source").alias("Source"),
        F.when(k % 7 != 0, F.col("n_chars")).alias("N Chars"),
        F.lit(None).cast("string").alias("empty"),
    )
    return rounded(clean.clean_table(messy, "Accra", "documents.csv"))


# --- profiles ---------------------------------------------------------------

@query("d2_extent", with_roles("stops", """
    SELECT min(stop_lat) AS min_lat, max(stop_lat) AS max_lat, min(stop_lon) AS min_lon, max(stop_lon) AS max_lon FROM stops"""))
def extent(spark, d):
    return profile.extent(roles.stops(spark, d))


@query("d31_centre", with_roles("stops", """
    SELECT round(avg(stop_lat), 9) AS center_lat, round(avg(stop_lon), 9) AS center_lon FROM stops"""))
def centre(spark, d):
    return rounded(profile.centre(roles.stops(spark, d)), 9)


@query("d13_top_values", """
    SELECT "column", value, n, "rank"::INTEGER AS "rank" FROM (
        SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS "rank" FROM (
            SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
            UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
            UNION ALL SELECT 'l_suppkey', l_suppkey::VARCHAR, count(*) FROM lineitem GROUP BY 2)) WHERE "rank" <= 3""")
def top_values(spark, d):
    return profile.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], 3)


@query("d13_route_types", with_roles("routes", """
    SELECT 'route_type' AS "column", route_type::VARCHAR AS value, count(*) AS n FROM routes GROUP BY 2"""))
def route_types(spark, d):
    return profile.value_counts(roles.routes(spark, d), ["route_type"])


@query("d13_question_types", """
    SELECT coalesce(nullif(role, 'system'), 'unknown') AS type, count(*) AS n,
           (SELECT count(*) FROM conversations) AS total_questions FROM conversations GROUP BY 1""")
def question_types(spark, d):
    kinds = table(spark, d, "conversations").select(F.nullif(F.col("role"), F.lit("system")).alias("type"))
    return reports.corpus_statistics(kinds)


@query("d13_categorical_profile", """
    SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS "rank" FROM (
        SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
        UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2)""")
def categorical_profile(spark, d):
    return profile.categorical_profile(table(spark, d, "lineitem"))


@query("d14_missing", f"""
    WITH g AS ({GAPS}), c AS (
        SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS missing FROM g
        UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM g
        UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey) FROM g
        UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus) FROM g
        UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority) FROM g
        UNION ALL SELECT 'note', count(*) - count(note) FROM g)
    SELECT "column", missing,
           round((SELECT sum(missing) FROM c) * 100.0 / ((SELECT count(*) FROM g) * 6), 6)::DOUBLE AS overall_missing_pct
    FROM c""")
def missing(spark, d):
    return rounded(profile.missing(orders_with_gaps(spark, d)))


def _describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS n, round(avg({column}), 6) AS mean,
        round(stddev_samp({column}), 6) AS std, min({column}) AS min, max({column}) AS max,
        round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS q50,
        round(quantile_cont({column}, 0.75), 6) AS q75 FROM lineitem"""


@query("d15_describe", " UNION ALL ".join(_describe_sql(c) for c in NUMBERS))
def describe(spark, d):
    return rounded(profile.describe(table(spark, d, "lineitem"), NUMBERS))


@query("d16_correlations", " UNION ALL ".join(
    f"""SELECT '{b}' AS column_a, '{a}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"""
    for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]))
def correlations(spark, d):
    return rounded(profile.correlations(table(spark, d, "lineitem"), NUMBERS))


@query("d20_histogram", """
    WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
         c AS (SELECT least(floor((value - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS n FROM events, b GROUP BY 1)
    SELECT i::INTEGER AS bin, round(lo + i * ((hi - lo) / 20), 6) AS bin_from,
           round(lo + (i + 1) * ((hi - lo) / 20), 6) AS bin_to, coalesce(n, 0) AS n
    FROM range(20) r(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""")
def histogram(spark, d):
    return rounded(profile.histogram(table(spark, d, "events"), "value", 20))


@query("d21_density2d", """
    WITH b AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z, min(l_extendedprice) AS p, max(l_extendedprice) AS q FROM lineitem)
    SELECT least(floor((l_quantity - a) / (z - a) * 50), 49)::INTEGER AS x_bin,
           least(floor((l_extendedprice - p) / (q - p) * 50), 49)::INTEGER AS y_bin, count(*) AS n
    FROM lineitem, b GROUP BY 1, 2""")
def density2d(spark, d):
    return profile.density2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


RANGES = """
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
         c AS (SELECT greatest(1, least(10, ceil((l_extendedprice - lo) / (hi - lo) * 10)))::INTEGER AS r, count(*) AS n
               FROM lineitem, b GROUP BY 1)
    SELECT r AS "range", round(CASE WHEN r = 1 THEN lo - (hi - lo) * 0.001 ELSE lo + (r - 1) * ((hi - lo) / 10) END, 6) AS range_from,
           round(lo + r * ((hi - lo) / 10), 6) AS range_to, n FROM c, b"""


@query("d22_range_counts", RANGES)
def range_counts(spark, d):
    return rounded(profile.range_counts(table(spark, d, "lineitem"), "l_extendedprice"))


@query("d22_densest_range", RANGES + " ORDER BY n DESC, r LIMIT 1")
def densest_range(spark, d):
    return rounded(profile.densest_range(table(spark, d, "lineitem"), "l_extendedprice"))


@query("d29_cardinality", """
    SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey) AS n_distinct FROM lineitem
    UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""")
def cardinality(spark, d):
    return profile.cardinality(table(spark, d, "lineitem"), ["l_orderkey", "l_shipdate", "l_returnflag"])


@query("f4_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark, d):
    return profile.preview(table(spark, d, "orders"), ["o_orderkey"], 10)


# --- stacking ---------------------------------------------------------------

def city_frames(spark, d):
    """Three tables that share a name, a nation and a balance column."""
    return [
        table(spark, d, "customer").select(
            F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        table(spark, d, "supplier").select(
            F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
            F.col("s_acctbal").alias("balance")),
        table(spark, d, "nation").select(
            F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"),
            F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")),
    ]


STACKED = """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier
    UNION ALL SELECT n_nationkey, n_name, n_nationkey FROM nation"""


@query("g1_union_common", STACKED)
def union_common(spark, d):
    return setops.union_common(city_frames(spark, d))


@query("g2_union_outer", """
    SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment,
           NULL::INTEGER AS region FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, NULL FROM supplier
    UNION ALL SELECT n_nationkey, n_name, n_nationkey, NULL, NULL, n_regionkey FROM nation""")
def union_outer(spark, d):
    return setops.union_common(city_frames(spark, d), min_common=4, outer=True)


@query("g3_append_pairs", """
    SELECT text AS question, role AS answer, 'chat' AS context, 'general' AS type FROM conversations
    UNION ALL SELECT text, item_id::VARCHAR, NULL, NULL FROM benchmark""")
def append_pairs(spark, d):
    corpus_rows = table(spark, d, "conversations").select(
        F.col("text").alias("question"), F.col("role").alias("answer"), F.lit("chat").alias("context"),
        F.lit("general").alias("type"),
    )
    extra = table(spark, d, "benchmark").select(
        F.col("text").alias("question"), F.col("item_id").cast("string").alias("answer")
    )
    return setops.append_rows(corpus_rows, extra)


@query("d33_cleaning_summary", """
    SELECT lang AS city, count(DISTINCT source) AS files, count(*) AS records, 5 AS columns FROM documents GROUP BY 1""")
def cleaning_summary(spark, d):
    return setops.cleaning_summary(table(spark, d, "documents"), "lang", "source").withColumnRenamed("lang", "city")


@query("d33_file_report", """
    SELECT lang AS city, source AS source_file, count(*) AS rows_in, count(DISTINCT text) AS rows_out
    FROM documents GROUP BY 1, 2""")
def file_report(spark, d):
    before = table(spark, d, "documents").select(F.col("lang").alias("city"), F.col("source").alias("source_file"), "text")
    return setops.file_report(before, clean.deduplicate(before))


# --- summaries --------------------------------------------------------------

@query("d27_run_summary", """
    SELECT count(*) FILTER (event_type IN ('purchase', 'signup')) AS completed,
           count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events""")
def run_summary(spark, d):
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("purchase", "signup"), "completed").when(kind == "view", "skipped")
        .when(kind == "error", "failed").otherwise("unknown")
    )
    return reports.run_summary(table(spark, d, "events").select(status.alias("status")))


@query("d28_delivery_summary", """
    SELECT count(*) AS total_sent, count(*) FILTER (event_type <> 'error') AS delivered,
           count(*) FILTER (event_type = 'error') AS errors FROM events""")
def delivery_summary(spark, d):
    return reports.delivery_summary(
        table(spark, d, "events").select((F.col("event_type") != "error").alias("success"))
    )


BAND = "CASE WHEN value / 500 > 0.7 THEN 'High' WHEN value / 500 > 0.4 THEN 'Medium' ELSE 'Low' END"


@query("b17_confidence_bands", f"SELECT event_id, {BAND} AS band FROM events")
def confidence_bands(spark, d):
    return table(spark, d, "events").select("event_id", confidence_band(F.col("value") / 500).alias("band"))


@query("d32_confidence_distribution", f"SELECT {BAND} AS band, count(*) AS n FROM events GROUP BY 1")
def confidence_distribution(spark, d):
    return reports.confidence_distribution(
        table(spark, d, "events").select((F.col("value") / 500).alias("confidence"))
    )


@query("d32_usage_statistics", """
    SELECT count(*) AS requests, round(avg(value), 6) AS mean_s, round(quantile_cont(value, 0.5), 6) AS median_s,
           round(quantile_cont(value, 0.95), 6) AS p95_s, round(max(value), 6) AS max_s FROM events""")
def usage_statistics(spark, d):
    return rounded(reports.usage_statistics(table(spark, d, "events"), "value"))


@query("b16_pair_validation", """
    SELECT count(*) AS pairs, count(*) FILTER (text = '' OR role = 'system') AS bad,
           count(*) FILTER (text = '' OR role = 'system') = 0 AS accepted FROM conversations""")
def pair_validation(spark, d):
    pairs = table(spark, d, "conversations").select(
        F.col("text").alias("question"), F.nullif(F.col("role"), F.lit("system")).alias("answer")
    )
    return corpus.validate_pairs(pairs)


@query("b16_good_pairs", "SELECT conv_id, turn, text AS question, role AS answer FROM conversations WHERE text <> '' AND role <> 'system'")
def good_pairs(spark, d):
    pairs = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("question"), F.nullif(F.col("role"), F.lit("system")).alias("answer")
    )
    return corpus.split_pairs(pairs)[0]


# --- model metrics kept in tables -------------------------------------------

def model_scores(spark, d):
    """A metrics table: event types as targets, three algorithms by user."""
    return table(spark, d, "events").groupBy(
        F.col("event_type").alias("target"), F.concat(F.lit("algo"), (F.col("user_id") % 3).cast("string")).alias("algorithm"),
    ).agg(F.avg("value").alias("test_score")).withColumn("task", F.lit("regression"))


SCORES = """m AS (SELECT event_type AS target, 'algo' || (user_id % 3) AS algorithm, avg(value) AS test_score
    FROM events GROUP BY 1, 2), best AS (SELECT * FROM m QUALIFY
    row_number() OVER (PARTITION BY target ORDER BY test_score DESC, algorithm) = 1)"""


@query("d30_best_models", f"WITH {SCORES} SELECT target, 'regression' AS task, algorithm, round(test_score, 6) AS test_score FROM best")
def best_models(spark, d):
    return rounded(registry.best_models(model_scores(spark, d)))


@query("d30_best_overall", f"""WITH {SCORES} SELECT target, 'regression' AS task, algorithm, round(test_score, 6) AS test_score
    FROM best ORDER BY best.test_score DESC, target LIMIT 1""")
def best_overall(spark, d):
    return rounded(registry.best_overall(model_scores(spark, d)))


@query("d30_wins", f"WITH {SCORES} SELECT algorithm, count(*) AS wins FROM best GROUP BY 1")
def wins(spark, d):
    return registry.wins(model_scores(spark, d))


@query("e3_next_version", """
    SELECT o_orderpriority AS model, concat_ws('.', v.a, v.b, v.c + 1) AS next_version FROM (
        SELECT o_orderpriority, max({'a': o_custkey % 3, 'b': o_orderkey % 12, 'c': o_orderkey % 100}) AS v
        FROM orders GROUP BY 1)""")
def next_version(spark, d):
    log = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("model"),
        F.concat_ws(".", F.col("o_custkey") % 3, F.col("o_orderkey") % 12, F.col("o_orderkey") % 100).alias("version"),
    )
    return registry.next_version(log)


def nation_clusters(spark, d):
    """Stops grouped by nation, as a clustering whose result is known."""
    return roles.stops(spark, d).withColumn("cluster_id", F.col("gtfs_source"))


@query("d24_cluster_sizes", with_roles("stops", """
    SELECT round(avg(n), 6) AS avg_size, max(n) AS max_size, min(n) AS min_size, count(*) FILTER (n < 5) AS small_clusters
    FROM (SELECT count(*) AS n FROM stops GROUP BY gtfs_source)"""))
def cluster_sizes(spark, d):
    return rounded(models.cluster_sizes(nation_clusters(spark, d)))


@query("d34_cluster_summary", with_roles("stops", """
    SELECT gtfs_source AS cluster_id, count(*) AS n_stops, round(avg(stop_lat), 9) AS center_lat,
           round(avg(stop_lon), 9) AS center_lon, CASE WHEN count(*) > 1 THEN 'consolidate' ELSE 'keep' END AS recommendation
    FROM stops GROUP BY 1"""))
def cluster_summary(spark, d):
    return rounded(models.cluster_summary(nation_clusters(spark, d)), 9)


@query("d34_cluster_members", with_roles("stops", "SELECT gtfs_source AS cluster_id, stop_id FROM stops"))
def cluster_members(spark, d):
    return models.cluster_members(nation_clusters(spark, d))


# --- schemas ------------------------------------------------------------------

EXPECTED = {"l_orderkey": "bigint", "l_linenumber": "bigint", "l_quantity": "double", "l_returnflag": "string", "l_comment": "string"}
DUCK_NAME = "CASE lower(typeof({0})) WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' ELSE lower(typeof({0})) END"


def _column_sql(column: str, kind: str) -> str:
    found = "NULL::VARCHAR" if column == "l_comment" else DUCK_NAME.format(column)
    return f"SELECT '{column}' AS \"column\", '{kind}' AS expected, {found} AS actual, coalesce({found} = '{kind}', false) AS ok FROM (SELECT * FROM lineitem LIMIT 1)"


@query("b11_schema_report", " UNION ALL ".join(_column_sql(c, k) for c, k in EXPECTED.items()))
def schema_report(spark, d):
    """Columns that are there, of another type, and absent."""
    return clean.schema_report(table(spark, d, "lineitem"), EXPECTED)


LINE_KINDS = {c: "number" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS)} | {"l_returnflag": "text", "l_linestatus": "text"}


@query("b19_column_kinds", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS filled FROM lineitem" for c, k in LINE_KINDS.items()))
def column_kinds(spark, d):
    """Filled values of the numeric and of the text columns."""
    lines = table(spark, d, "lineitem")
    numeric, text = clean.split_columns(lines)
    counts = lines.agg(*[F.count(c).alias(c) for c in [*numeric, *text]]).unpivot([], [*numeric, *text], "column", "filled")
    return counts.withColumn("kind", F.when(F.col("column").isin(numeric), "number").otherwise("text"))
