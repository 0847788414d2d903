"""Matching questions to stations and answers, and the question corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions.expressions import cosine, dot, mean_pool
from tramline.functions.fixed_values import (
    CHANNELS, CHAT_FORMAT, CONFIDENCE_LINES, GENERAL_TEMPLATES, HELP_REPLY, HTML_FORMAT, OD_HINT, ROUTE_TEMPLATES, STATION_TEMPLATES,
    TRIP_TEMPLATES,
)
from tramline.operators import corpus, match
from tramline.plans import roles
from tramline.plans.flows import answer_trip_questions
from tramline.plans.registry import ORACLE, query
from tramline.plans.roles import rounded, table, with_roles


def _title_sql(text: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({text}, '[a-zA-Z]+|[^a-zA-Z]+'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), '')")


@query("h1_parsed_questions", f"""
    WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name
                  ELSE ' ' || p_name || ' TO 37/' || lower(p_type) || ' to x' END AS t FROM part)
    SELECT p_partkey, CASE WHEN contains(lower(t), ' to ') THEN {_title_sql("trim(split(lower(t), ' to ')[1])")} END AS origin,
           CASE WHEN contains(lower(t), ' to ') THEN {_title_sql("trim(split(lower(t), ' to ')[2])")} END AS destination,
           CASE WHEN contains(lower(t), ' to ') THEN 'ok' ELSE '{OD_HINT.replace("'", "''")}' END AS status FROM q""")
def parsed_questions(spark, d):
    phrase = F.concat(F.lit(" "), "p_name", F.lit(" TO 37/"), F.lower("p_type"), F.lit(" to x"))
    asked = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(phrase).alias("t")
    )
    return match.parse_od(asked, "t").drop("t")


@query("c12_fuzzy_stations")
def fuzzy_stations(spark, d):
    """Every part name without its vowel e, matched back to the part names."""
    parts = table(spark, d, "part")
    asked = parts.select("p_partkey", F.replace("p_name", F.lit("e"), F.lit("")).alias("asked"))
    return rounded(match.fuzzy_match(asked, parts, "asked", "p_name", ["p_partkey"]))


COSINE = "round(list_cosine_similarity(q.v, c.v), 12)"


@query("c13_similar_questions", f"""
    WITH q AS (SELECT vec_id, list_reverse(embedding)::DOUBLE[] AS v FROM embeddings),
         c AS (SELECT vec_id AS best_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, best.c AS best_id, round(-best.m, 6) AS score FROM (
        SELECT vec_id, min({{'m': -{COSINE}, 'c': best_id}}) AS best FROM q, c GROUP BY 1)""")
def similar_questions(spark, d):
    """Questions are the vectors read backwards, the corpus the vectors themselves."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.select("vec_id", F.reverse("embedding").alias("embedding"))
    known = vectors.select(F.col("vec_id").alias("best_id"), "embedding")
    return rounded(match.top1_similar(asked, known, "vec_id", "best_id"))


@query("c13_best_answers", f"""
    WITH q AS (SELECT vec_id, list_reverse(embedding)::DOUBLE[] AS v FROM embeddings),
         c AS (SELECT vec_id AS best_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id AS question_id, 'answer ' || best.c AS answer, 'label ' || label AS context, 'general' AS type,
           round(-best.m, 6) AS confidence
    FROM (SELECT vec_id, min({{'m': -{COSINE}, 'c': best_id}}) AS best FROM q, c GROUP BY 1) b
    JOIN (SELECT vec_id AS id, label FROM embeddings) e ON e.id = best.c""")
def best_answers(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("question_id"), F.reverse("embedding").alias("embedding"))
    known = vectors.select(
        F.col("vec_id").alias("corpus_id"), "embedding",
        F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("answer"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("context"),
        F.lit("general").alias("type"),
    )
    return rounded(match.find_best_answer(asked, known).drop("corpus_id"))


@query("c13_substring_answers", """
    SELECT item_id, coalesce(min(doc_id), (SELECT min(doc_id) FROM documents)) AS doc_id,
           CASE WHEN min(doc_id) IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score
    FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY item_id""")
def substring_answers(spark, d):
    return match.substring_match(
        table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text"
    )


@query("c13_text_answers", """
    WITH k AS (SELECT doc_id, text AS t, 'doc ' || doc_id AS answer, lang AS context, source AS type FROM documents),
         h AS (SELECT item_id, min(doc_id) AS hit FROM benchmark b JOIN k ON contains(lower(k.t), lower(b.text)) GROUP BY 1)
    SELECT b.item_id AS question_id, answer, context, type, CASE WHEN hit IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence
    FROM benchmark b LEFT JOIN h USING (item_id) JOIN k ON k.doc_id = coalesce(hit, (SELECT min(doc_id) FROM k))""")
def text_answers(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    known = table(spark, d, "documents").select(
        F.col("doc_id").alias("corpus_id"), F.col("text").alias("question"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("answer"),
        F.col("lang").alias("context"), F.col("source").alias("type"),
    )
    return match.answer_by_text(asked, known).drop("corpus_id", "question")


@query("c12_trip_answers")
def trip_answers(spark, d):
    """The whole question path: parse, match names, route, fare."""
    stations = roles.stops(spark, d).select(F.col("stop_id").alias("id"), "stop_name")
    asked = roles.fares(spark, d).select(
        F.concat(F.lit("suplier#"), F.lpad(F.col("start_station_id").cast("string"), 9, "0"),
                 F.lit(" to Supplier#"), F.lpad(F.col("end_station_id").cast("string"), 9, "0")).alias("question"),
    ).distinct()
    return answer_trip_questions(
        asked, stations, roles.routes(spark, d), roles.trips(spark, d), roles.fares(spark, d),
        fare_order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


@query("c12_known_trip_answers", with_roles("fares trips routes", """
    SELECT 'supplier#' || lpad(f::VARCHAR, 9, '0') || ' to supplier#' || lpad(t::VARCHAR, 9, '0') AS question,
           'ok' AS status, a.s_name AS from_name, b.s_name AS to_name,
           short_name || ' - ' || long_name AS route,
           CASE WHEN hit.r IS NULL THEN 'No direct route found between these stations in the data.' END AS route_note,
           fare_amount, CASE WHEN fare_amount IS NULL THEN 'Fare not available.' END AS fare_note
    FROM (SELECT DISTINCT f, t FROM (SELECT min(l_suppkey) AS f, max(l_suppkey) AS t FROM lineitem GROUP BY l_orderkey))
    JOIN supplier a ON a.s_suppkey = f JOIN supplier b ON b.s_suppkey = t
    LEFT JOIN hits ON hits.from_id = f AND hits.to_id = t LEFT JOIN routes ON routes.route_id = hit.r
    LEFT JOIN priced ON priced.from_id = f AND priced.to_id = t""",
    hits="""SELECT x.start_station_id AS from_id, y.destination_id AS to_id,
               min({'a': x.trip_id, 'b': y.trip_id, 'r': x.route_id}) AS hit
        FROM trips x JOIN trips y ON x.route_id = y.route_id
        WHERE x.start_station_id IS NOT NULL AND y.destination_id IS NOT NULL GROUP BY 1, 2""",
    priced="""SELECT start_station_id AS from_id, end_station_id AS to_id, fare_amount FROM fares
        QUALIFY row_number() OVER (PARTITION BY start_station_id, end_station_id
                                   ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1"""))
def known_trip_answers(spark, d):
    """Questions between stations that exist, in lower case."""
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")
    )
    names = [F.concat(F.lit("supplier#"), F.lpad(F.col(c).cast("string"), 9, "0")) for c in "ab"]
    asked = ends.select(F.concat(names[0], F.lit(" to "), names[1]).alias("question")).distinct()
    stations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("stop_name"))
    return answer_trip_questions(
        asked, stations, roles.routes(spark, d), roles.trips(spark, d), roles.fares(spark, d),
        fare_order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


# --- the question corpus ----------------------------------------------------

def _fill_sql(template: str, columns: dict[str, str]) -> str:
    text = "'" + template.replace("'", "''") + "'"
    for name, sql in columns.items():
        text = f"replace({text}, '{{{name}}}', {sql})"
    return text


STATION_SQL = {
    "name": "name", "address": "coalesce(station_address, 'Located in ' || gtfs_source)", "city": "gtfs_source",
    "vehicle": "'minibus'",
}
ROUTE_SQL = {"name": "short_name", "long_name": "long_name", "city": "source"}


@query("c17_station_questions", with_roles("stations", " UNION ALL ".join(
    f"""SELECT {_fill_sql(q, STATION_SQL)} AS question, {_fill_sql(a, STATION_SQL)} AS answer,
        {_fill_sql('station:{name}, city:{city}, address:{address}', STATION_SQL)} AS context, 'station_info' AS type FROM s"""
    for q, a in STATION_TEMPLATES), s="SELECT * FROM stations"))
def station_questions(spark, d):
    return corpus.station_questions(roles.stations(spark, d))


@query("c17_route_questions", with_roles("routes", " UNION ALL ".join(
    f"""SELECT {_fill_sql(q, ROUTE_SQL)} AS question, {_fill_sql(a, ROUTE_SQL)} AS answer,
        {_fill_sql('route:{name}, city:{city}', ROUTE_SQL)} AS context, 'route_info' AS type FROM r"""
    for q, a in ROUTE_TEMPLATES), r="SELECT * FROM routes"))
def route_questions(spark, d):
    return corpus.route_questions(roles.routes(spark, d), key=["route_id"])


def _draw_sql(side: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', id, pair, {side}, 42)), 1, 13))::BIGINT"


TRIP_SQL = {"name1": "a.name", "name2": "b.name", "city1": "a.gtfs_source", "city2": "b.gtfs_source", "vehicle": "'minibus'"}


@query("c17_trip_questions", with_roles("stations", " UNION ALL ".join(
    f"""SELECT {_fill_sql(q, TRIP_SQL)} AS question, CASE WHEN a.gtfs_source = b.gtfs_source
               THEN {_fill_sql(inside, TRIP_SQL)} ELSE {_fill_sql(between, TRIP_SQL)} END AS answer,
               {_fill_sql('from:{name1}, to:{name2}, city1:{city1}, city2:{city2}', TRIP_SQL)} AS context, 'trip_planning' AS type
        FROM p JOIN stations a ON a.id = p.x JOIN stations b ON b.id = p.y"""
    for q, inside, between in TRIP_TEMPLATES), p=f"""
    SELECT x, y FROM (SELECT pair, arg_min(id, {_draw_sql(1)}) AS x, arg_min(id, {_draw_sql(2)}) AS y
                      FROM stations, range(50) r(pair) GROUP BY 1) WHERE x <> y"""))
def trip_questions(spark, d):
    return corpus.trip_questions(roles.stations(spark, d))


def _general_sql() -> str:
    filled = {"{vehicle}": "minibus", "{service}": "the service", "{country}": "the country"}
    rows = []
    for template in GENERAL_TEMPLATES:
        texts = []
        for text in template:
            for name, value in filled.items():
                text = text.replace(name, value)
            texts.append("'" + text.replace("'", "''") + "'")
        question, answer, context = texts
        rows.append(f"({question}, {answer}, {context}, 'general')")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") g(question, answer, context, type)"


@query("c17_whole_corpus", " UNION ALL ".join(
    f"SELECT question, answer, context, type FROM ({part})"
    for part in (ORACLE["c17_station_questions"], ORACLE["c17_route_questions"], ORACLE["c17_trip_questions"], _general_sql())))
def whole_corpus(spark, d):
    """Questions of all stations, routes and drawn trips, and the general ones."""
    return corpus.generate_questions(roles.stations(spark, d), roles.routes(spark, d))


@query("hvec_similarity", """
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) + 0.0::DOUBLE AS turned,
        round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS squared, round((embedding[1]::DOUBLE + embedding[-1]::DOUBLE) / 2, 6) + 0.0::DOUBLE AS first_mean
    FROM embeddings""")
def similarity(spark, d):
    """Cosine of a vector with its turned self, its square, and the mean of both at the first place."""
    vector, turned = F.col("embedding"), F.reverse("embedding")
    return rounded(table(spark, d, "embeddings").select(
        "vec_id", cosine(vector, turned).alias("turned"), F.round(dot(vector, vector), 5).alias("squared"), F.get(mean_pool(F.array(vector, turned)), F.lit(0)).alias("first_mean")))


CHANNEL = "['whatsapp', 'telegram', 'web', 'api', 'sms'][conv_id % 5 + 1]"
ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _format_sql(template: str, *values: str) -> str:
    pieces = template.split("%s")
    quoted = ["'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in pieces]
    out = quoted[0]
    for value, piece in zip(values, quoted[1:]):
        out += f" || {value} || {piece}"
    return out


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


HELP = HELP_REPLY.replace("{assistant}", "Transit Assistant").replace("{vehicle}", "minibus")
LINES = {k: "'" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in CONFIDENCE_LINES.items()}


@query("b20_answers_per_channel", f"""
    WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'Help' ELSE text END AS question, role || ' <said>' AS answer, (turn % 10) / 10 AS confidence,
                      {CHANNEL} AS channel FROM conversations)
    SELECT conv_id, turn, CASE channel
        WHEN 'whatsapp' THEN CASE WHEN question = 'Help' THEN {_literal(HELP)} ELSE {_format_sql(CHAT_FORMAT, "'Transit Assistant'", "question", "answer",
            f"CASE WHEN confidence > 0.7 THEN {LINES['High']} WHEN confidence > 0.4 THEN {LINES['Medium']} ELSE {LINES['Low']} END")} END
        WHEN 'telegram' THEN {_format_sql(HTML_FORMAT, "'Transit Assistant'", ESCAPED.format('question'), ESCAPED.format('answer'))}
        WHEN 'web' THEN answer
        WHEN 'api' THEN to_json({{'success': true, 'data': {{'question': question, 'answer': answer, 'confidence': confidence}}}})::VARCHAR
        END AS response,
        CASE WHEN channel = 'whatsapp' AND question = 'Help' THEN 'help' WHEN channel <> 'sms' THEN 'answer' END AS response_type,
        CASE WHEN channel = 'sms' THEN 'Unsupported channel: sms; supported: {", ".join(CHANNELS)}' END AS error FROM m""")
def answers_per_channel(spark, d):
    names = F.array(*[F.lit(c) for c in [*CHANNELS, "sms"]])
    messages = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 3, "Help").otherwise(F.col("text")).alias("question"),
        F.concat("role", F.lit(" <said>")).alias("answer"),
        ((F.col("turn") % 10) / 10).alias("confidence"), F.get(names, F.col("conv_id") % 5).alias("channel"),
    )
    return corpus.format_answer(messages, "channel").select(
        "conv_id", "turn", "response", "response_type", "error"
    )
