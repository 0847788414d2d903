"""The question corpus: generation, checks, formatting per channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.expressions import col, confidence_band, draw, html_escape
from tramline.functions.fixed_values import (
    CHANNELS, CHAT_FORMAT, CONFIDENCE_LINES, GENERAL_TEMPLATES, HELP_REPLY, HTML_FORMAT, ROUTE_TEMPLATES, STATION_TEMPLATES,
    TRIP_TEMPLATES,
)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its ``{placeholders}`` replaced by columns."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        pieces += [F.lit(before), values[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def _expand(df: DataFrame, pairs: Sequence[tuple[Column, Column]], context: Column, kind: str) -> DataFrame:
    rows = F.array(*[F.struct(q.alias("question"), a.alias("answer")) for q, a in pairs])
    return df.select(context.alias("context"), F.explode(rows).alias("qa")).select(
        "qa.question", "qa.answer", "context", F.lit(kind).alias("type")
    )


def station_questions(
    stations: DataFrame, key: Sequence[str] = ("id",), limit: int | None = None, vehicle: str = "minibus"
) -> DataFrame:
    """Eight questions per station; with ``limit``, for that many first stations only."""
    chosen = stations.orderBy(*key).limit(limit) if limit else stations
    city = F.coalesce("gtfs_source", F.lit("Unknown City"))
    values = {
        "name": F.coalesce("name", F.lit("Unknown Station")),
        "city": city,
        "address": F.coalesce("station_address", F.concat(F.lit("Located in "), city)),
        "vehicle": F.lit(vehicle),
    }
    pairs = [(fill(q, values), fill(a, values)) for q, a in STATION_TEMPLATES]
    context = fill("station:{name}, city:{city}, address:{address}", values)
    return _expand(chosen, pairs, context, "station_info")


def route_questions(routes: DataFrame, key: Sequence[str] = ("id",), limit: int | None = None) -> DataFrame:
    """Five questions per route; with ``limit``, for that many first routes only."""
    chosen = routes.orderBy(*key).limit(limit) if limit else routes
    values = {"name": col("short_name"), "long_name": col("long_name"), "city": col("source")}
    pairs = [(fill(q, values), fill(a, values)) for q, a in ROUTE_TEMPLATES]
    return _expand(chosen, pairs, fill("route:{name}, city:{city}", values), "route_info")


def drawn_pairs(stations: DataFrame, pairs: int = 50, seed: int = 42, key: str = "id") -> DataFrame:
    """``pairs`` random draws of two stations; draws of the same station twice drop out.

    A draw picks the station with the smallest hash of (station, draw, side): a uniform
    choice that needs no numbering of the stations, as a plain aggregate.  The names of
    the few picked stations are joined afterwards.
    """
    def choice(side: int) -> Column:
        return F.min_by(key, draw(key, "pair", F.lit(side), seed=seed))

    tickets = stations.select(key, F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("pair"))
    picked = tickets.groupBy("pair").agg(choice(1).alias("first"), choice(2).alias("second"))
    named = F.struct(F.col(key).alias("id"), "name", "gtfs_source")
    return (
        F.broadcast(picked.filter(F.col("first") != F.col("second")))
        .join(stations.select(F.col(key).alias("first"), named.alias("a")), "first")
        .join(stations.select(F.col(key).alias("second"), named.alias("b")), "second")
    )


def trip_questions(
    stations: DataFrame, pairs: int = 50, seed: int = 42, vehicle: str = "minibus", key: str = "id"
) -> DataFrame:
    """Five questions per drawn pair, worded by whether both lie in one city."""
    values = {
        "name1": col("a.name"), "name2": col("b.name"),
        "city1": col("a.gtfs_source"), "city2": col("b.gtfs_source"), "vehicle": F.lit(vehicle),
    }
    same_city = F.col("a.gtfs_source") == F.col("b.gtfs_source")
    rows = [
        (fill(q, values), F.when(same_city, fill(inside, values)).otherwise(fill(between, values)))
        for q, inside, between in TRIP_TEMPLATES
    ]
    context = fill("from:{name1}, to:{name2}, city1:{city1}, city2:{city2}", values)
    return _expand(drawn_pairs(stations, pairs, seed, key), rows, context, "trip_planning")


def general_questions(
    spark: SparkSession, vehicle: str = "minibus", service: str = "the service", country: str = "the country"
) -> DataFrame:
    """Five questions about the service itself."""
    values = {"{vehicle}": vehicle, "{service}": service, "{country}": country}

    def filled(text: str) -> str:
        for name, value in values.items():
            text = text.replace(name, value)
        return text

    rows = [(filled(q), filled(a), context, "general") for q, a, context in GENERAL_TEMPLATES]
    return spark.createDataFrame(rows, "question string, answer string, context string, type string")


def generate_questions(
    stations: DataFrame, routes: DataFrame, limit: int | None = None, pairs: int = 50, seed: int = 42,
    vehicle: str = "minibus", service: str = "the service", country: str = "the country",
) -> DataFrame:
    """The whole training corpus: stations, routes, trips and general questions."""
    return (
        station_questions(stations, limit=limit, vehicle=vehicle)
        .unionByName(route_questions(routes, limit=limit))
        .unionByName(trip_questions(stations, pairs, seed, vehicle))
        .unionByName(general_questions(stations.sparkSession, vehicle, service, country))
    )


# --- checks -----------------------------------------------------------------

def is_bad_pair(required: Sequence[str] = ("question", "answer")) -> Column:
    bad = F.lit(False)
    for c in required:
        bad = bad | F.coalesce(F.col(c) == "", F.lit(True))
    return bad


def validate_pairs(df: DataFrame, required: Sequence[str] = ("question", "answer")) -> DataFrame:
    """Counts and the verdict: one bad pair, or none at all, rejects the whole batch."""
    return df.agg(
        F.count("*").alias("pairs"), F.count_if(is_bad_pair(required)).alias("bad")
    ).withColumn("accepted", (F.col("pairs") > 0) & (F.col("bad") == 0))


def split_pairs(df: DataFrame, required: Sequence[str] = ("question", "answer")) -> tuple[DataFrame, DataFrame]:
    bad = is_bad_pair(required)
    return df.filter(~bad), df.filter(bad)


# --- answers per channel ----------------------------------------------------

def format_answer(
    df: DataFrame, channel: str | Column, assistant: str = "Transit Assistant", vehicle: str = "minibus"
) -> DataFrame:
    """Add ``response``, ``response_type`` and ``error`` for the channel of each row.

    ``whatsapp`` gets chat markup with a confidence line, or the help text when asked
    for ``help``; ``telegram`` escaped HTML, ``web`` the bare answer, ``api`` a JSON
    document.  Another channel is an error row that lists the supported ones.
    """
    channel = col(channel)
    help_text = HELP_REPLY.replace("{assistant}", assistant).replace("{vehicle}", vehicle)
    helped = (channel == "whatsapp") & (F.lower("question") == "help")
    band = confidence_band("confidence")
    line = F.when(band == "High", CONFIDENCE_LINES["High"]).when(
        band == "Medium", CONFIDENCE_LINES["Medium"]
    ).otherwise(CONFIDENCE_LINES["Low"])
    chat = F.format_string(CHAT_FORMAT, F.lit(assistant), F.col("question"), F.col("answer"), line)
    html = F.format_string(HTML_FORMAT, F.lit(assistant), html_escape("question"), html_escape("answer"))
    api = F.to_json(F.struct(
        F.lit(True).alias("success"),
        F.struct(*[c for c in ("question", "answer", "confidence", "context", "type") if c in df.columns]).alias("data"),
    ))
    supported = channel.isin(CHANNELS)
    return df.withColumns({
        "response": F.when(helped, help_text).when(channel == "whatsapp", chat).when(channel == "telegram", html)
        .when(channel == "web", F.col("answer")).when(channel == "api", api),
        "response_type": F.when(helped, "help").when(supported, "answer"),
        "error": F.when(
            ~F.coalesce(supported, F.lit(False)),
            F.concat(F.lit("Unsupported channel: "), F.coalesce(channel, F.lit("null")),
                     F.lit("; supported: " + ", ".join(CHANNELS))),
        ),
    })
