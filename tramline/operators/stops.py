"""Stations, stops and the city scope of a network."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.expressions import col, is_peak, is_terminal, number_of, stop_type


@dataclass(frozen=True)
class Network:
    """The tables of one transit network; any of them may be absent."""

    stations: DataFrame | None = None
    routes: DataFrame | None = None
    trips: DataFrame | None = None
    fares: DataFrame | None = None


def _same_city(column: str, city: str, ignore_case: bool) -> Column:
    if ignore_case:
        return F.lower(F.col(column)) == city.lower()
    return F.col(column) == city


def filter_city(
    network: Network, city: str | None, ends: str = "both", ignore_case: bool = False
) -> Network:
    """Keep one city: trips follow their route, fares their stations.

    ``ends`` says whether a fare must start and end in the city (``both``) or only
    start there (``start``).  No city keeps everything.
    """
    if not city:
        return network
    if ends not in ("both", "start"):
        raise ValueError("ends must be 'both' or 'start'")
    stations = network.stations.filter(_same_city("gtfs_source", city, ignore_case))
    scoped = replace(network, stations=stations)
    if network.routes is not None:
        routes = network.routes.filter(_same_city("source", city, ignore_case))
        scoped = replace(scoped, routes=routes)
        if network.trips is not None:
            keys = routes.select(F.col("id").alias("route_id"))
            scoped = replace(scoped, trips=network.trips.join(keys, "route_id", "left_semi"))
    if network.fares is not None:
        fares = network.fares
        for end in ("start_station_id", "end_station_id")[: 2 if ends == "both" else 1]:
            fares = fares.join(stations.select(F.col("id").alias(end)), end, "left_semi")
        scoped = replace(scoped, fares=fares)
    return scoped


def normalise_stops(
    df: DataFrame,
    lat: str = "station_latitude",
    lon: str = "station_longitude",
    id_columns: Sequence[str] = ("gtfs_stop_id", "id"),
    name: str = "name",
    strict: bool = False,
) -> DataFrame:
    """Add ``stop_id, stop_name, stop_lat, stop_lon, coordinates``; drop unlocated rows.

    A coordinate that is no number becomes null, or fails the job when ``strict``.
    """

    def number(column: str) -> Column:
        text = F.col(column).cast("string")
        value = number_of(text)
        if strict:
            message = F.concat(F.lit(f"{column} is not a number: "), text)
            value = F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value)
        return value

    located = df.withColumns({
        "stop_id": F.coalesce(*[F.col(c).cast("string") for c in id_columns]),
        "stop_name": F.col(name),
        "stop_lat": number(lat),
        "stop_lon": number(lon),
    }).dropna(subset=["stop_lat", "stop_lon"])
    return located.withColumn(
        "coordinates", F.struct(F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    )


def rename_routes(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"short_name": "route_short_name", "long_name": "route_long_name"})


def bus_stops(df: DataFrame, flag: str = "is_bus_stop") -> DataFrame:
    return df.filter(F.col(flag))


def search_text(
    df: DataFrame, columns: Sequence[str], query: str, order_by: Sequence[str],
    limit: int = 20, escape: bool = False,
) -> DataFrame:
    """First ``limit`` rows in ``order_by`` order where any column contains ``query``.

    Case is ignored.  ``%`` and ``_`` are wildcards unless ``escape``.
    """
    hit = F.lit(False)
    for column in columns:
        if escape:
            hit = hit | F.lower(F.col(column)).contains(query.lower())
        else:
            hit = hit | F.col(column).ilike(f"%{query}%")
    return df.filter(hit).orderBy(*order_by).limit(limit)


def require_endpoints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop trips or fares that lack one of their stations."""
    return df.dropna(subset=list(columns))


def with_peak_flag(df: DataFrame, hour: str | Column) -> DataFrame:
    return df.withColumn("is_peak", is_peak(hour))


def with_stop_type(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns({"stop_type": stop_type(name), "is_terminal": is_terminal(name)})


def terminal_counts(df: DataFrame, name: str) -> DataFrame:
    terminal = is_terminal(name)
    return df.agg(
        F.count_if(terminal).alias("terminal_stops"), F.count_if(~terminal).alias("regular_stops")
    )


def name_pattern_counts(df: DataFrame, name: str) -> DataFrame:
    """How many route names are upper-case alphanumeric, and how many only letters."""
    return df.agg(
        F.count_if(col(name).rlike("^[A-Z0-9]+$")).alias("alphanumeric"),
        F.count_if(col(name).rlike("^[A-Z]+$")).alias("letters"),
    )


def with_source(df: DataFrame, source: str = "source") -> DataFrame:
    """A trip without a route comes from ``unknown``."""
    return df.withColumn(source, F.coalesce(F.col(source), F.lit("unknown")))
