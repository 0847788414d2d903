"""Distances, nearby stops and areas without service.

Nearby search is an equi join on grid cells.  A cell is one search radius high and at
least one wide at its latitude, so a stop can only be near points of its own and the
surrounding cells.  Stops are copied to those cells, points stay single, and stops or
points at the same spot are folded into one place before they meet.  Cells with more
than a thousandth of all points are split over several tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.expressions import EARTH_RADIUS_M, haversine
from tramline.session import is_broadcast_size

# A cell is hot with more than 1/HOT_SHARE of all points and is dealt out to at most
# MAX_SPLITS tasks.  Places are folded to BOXES x BOXES boxes per cell.
HOT_SHARE = 1_000
MAX_SPLITS = 64
BOXES = 8


def with_length(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Straight-line length in metres between two ends with ``_lat`` and ``_lon`` columns."""
    return df.withColumn(
        "length_m", haversine(f"{start}_lat", f"{start}_lon", f"{end}_lat", f"{end}_lon")
    )


def _band(lat: Column, step: float) -> Column:
    return F.floor(lat / step)


def _cells_round(band: Column, step: float, metres: float) -> Column:
    """Number of cells around the globe in a latitude band, each at least the radius wide."""
    steepest = F.least(
        F.greatest(F.abs(band - 1), F.abs(band + 2)) * step, F.lit(89.9)
    )
    half = math.sin(metres / (2 * EARTH_RADIUS_M))
    width = F.degrees(F.asin(F.least(F.lit(half) / F.cos(F.radians(steepest)), F.lit(1.0))) * 2)
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))


def _cell(lon: Column, cells: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * cells)


def _meet(points: DataFrame, places: DataFrame, near: Column, how: str = "inner") -> DataFrame:
    """Join points and places of one cell.

    Places that measure small are broadcast and the points stay where they are.
    Otherwise the points of a hot cell are dealt out to several parts, each of which
    sees all places of the cell.  At most ``HOT_SHARE`` cells can hold more than that
    share of the points, which bounds the list of hot cells.
    """
    if is_broadcast_size(places):
        p, s = points.alias("p"), F.broadcast(places).alias("s")
        same = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in ("band", "cell")]
        return p.join(s, same[0] & same[1] & near, how)
    total = points.agg(F.count("*").alias("n")).scalar()
    share = F.ceil(F.col("n") * HOT_SHARE / total)
    hot = F.broadcast(
        points.groupBy("band", "cell").agg(F.count("*").alias("n"))
        .filter(F.col("n") * HOT_SHARE > total)
        .select("band", "cell", F.least(share, F.lit(MAX_SPLITS)).cast("int").alias("splits"))
    )
    splits = F.coalesce("splits", F.lit(1))
    dealt = points.join(hot, ["band", "cell"], "left").withColumn(
        "part", F.pmod(F.xxhash64("lat", "lon"), splits).cast("int")
    ).drop("splits")
    copied = places.join(hot, ["band", "cell"], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), splits - 1))
    ).drop("splits")
    # Few bytes may mean many comparisons here, so the number of tasks is set by hand and
    # not derived from the size.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = dealt.repartition(tasks, "band", "cell", "part").alias("p")
    s = copied.repartition(tasks, "band", "cell", "part").alias("s")
    same = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in ("band", "cell", "part")]
    return p.join(s, same[0] & same[1] & same[2] & near, how)


def _points_on_grid(points: DataFrame, metres: float) -> DataFrame:
    step = math.degrees(metres / EARTH_RADIUS_M)
    band = _band(F.col("lat"), step)
    cells = _cells_round(band, step, metres)
    return points.withColumns({
        "band": band.cast("long"), "cell": F.pmod(_cell(F.col("lon"), cells), cells).cast("long"),
    })


def _with_own_band(places: DataFrame, metres: float) -> DataFrame:
    step = math.degrees(metres / EARTH_RADIUS_M)
    return places.withColumn("own_band", _band(F.col("place_lat"), step).cast("long"))


def _stops_on_grid(
    places: DataFrame, metres: float, west: str = "place_lon", east: str = "place_lon"
) -> DataFrame:
    """Copies of each place, or box from ``west`` to ``east``, for all cells it may be near to."""
    step = math.degrees(metres / EARTH_RADIUS_M)
    own = F.col("own_band")
    spread = places.withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
    cells = _cells_round(F.col("band"), step, metres)
    first, last = _cell(F.col(west), cells) - 1, _cell(F.col(east), cells) + 1
    around = F.transform(F.sequence(first, last), lambda c: F.pmod(c, cells).cast("long"))
    return spread.withColumn("cell", F.explode(F.array_distinct(around))).drop("own_band")


def _places(stops: DataFrame) -> DataFrame:
    return stops.groupBy(F.col("stop_lat").alias("place_lat"), F.col("stop_lon").alias("place_lon")).agg(
        F.count("*").alias("stops_here"), F.min("stop_id").alias("place_stop")
    )


def _distance() -> Column:
    return haversine("lat", "lon", "place_lat", "place_lon")


def near_stops(
    points: DataFrame, stops: DataFrame, metres: float, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Points with a stop within ``metres``: how many, the nearest one and its distance."""
    spots = points.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).dropna().distinct()
    places = _stops_on_grid(_with_own_band(_places(stops), metres), metres)
    answers = (
        _meet(_points_on_grid(spots, metres), places, _distance() <= metres)
        .withColumn("metres", _distance())
        .groupBy("lat", "lon")
        .agg(
            F.sum("stops_here").alias("n_near"),
            # Distances that agree to the millimetre tie; the lower stop id wins.
            F.min(F.struct(F.round("metres", 3).alias("metres"), "place_stop")).alias("nearest"),
        )
        .select(
            F.col("lat").alias(lat), F.col("lon").alias(lon), "n_near",
            F.col("nearest.place_stop").alias("nearest_stop"), F.col("nearest.metres").alias("nearest_m"),
        )
    )
    return points.join(answers, [lat, lon])


def _boxes(places: DataFrame, metres: float) -> DataFrame:
    """Places with the eighth of a cell they lie in."""
    step = math.degrees(metres / EARTH_RADIUS_M)
    cells = _cells_round(F.col("own_band"), step, metres)
    return places.withColumns({
        "box_row": F.floor(F.col("place_lat") / (step / BOXES)).cast("long"),
        "box_column": _cell(F.col("place_lon"), cells * BOXES).cast("long"),
    })


def near_duplicates(stops: DataFrame, metres: float) -> DataFrame:
    """Stops with another stop within ``metres``, and how many.

    A box of places wholly within reach counts at once; only boxes that the circle cuts
    are opened.  A cluster of a million stops around one corner is thus a single box to
    all its members.
    """
    step = math.degrees(metres / EARTH_RADIUS_M)
    places = _boxes(_with_own_band(_places(stops), metres), metres)
    box = ["own_band", "box_row", "box_column"]
    folded = places.groupBy(*box).agg(
        F.sum("stops_here").alias("stops_here"), F.count("*").alias("places_here"),
        F.min("place_lat").alias("south"), F.max("place_lat").alias("north"),
        F.min("place_lon").alias("west"), F.max("place_lon").alias("east"),
    )
    corners = [haversine("lat", "lon", a, b) for a in ("south", "north") for b in ("west", "east")]
    narrow = F.greatest(F.abs(F.col("lon") - F.col("west")), F.abs(F.col("lon") - F.col("east"))) < 90
    one = F.col("places_here") == 1
    whole = F.when(one, corners[0] <= metres).otherwise(narrow & (F.greatest(*corners) <= metres * 0.999))
    beyond = (F.col("south") - F.col("lat") > step * 1.001) | (F.col("lat") - F.col("north") > step * 1.001)
    spots = places.select(F.col("place_lat").alias("lat"), F.col("place_lon").alias("lon"))
    copies = _stops_on_grid(folded.withColumn("box_band", F.col("own_band")), metres, "west", "east")
    met = _meet(
        _points_on_grid(spots, metres), copies.withColumnRenamed("box_band", "own_band"), ~beyond & (whole | ~one)
    ).select("lat", "lon", *box, "stops_here", whole.alias("whole"))
    counted = met.filter("whole").groupBy("lat", "lon").agg(F.sum("stops_here").alias("n"))
    opened = (
        met.filter("NOT whole").select("lat", "lon", *box).join(places, box)
        .filter(_distance() <= metres)
        .groupBy("lat", "lon").agg(F.sum("stops_here").alias("n"))
    )
    answers = (
        counted.unionByName(opened).groupBy("lat", "lon")
        .agg((F.sum("n") - 1).alias("n_near")).filter("n_near > 0")
        .select(F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"), "n_near")
    )
    return stops.join(answers, ["stop_lat", "stop_lon"])


def coverage_gaps(
    areas: DataFrame, stops: DataFrame, metres: float, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Areas whose centre has no stop within ``metres``; areas without a centre are left out."""
    spots = areas.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).dropna().distinct()
    places = _stops_on_grid(_with_own_band(_places(stops), metres), metres)
    gaps = _meet(_points_on_grid(spots, metres), places, _distance() <= metres, "left_anti")
    return areas.join(gaps.select(F.col("lat").alias(lat), F.col("lon").alias(lon)), [lat, lon], "left_semi")
