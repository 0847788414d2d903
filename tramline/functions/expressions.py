"""Column expressions shared by the operators; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -------------------------------------------------------------------

def strip(c: str | Column) -> Column:
    """Remove any whitespace at both ends (``trim`` only knows the blank)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


# Plain decimal numbers; the cast alone would also take "5.5d" or "0x1p3".
NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$"


def number_of(c: str | Column) -> Column:
    """Text to double; anything that is no plain number is null."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def title_case(c: str | Column) -> Column:
    """Upper-case the first letter of every run of letters (``37/airport`` -> ``37/Airport``)."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def html_escape(c: str | Column) -> Column:
    out = col(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


# --- time of day ------------------------------------------------------------

# Hours may pass 24; one- or two-digit minutes and seconds.
CLOCK = r"^\s*\d{1,3}:[0-5]?\d:[0-5]?\d\s*$"


def is_clock(hms: str | Column) -> Column:
    return col(hms).rlike(CLOCK)


def _clock_parts(hms: str | Column) -> tuple[Column, Column, Column]:
    text = F.trim(col(hms), F.lit(" \t\r\n"))
    middle = F.substring_index(F.substring_index(text, ":", 2), ":", -1)
    parts = (F.substring_index(text, ":", 1), middle, F.substring_index(text, ":", -1))
    return tuple(part.try_cast("int") for part in parts)


def seconds_of(hms: str | Column) -> Column:
    """``HH:MM:SS`` text to seconds since the start of the service day, else null."""
    hours, minutes, seconds = _clock_parts(hms)
    return F.when(is_clock(hms), hours * 3600 + minutes * 60 + seconds)


def clock_hour(hms: str | Column) -> Column:
    """Clock hour of ``HH:MM:SS`` text, read from its first part alone."""
    return F.when(is_clock(hms), _clock_parts(hms)[0] % 24)


def hour_of(seconds: str | Column) -> Column:
    """Clock hour of a service-day second count (25:10 is hour 1 of the next day)."""
    return (F.floor(col(seconds) / 3600) % 24).cast("int")


def is_peak(hour: str | Column) -> Column:
    return col(hour).between(7, 9) | col(hour).between(17, 19)


# --- stops and scores -------------------------------------------------------

def stop_type(name: str | Column) -> Column:
    """Case-sensitive; the first keyword wins."""
    name = col(name)
    return (
        F.when(name.contains("Terminal"), "Terminal")
        .when(name.contains("Station"), "Station")
        .otherwise("Regular")
    )


def is_terminal(name: str | Column) -> Column:
    """Ignores case; a missing name is no terminal."""
    return F.coalesce(F.lower(col(name)).contains("terminal"), F.lit(False))


def confidence_band(score: str | Column) -> Column:
    return F.when(col(score) > 0.7, "High").when(col(score) > 0.4, "Medium").otherwise("Low")


# --- geometry and vectors ---------------------------------------------------

def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    chord = (
        F.pow(F.sin((lat2 - lat1) / 2), 2)
        + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    )
    return F.asin(F.least(F.sqrt(chord), F.lit(1.0))) * (2 * EARTH_RADIUS_M)


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_pool(vectors: str | Column) -> Column:
    """Mean over the token axis of an array of equally long vectors."""
    vectors = col(vectors)
    start = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(
        vectors, start, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double"))
    )
    return F.transform(total, lambda x: x / F.size(vectors))


# --- repeatable draws -------------------------------------------------------

DRAW_DIGITS = 13


def draw(*keys: str | Column, seed: int) -> Column:
    """Number in [0, 1) that depends only on the keys and the seed, in any engine with MD5."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    digits = F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("long")
    return digits / float(16**DRAW_DIGITS)
