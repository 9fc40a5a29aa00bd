"""Scalar column functions. All are null where an input is null, and none raises on bad values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
TINY = 1e-6


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def safe_div(a: Column, b: Column, least: float = TINY) -> Column:
    """a / b; null where |b| is at most `least`."""
    return F.when(F.abs(b) > least, a / b)


def div_or_zero(a: Column, b: Column, least: float = TINY) -> Column:
    return F.when(b > least, a / b).otherwise(F.lit(0.0))


def clean_text(c: Column) -> Column:
    """White space to one space, then each run of non-ASCII characters to a space, then trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\x00-\x7F]+", " "))


def near(c: Column, value: float = 0.0, tolerance: float = 1e-3) -> Column:
    return F.abs(c - value) <= tolerance


def number(c: Column) -> Column:
    return c.try_cast("double")


def no_nan(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def mps(kph: Column) -> Column:
    return kph * 1000 / 3600


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def equal_bins(c: Column, low: float, high: float, bins: int = 5) -> Column:
    """The bin, 1 to `bins`, of bins as wide as each other; closed on the right, the first on both sides."""
    step = (high - low) / bins
    return F.when((c >= low) & (c <= high), F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((c - low) / step).cast("int"))))


def coordinates(points: Column) -> Column:
    """`lon,lat;lon,lat` of an array of structs, six decimals each."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"])), ";")


def temperature_suspect(vehicle: Column, weather: Column, most: float = 5.0) -> Column:
    """Whether two temperatures differ by more than `most`; False where either is missing."""
    return F.coalesce(F.abs(vehicle - weather) > most, F.lit(False))


def start_parts(ts: Column) -> dict[str, Column]:
    """Hour, day of the week (Monday 0) and month."""
    return {"hour": F.hour(ts), "dayofweek": F.weekday(ts), "month": F.month(ts)}
