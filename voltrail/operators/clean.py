"""Cleaning: projection, types, filters and repairs of telemetry rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions import arrays, cells, scalars
from voltrail.operators import rows as R
from voltrail.operators import scan

#: Vendor columns and their standard names.
STANDARD_NAMES = {
    "FAMILY_LABEL": "car_model", "COMMERCIAL_BRAND_COMPONENT_TYP": "manufacturer", "TYPE_OF_TRACTION_CHAIN": "traction_type",
    "EMPTY_WEIGHT_KG": "empty_weight_kg", "DESTINATION_COUNTRY_CODE": "destination_country_code", "BATTERY_TYPE": "battery_type",
    "LEV_BATT_CAPC_HEAL": "battery_health", "CYCLE_ID": "trip_id", "MESS_ID_START": "message_session_id",
    "DATETIME_START": "trip_datetime_start", "DATETIME_END": "trip_datetime_end", "dt": "trip_date",
    "SOC_START": "trip_soc_start", "SOC_END": "trip_soc_end", "ODO_START": "trip_odo_start", "ODO_END": "trip_odo_end",
    "geoindex_10_start": "trip_location_start", "geoindex_10_end": "trip_location_end", "HEAD_COLL_TIMS": "timestamp",
    "PERD_VEHC_LIFT_MILG": "current_odo", "LEV_BATT_LOAD_LEVL": "current_soc", "geoindex_10": "current_location",
    "latitude": "latitude", "longitude": "longitude", "PERD_VEHC_OUTS_TEMP": "outside_temp", "PERD_ALTT": "altitude_array", "PERD_VEHC_LONG_SPD": "speed_array",
}
#: Columns that hold one value for a whole trip.
STATIC = (
    "car_model", "manufacturer", "traction_type", "empty_weight_kg", "destination_country_code", "battery_type", "message_session_id",
    "trip_datetime_start", "trip_datetime_end", "trip_date", "trip_soc_start", "trip_soc_end", "trip_odo_start", "trip_odo_end",
    "trip_location_start", "trip_location_end",
)
#: Ranges of scalar columns, in the order in which they are checked.
RANGES = {"current_soc": (0, 100), "outside_temp": (-15, 46), "current_odo": (0, 1_000_000), "empty_weight_kg": (950, 4000)}
SPEED_RANGE, ALTITUDE_RANGE, HEALTH_RANGE = (0, 250), (-300, 3375), (50, 100)


def rename_prune(df: DataFrame, names: Mapping[str, str] = STANDARD_NAMES) -> DataFrame:
    """Only the columns that the map knows, under their standard names; `src_row_id` stays."""
    return df.select(*(F.col(k).alias(v) for k, v in names.items() if k in df.columns), *([R.TIE] if R.TIE in df.columns else []))


def parse_timestamps(df: DataFrame, column: str = R.TIME) -> DataFrame:
    """Rows whose time can be read."""
    return df.withColumn(column, F.col(column).cast("string").try_cast("timestamp")).where(F.col(column).isNotNull())


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(R.TIE).limit(n)


def exclude_trips(df: DataFrame, trips: Sequence[object]) -> DataFrame:
    return df.where(~F.col(R.TRIP).isin(list(trips))) if trips else df


def with_positions(df: DataFrame, column: str = "current_location") -> DataFrame:
    """Adds latitude and longitude of the grid cell that a column names; null where it names none. Without the column the rows stay as they are."""
    if column not in df.columns:
        return df
    return df.withColumn("_cell", cells.cell_center(F.col(column))).withColumns({"latitude": F.col("_cell.latitude"), "longitude": F.col("_cell.longitude")}).drop("_cell")


def valid_positions(df: DataFrame) -> DataFrame:
    lat, lon = scalars.number(F.col("latitude")), scalars.number(F.col("longitude"))
    return df.withColumns({"latitude": lat, "longitude": lon}).where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def _at_zero() -> Column:
    return scalars.near(F.col("latitude")) & scalars.near(F.col("longitude"))


def drop_mostly_zero_trips(df: DataFrame, share: float = 0.75) -> DataFrame:
    """Without trips of which more than `share` of the rows lie near (0, 0)."""
    placed = scan.over_trips(df, _zero=scan.whole_sum(R.flag(_at_zero())), _rows=scan.whole_sum(F.lit(1)))
    return placed.where(F.col("_zero") / F.col("_rows") <= share).drop("_zero", "_rows")


def drop_zero_points(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(_at_zero(), F.lit(False)))


def in_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Rows with every column in its range; missing values pass."""
    for c, (low, high) in ranges.items():
        v = scalars.number(F.col(c))
        df = df.where(v.isNull() | v.between(low, high))
    return df


def arrays_in_range(df: DataFrame, column: str = "altitude_array", limits: tuple[float, float] = ALTITUDE_RANGE) -> DataFrame:
    return df.where(~arrays.any_outside(F.col(column), *limits))


def trips_out_of_range(df: DataFrame, column: str = "speed_array", limits: tuple[float, float] = SPEED_RANGE) -> DataFrame:
    """Trips with an element out of range."""
    return df.where(arrays.any_outside(F.col(column), *limits)).select(R.TRIP).distinct()


def drop_trips(df: DataFrame, trips: DataFrame) -> DataFrame:
    return df.join(trips.select(R.TRIP).distinct(), R.TRIP, "left_anti")


def repair_health(df: DataFrame, limits: tuple[float, float] = HEALTH_RANGE, column: str = "battery_health") -> DataFrame:
    """Values out of range become the next good one of the trip, else the one before; other trips stay as they are."""
    c = F.col(column)
    bad = c.isNotNull() & ~c.between(*limits)
    good = F.when(c.between(*limits), c)
    placed = scan.over_trips(df, _next=scan.following(good), _last=scan.last(good), _bad=scan.most(R.flag(bad)))
    return placed.withColumn(column, F.when(F.col("_bad") == 1, F.coalesce(good, "_next", "_last")).otherwise(c)).drop("_next", "_last", "_bad")


def trips_within(df: DataFrame, duration: tuple[float, float], distance: tuple[float, float]) -> DataFrame:
    """Rows of trips strictly between the limits of `trip_duration` and `trip_distance`."""
    inside = lambda c, lim: (F.col(c) > lim[0]) & (F.col(c) < lim[1])
    return df.where(inside("trip_duration", duration) & inside("trip_distance", distance))


def keep_first(df: DataFrame, keys: Sequence[str] = (R.TRIP, R.TIME)) -> DataFrame:
    """The first row by input order of each key."""
    w = Window.partitionBy(*keys).orderBy(R.TIE)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def inconsistent_trips(df: DataFrame, columns: Sequence[str] = STATIC) -> DataFrame:
    """Trips in which a static column has more than one value."""
    present = [c for c in columns if c in df.columns]
    spread = df.groupBy(R.TRIP).agg(*((F.min(c) != F.max(c)).alias(c) for c in present))
    return spread.where(" or ".join(f"coalesce(`{c}`, false)" for c in present) or "false").select(R.TRIP)


def redundant_id(df: DataFrame, secondary: str = "message_session_id", primary: str = R.TRIP) -> bool:
    """Whether a second id never takes two values within one primary id."""
    several = df.groupBy(primary).agg((F.min(secondary) != F.max(secondary)).alias("s")).where("s")
    return several.isEmpty()


def constant_columns(df: DataFrame) -> DataFrame:
    """column, is_constant: exactly one value, a null counting as one; arrays are left out. One pass."""
    scalar = [c for c, t in df.dtypes if not t.startswith("array")]
    row = df.agg(*(((F.coalesce((F.min(c) != F.max(c)).cast("int"), F.lit(-1)) + F.max(F.col(c).isNull().cast("int"))) == 0).alias(c) for c in scalar))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias("is_constant")) for c in scalar))).alias("x")).select("x.*")


def skipped_rows(df: DataFrame, seconds: int = 60) -> DataFrame:
    """`skipped`: rows between two that are a minute apart, one or two of them."""
    us = F.unix_micros(F.col(R.TIME).cast("timestamp"))
    near = scan.over_trips(df, _back1=scan.lag(us), _ahead1=scan.lead(us))
    near = scan.over_trips(near, _back2=scan.lag("_back1"), _ahead2=scan.lead("_ahead1"))
    apart = lambda ahead, back: R.flag(F.col(f"_ahead{ahead}") - F.col(f"_back{back}") == seconds * 1_000_000)
    return near.withColumn("skipped", F.greatest(apart(1, 1), apart(2, 1), apart(1, 2))).drop("_back1", "_back2", "_ahead1", "_ahead2")


def drop_skipped(df: DataFrame, seconds: int = 60) -> DataFrame:
    return skipped_rows(df, seconds).where("skipped = 0").drop("skipped")


def out_of_range_report(df: DataFrame, column: str, limits: tuple[float, float]) -> DataFrame:
    """Per trip with any: rows and samples out of range, their shares, and how many runs of such rows."""
    n = arrays.count_outside(F.col(column), *limits)
    marked = df.withColumn("_n", n).withColumn("_bad", (n > 0).cast("int"))
    marked = scan.over_trips(marked, _before=scan.lag("_bad"))
    marked = marked.withColumn("_start", F.when((F.col("_bad") == 1) & (F.coalesce("_before", F.lit(0)) == 0), 1).otherwise(0))
    out = marked.groupBy(R.TRIP).agg(
        F.sum("_bad").alias("bad_rows"), F.count("*").alias("rows"), F.sum("_n").alias("bad_samples"),
        F.sum(F.greatest(F.lit(0), arrays.length(F.col(column)))).alias("samples"), F.sum("_start").alias("blocks"),
    )
    return out.where("bad_rows > 0").withColumn("bad_row_pct", F.round(100 * F.col("bad_rows") / F.col("rows"), 6))


def wrong_lengths(df: DataFrame, column: str, expected: int) -> DataFrame:
    """Rows whose array has another length; rows without an array don't count."""
    return df.where((arrays.length(F.col(column)) != expected) & F.col(column).isNotNull())
