"""Rules between neighbouring rows and samples: gaps, monotonic sequences, steps, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions import arrays, scalars
from voltrail.operators import rows as R
from voltrail.operators import scan


def gap_flags(df: DataFrame, low: float = 59, high: float = 61, name: str = "is_start_after_gap") -> DataFrame:
    """1 on a row whose time since the one before is positive and outside [low, high] seconds."""
    us = F.unix_micros(F.col(R.TIME).cast("timestamp"))
    dt = (us - F.col("_us")) / F.lit(1e6)
    return scan.over_trips(df, _us=scan.lag(us)).withColumn(name, R.flag((dt > 0) & ~dt.between(low, high))).drop("_us")


def falls(df: DataFrame, column: str, tolerance: float = 0.0, name: str = "falls") -> DataFrame:
    """1 where a column that should not fall lies below the last value before it; missing values are passed over."""
    return scan.over_trips(df, _last=scan.last(column)).withColumn(name, R.flag(F.col(column) - F.col("_last") < -tolerance)).drop("_last")


def rises(df: DataFrame, column: str, tolerance: float = 0.0, name: str = "rises") -> DataFrame:
    return scan.over_trips(df, _last=scan.last(column)).withColumn(name, R.flag(F.col(column) - F.col("_last") > tolerance)).drop("_last")


def first_violation(df: DataFrame, flag: str) -> DataFrame:
    """Adds row_no and first_violation, the row_no of the trip's first flagged row."""
    numbered = scan.over_trips(df, row_no=scan.row_no())
    return scan.over_trips(numbered, first_violation=scan.least(F.when(F.col(flag) == 1, F.col("row_no"))))


def sequence_report(df: DataFrame, column: str, upwards: bool, tolerance: float = 0.0) -> DataFrame:
    """Per trip with any: the first violating row, its value, the one before it, and how many there are."""
    numbered = scan.over_trips(df, _before=scan.last(column), row_no=scan.row_no())
    step = (F.col(column) - F.col("_before")) * (1 if upwards else -1)
    return numbered.where(step < -tolerance).groupBy(R.TRIP).agg(
        F.min("row_no").alias("violation_row"), F.min_by("_before", "row_no").alias("value_before"),
        F.min_by(F.col(column), "row_no").alias("value"), F.count("*").alias("violations"),
    )


def repair_sequences(df: DataFrame, odo: str = "current_odo", health: str = "battery_health") -> DataFrame:
    """Drops the trip's first row at which the odometer falls; from the first rise of health on, health keeps its last value before.

    Both are decided on the rows as they were.
    """
    flagged = scan.over_trips(df, _odo=scan.last(odo), _health=scan.last(health), _n=scan.row_no())
    at = {"_odo_at": F.col(odo) < F.col("_odo"), "_health_at": F.col(health) > F.col("_health")}
    placed = scan.over_trips(flagged, **{k: scan.least(F.when(c, F.col("_n"))) for k, c in at.items()})
    placed = scan.over_trips(placed, _good=scan.last(F.when(F.col("_n") < F.col("_health_at"), F.col(health))))
    fixed = placed.withColumn(health, F.when(F.col("_n") >= F.col("_health_at"), F.col("_good")).otherwise(F.col(health)))
    return fixed.where("_odo_at is null or _n <> _odo_at").drop("_odo", "_health", "_n", "_odo_at", "_health_at", "_good")


def _outside(diff: Column, low: float, high: float, mode: str) -> Column:
    """Which differences break a limit: of rises (pos), of falls' sizes (neg), or of both."""
    size = {"pos": F.when(diff > 0, diff), "neg": F.when(diff < 0, -diff), "both": F.abs(diff)}[mode]
    return (size < low) | (size > high)


def step_violations(df: DataFrame, column: str, low: float, high: float, mode: str = "both", kind: str = "scalar", skip_gaps: bool = False) -> DataFrame:
    """A row for each step between neighbouring rows that breaks a limit. kind: scalar, time, or array (first sample less the last before)."""
    c = F.col(column)
    now, then = {"time": (scalars.seconds(c), scalars.seconds(c)), "array": (arrays.first(c), arrays.last(c))}.get(kind, (c, c))
    placed = scan.over_trips(df, row_no=scan.row_no(), value_before=scan.lag(then)).withColumn("value", now).withColumn("diff", F.col("value") - F.col("value_before"))
    bad = _outside(F.col("diff"), low, high, mode)
    if skip_gaps:
        bad = bad & (F.coalesce(F.col("is_start_after_gap"), F.lit(0)) == 0)
    return placed.where(bad).select(R.TRIP, F.lit(column).alias("column"), "row_no", "value_before", "value", "diff")


def sample_violations(df: DataFrame, column: str, low: float, high: float, mode: str = "both") -> DataFrame:
    """A row for each step between neighbouring samples of one array that breaks a limit."""
    placed = scan.over_trips(df, row_no=scan.row_no()).select(R.TRIP, "row_no", F.posexplode(arrays.steps(F.col(column))).alias("i", "diff"))
    return placed.where(_outside(F.col("diff"), low, high, mode)).select(R.TRIP, F.lit(column).alias("column"), "row_no", (F.col("i") + 1).alias("sample"), "diff")


def location_steps(df: DataFrame, most_km: float = 0.08) -> DataFrame:
    """Steps of more than `most_km` from the last valid position before."""
    here = F.when(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.struct("latitude", "longitude"))
    placed = scan.over_trips(df.withColumn("_here", here), row_no=scan.row_no(), _last=scan.last("_here"))
    km = scalars.haversine_km(*(F.col(f"{p}.{c}") for p in ("_last", "_here") for c in ("latitude", "longitude")))
    return placed.withColumn("km", km).where(F.col("km") > most_km).select(R.TRIP, "row_no", "km")


def context(df: DataFrame, flag: str, k: int) -> DataFrame:
    """Rows within k of a flagged row of their trip."""
    placed = scan.over_trips(df, _row=scan.row_no())
    own = F.when(F.col(flag) == 1, F.col("_row"))
    near = scan.over_trips(placed, _back=scan.last(own), _ahead=scan.following(own))
    return near.where(own.isNotNull() | (F.col("_row") - F.col("_back") <= k) | (F.col("_ahead") - F.col("_row") <= k)).drop("_row", "_back", "_ahead")


def sample_context(violations: DataFrame, df: DataFrame, column: str, k: int) -> DataFrame:
    """Each sample violation with the k samples on both sides."""
    placed = scan.over_trips(df, row_no=scan.row_no()).select(R.TRIP, "row_no", F.col(column).alias("_a"))
    start = F.greatest(F.lit(1), F.col("sample") - k + 1)
    return violations.join(placed, [R.TRIP, "row_no"]).withColumn("samples", F.slice("_a", start, F.col("sample") + k + 1 - start + 1)).drop("_a")


def multi_gaps(df: DataFrame, k: int, flag: str = "is_start_after_gap") -> DataFrame:
    """Gap rows with another gap within k rows."""
    if scan.PIECE not in df.columns:
        return df.withColumn("gaps_near", F.sum(flag).over(R.around(k))).where((F.col(flag) == 1) & (F.col("gaps_near") > 1))
    # a gap goes to every block of rows that it is near, and counts its neighbours in its own
    width = 2 * k + 1
    block = lambda row: F.floor(row / width).cast("long")
    row = F.col("_row")
    gaps = scan.over_trips(df, _row=scan.row_no()).where(F.col(flag) == 1)
    dealt = gaps.withColumn("_block", F.explode(F.sequence(block(row - k), block(row + k))))
    near = Window.partitionBy(R.TRIP, "_block").orderBy("_row").rangeBetween(-k, k)
    return dealt.withColumn("gaps_near", F.count("*").over(near)).where((F.col("_block") == block(row)) & (F.col("gaps_near") > 1)).drop("_row", "_block")


def islands(df: DataFrame, flag: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of equal flag values in each trip, and gives their lengths."""
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    placed = scan.over_trips(marked, _before=scan.lag("_f"), _row=scan.row_no(), _rows=scan.whole_sum(F.lit(1)))
    placed = placed.withColumn("_c", F.when(F.col("_f") == F.col("_before"), 0).otherwise(1))
    start = F.when(F.col("_c") == 1, F.col("_row"))
    numbered = scan.over_trips(placed, **{name: scan.total("_c"), "_start": scan.last(start), "_end": scan.following(start)})
    length = F.coalesce("_end", F.col("_rows") + 1) - F.coalesce(start, "_start")
    return numbered.withColumn(f"{name}_length", length).drop("_c", "_f", "_before", "_row", "_rows", "_start", "_end")


def edges(df: DataFrame, error: Column) -> DataFrame:
    """Pairs of consecutive points, flagged when either end has an error."""
    placed = scan.over_trips(df.withColumn("_e", R.flag(error)), _next=scan.lead("_e"))
    return placed.where("_next is not null").withColumn("edge_error", F.greatest("_e", "_next")).drop("_e", "_next")
