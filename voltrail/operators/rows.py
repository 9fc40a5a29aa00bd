"""Names and the total order of a trip's rows, shared by the operators; running values are in scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRIP, TIME, TIE = "trip_id", "timestamp", "src_row_id"


def sorted_by_trip_time(df: DataFrame, trip: str = TRIP, time: str = TIME) -> DataFrame:
    """Rows in order of trip and time, by a range-partitioned sort; KeyError if a column is missing."""
    missing = [c for c in (trip, time) if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns to sort by: {missing}")
    return df.orderBy(trip, time, *([TIE] if TIE in df.columns else []))


def ordered() -> WindowSpec:
    return Window.partitionBy(TRIP).orderBy(TIME, TIE)


def around(k: int) -> WindowSpec:
    return ordered().rowsBetween(-k, k)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")
