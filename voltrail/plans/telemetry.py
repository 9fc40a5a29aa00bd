"""Telemetry made from the `events` table: the same arithmetic in Spark and in an oracle's SQL.

A trip is a user's events in order; every fault that the operators look for occurs:
gaps, jumps back, values out of range, positions near (0, 0), nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expressions that both engines read. `1e1` is a double in both.
_PLACED = {
    "trip_id": "user_id",
    "src_row_id": "event_id",
    "rn": "row_number() over (partition by user_id order by ts, event_id)",
}
_MARKED = {
    "gap": "case when src_row_id % 23 = 0 then 1 else 0 end",
    "still": "case when (rn + trip_id) % 13 in (10, 11, 12) or (rn * 7 + trip_id) % 17 = 0 then 1 else 0 end",
}
_STEPPED = {"step_m": "case when src_row_id % 97 = 0 then -300 when still = 1 then 0 else 200 + src_row_id % 900 end"}
_RUN = "over (partition by trip_id order by rn rows between unbounded preceding and current row)"
_SUMMED = {"gone_m": f"sum(step_m) {_RUN}", "gaps": f"sum(gap) {_RUN}"}
_COLUMNS = {
    "trip_id": "trip_id",
    "src_row_id": "src_row_id",
    "rn": "rn",
    "t_us": "(rn * 60 + gaps * 420 + src_row_id % 3 - 1) * 1000000",
    "current_odo": "(trip_id % 50) * 1e3 + gone_m / 1e3",
    "current_soc": "95 - floor(gone_m / 5e2) / 1e1 + case when src_row_id % 89 = 0 then 5 else 0 end",
    "latitude": "case when trip_id % 19 = 3 and rn % 5 <> 0 then 0e0 when src_row_id % 53 = 0 then 1e-4 when src_row_id % 211 = 0 then 95e0 when src_row_id % 223 = 0 then null else 40 + trip_id % 10 + rn * 3e-3 end",
    "longitude": "case when trip_id % 19 = 3 and rn % 5 <> 0 then 0e0 when src_row_id % 53 = 0 then 0e0 else 2 + trip_id % 7 + rn * 2e-3 end",
    "outside_temp": "case when src_row_id % 37 = 0 then null else (src_row_id * 13 % 700) / 1e1 - 20 end",
    "battery_health": "case when src_row_id % 61 = 0 then 45e0 else 90 + trip_id % 8 - rn * 1e-3 + case when src_row_id % 67 = 0 then 1 else 0 end end",
    "empty_weight_kg": "1200 + (trip_id % 30) * 1e1 + case when trip_id % 29 = 0 then rn % 2 else 0 end",
    "car_model": "case trip_id % 4 when 0 then '208  V2 (P21)' when 1 then 'C4 V3 (C41E)é' when 2 then 'UNKNOWN' else ' 308 V3 (P512) ' end",
    "manufacturer": "case trip_id % 4 when 1 then 'CITROEN' else 'PEUGEOT' end",
    "battery_type": "case trip_id % 4 when 3 then 'L3 720 70AH EF 720 EN' else 'L2 640 60AH EF 640 EN' end",
    "message_session_id": "concat('m', cast(trip_id as varchar(20)))",
}
_SPEED = "case when src_row_id % 307 = 0 and i = 2 then 260e0 when still = 1 then ((src_row_id + i) % 5) / 2e1 + case when src_row_id % 11 = 0 then 2 else 0 end else 20 + (src_row_id * (i + 3)) % 60 + 0e0 end"
_ALTITUDE = "100 + (src_row_id * 7 + i * 3) % 50 + case when src_row_id % 101 = 0 then 4000 else 0 end + 0e0"
SAMPLES, HEIGHTS = 6, 3


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    for step in (_PLACED,):
        e = e.selectExpr(*(f"{v} as {k}" for k, v in step.items()))
    for step in (_MARKED, _STEPPED, _SUMMED):
        e = e.selectExpr("*", *(f"{v} as {k}" for k, v in step.items()))
    out = e.selectExpr(
        *(f"{v} as {k}" for k, v in _COLUMNS.items()),
        f"case when src_row_id % 401 = 0 then null else transform(sequence(0L, {SAMPLES - 1}L), i -> cast({_SPEED} as double)) end as speed_array",
        f"transform(sequence(0L, {HEIGHTS - 1}L), i -> cast({_ALTITUDE} as double)) as altitude_array",
    )
    return out.withColumn("timestamp", F.timestamp_micros("t_us"))


def _cte(name: str, of: str, columns: dict[str, str], star: bool = True) -> str:
    return f"{name} as (select {'*, ' if star else ''}{', '.join(f'{v} as {k}' for k, v in columns.items())} from {of})"


TELEMETRY_SQL = ", ".join(
    [
        _cte("t1", "events", _PLACED, star=False), _cte("t2", "t1", _MARKED), _cte("t3", "t2", _STEPPED), _cte("t4", "t3", _SUMMED),
        _cte("t", "t4", {**_COLUMNS, "speed_array": f"case when src_row_id % 401 = 0 then null else [cast({_SPEED} as double) for i in range({SAMPLES})] end", "altitude_array": f"[cast({_ALTITUDE} as double) for i in range({HEIGHTS})]"}, star=False),
    ]
)
