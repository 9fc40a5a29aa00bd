"""Cross-sensor plausibility: differences between neighbouring rows, and rules over pairs of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.functions import arrays, scalars
from voltrail.operators import rows as R
from voltrail.operators import scan

DELTAS = ("time_s", "odo_km", "soc_pct", "gps_km", "dist_from_speed_km", "speed_max_internal", "alt_max_internal", "alt_m", "speed_edge", "alt_edge", "energy_kwh")


def deltas(df: DataFrame) -> DataFrame:
    """Adds d_ columns; all are null on a trip's first row. The energy needs a battery capacity."""
    speed, alt, lat, lon = (F.col(c) for c in ("speed_array", "altitude_array", "latitude", "longitude"))
    us = F.unix_micros(F.col(R.TIME).cast("timestamp"))
    now = {"us": us, "odo": F.col("current_odo"), "soc": F.col("current_soc"), "lat": lat, "lon": lon, "alt": arrays.mean(alt), "speed_end": arrays.last(speed), "alt_end": arrays.last(alt)}
    placed = scan.over_trips(df, _before=scan.lag(F.struct(*(c.alias(k) for k, c in now.items()))))
    before = lambda k: F.col(f"_before.{k}")
    step = lambda k: now[k] - before(k)
    out = {
        "time_s": step("us") / F.lit(1e6), "odo_km": step("odo"), "soc_pct": step("soc"), "gps_km": scalars.haversine_km(before("lat"), before("lon"), lat, lon),
        "dist_from_speed_km": arrays.total_km(speed), "speed_max_internal": arrays.max_step(speed), "alt_max_internal": arrays.max_step(alt),
        "alt_m": step("alt"), "speed_edge": arrays.first(speed) - before("speed_end"), "alt_edge": arrays.first(alt) - before("alt_end"),
    }
    if "battery_capacity_kwh" in df.columns:
        out["energy_kwh"] = step("soc") / 100 * F.col("battery_capacity_kwh")
    later = F.col("_before").isNotNull()
    return placed.withColumns({f"d_{k}": F.when(later, c) for k, c in out.items()}).drop("_before")


@dataclass(frozen=True)
class Rule:
    """A name, one or two delta columns, and what makes a row suspect."""

    name: str
    left: str
    right: str
    suspect: Callable[[Column, Column], Column]


def ratio(most: float, least: float = 0.05) -> Callable[[Column, Column], Column]:
    """The larger of two sizes is above `least` and more than `most` times the smaller."""

    def f(a: Column, b: Column) -> Column:
        low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
        return (high > least) & (low > scalars.TINY) & (high / F.greatest(low, F.lit(scalars.TINY)) > most)

    return f


def threshold(op: str, value: float) -> Callable[[Column, Column], Column]:
    """gt, lt, eq or abs_gt on the left column."""
    return {"gt": lambda a, _: a > value, "lt": lambda a, _: a < value, "eq": lambda a, _: a == value, "abs_gt": lambda a, _: F.abs(a) > value}[op]


def grade(most: float = 0.25, least_km: float = 0.05) -> Callable[[Column, Column], Column]:
    return lambda alt, km: (F.abs(km) >= least_km) & (F.abs(F.try_divide(alt, km * 1000)) > most)


def consumption(low: float, high: float, least_km: float = 0.5) -> Callable[[Column, Column], Column]:
    """kWh per 100 km outside a range, where energy was used."""

    def f(km: Column, kwh: Column) -> Column:
        per = F.try_divide(-kwh, km) * 100
        return (F.abs(km) > least_km) & (kwh < 0) & ((per < low) | (per > high))

    return f


def time_gap(low: float, high: float) -> Callable[[Column, Column], Column]:
    return lambda dt, _: (dt < low) | (dt > high)


#: The rules with their default limits.
RULES = (
    Rule("odo_gps_ratio", "odo_km", "gps_km", ratio(3.0)),
    Rule("gps_far", "gps_km", "gps_km", threshold("gt", 3.0)),
    Rule("grade", "alt_m", "odo_km", grade()),
    Rule("energy_per_100km", "odo_km", "energy_kwh", consumption(2.0, 60.0)),
    Rule("speed_spike", "speed_max_internal", "speed_max_internal", lambda a, _: a > 40),
    Rule("alt_spike", "alt_edge", "alt_edge", lambda a, _: F.abs(a) > 25),
    Rule("charging_while_moving", "soc_pct", "gps_km", lambda soc, km: (soc > 0.01) & (km > 0.01)),
    Rule("uphill_no_energy", "alt_m", "soc_pct", lambda alt, soc: (alt > 20) & (soc < 0.1)),
    Rule("time_gap", "time_s", "time_s", time_gap(59, 61)),
    Rule("descent_no_speed_change", "alt_m", "speed_edge", lambda alt, v: (alt < -50) & (F.abs(v) < 5)),
    Rule("speed_spike_stationary", "speed_max_internal", "gps_km", lambda v, km: (v > 30) & (F.abs(km) < 0.02)),
    Rule("odo_jump_short_time", "odo_km", "time_s", lambda km, dt: (F.abs(km) > 1) & (dt < 10)),
    Rule("teleport_no_energy", "gps_km", "soc_pct", lambda km, soc: (km > 2) & (F.abs(soc) < 0.5)),
    Rule("unrealistic_regen", "alt_m", "soc_pct", lambda alt, soc: (alt < -100) & (soc < -2)),
)


def flags(with_deltas: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds a boolean r_ column for each rule whose inputs are there; False where an input is missing. One projection."""
    out = {}
    for r in rules:
        if {f"d_{r.left}", f"d_{r.right}"} <= set(with_deltas.columns):
            a, b = F.col(f"d_{r.left}"), F.col(f"d_{r.right}")
            out[f"r_{r.name}"] = F.coalesce(a.isNotNull() & b.isNotNull() & r.suspect(a, b), F.lit(False))
    return with_deltas.withColumns(out)


def _rule_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("r_")]


def report(flagged: DataFrame) -> DataFrame:
    """Rows with a fired rule, and `fired`, the rules' names."""
    names = F.filter(F.array(*(F.when(F.col(c), F.lit(c[2:])) for c in _rule_columns(flagged))), lambda x: x.isNotNull())
    return flagged.withColumn("fired", names).where(F.size("fired") > 0)


def hits(flagged: DataFrame) -> DataFrame:
    """rule, row_hits, trip_hits, most first. A trip counts once: rows are summed per trip before."""
    columns = _rule_columns(flagged)
    per = flagged.groupBy(R.TRIP).agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in columns))
    total = per.agg(*(F.struct(F.sum(c).alias("row_hits"), F.count_if(F.col(c) > 0).alias("trip_hits")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c[2:]).alias("rule"), F.col(f"{c}.row_hits").alias("row_hits"), F.col(f"{c}.trip_hits").alias("trip_hits")) for c in columns))
    return total.select(F.explode(rows).alias("x")).select("x.*").orderBy(F.desc("row_hits"), "rule")


def analyse(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return report(flags(deltas(df), rules))
