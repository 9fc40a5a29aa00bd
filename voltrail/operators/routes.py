"""Map matching and routing features from a table of precomputed routes.

A route provider is any function from segments to rows of ROUTE; `from_table` joins a
table made offline. Matching is a pure function of its inputs: radii grow until the
matched distance agrees with the odometer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.functions import scalars
from voltrail.operators import rows as R

KEYS = [R.TRIP, "segment_id"]
FIRST_RADIUS, RADIUS_GROWTH, MOST_RADIUS, MOST_ATTEMPTS, TOLERANCE_PCT = 25.0, 1.5, 100.0, 4, 10.0
ROUTE = "trip_id string, segment_id int, attempt int, code string, distance double, duration double, confidence double, legs array<struct<annotation:struct<duration:array<double>,distance:array<double>,speed:array<double>>>>"


def radii(first: float = FIRST_RADIUS, growth: float = RADIUS_GROWTH, most: float = MOST_RADIUS, attempts: int = MOST_ATTEMPTS) -> list[float]:
    out = [first]
    while len(out) < attempts:
        out.append(min(most, out[-1] * growth))
    return out


def precheck(span: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Per segment: points, status (null, or why it can't be matched), and whether gaps split the trace."""
    valid = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.abs("latitude") < float("inf")) & (F.abs("longitude") < float("inf"))
    us = F.floor(scalars.seconds(F.col(R.TIME))).cast("long")
    points = F.array_sort(F.collect_list(F.struct("row_no", us.alias("t"))))
    d = span.groupBy(*KEYS).agg(F.count("*").alias("points"), F.min(valid.cast("int")).alias("valid"), points.alias("p"))
    t = F.transform("p", lambda x: x["t"])
    steps = F.zip_with(F.slice(t, F.lit(2), F.size(t)), F.slice(t, F.lit(1), F.greatest(F.lit(0), F.size(t) - 1)), lambda b, a: b - a)
    bad = (F.col("points") < 2) | (F.col("valid") == 0) | F.exists(steps, lambda x: x <= 0)
    return d.select(*KEYS, "points", F.when(bad, "InputError_PreCheck").alias("match_status"), F.exists(steps, lambda x: x > gap_seconds).alias("split_gaps"))


def matched(segments: DataFrame, routes: DataFrame, tolerance: float = TOLERANCE_PCT, least_m: float = 10.0) -> DataFrame:
    """The match columns of each segment: its first attempt within tolerance of the odometer, else its last one."""
    odo = F.col("distance_seg_actual_km") * 1000
    joined = segments.select(*KEYS, "distance_seg_actual_km").join(routes, KEYS, "left")
    off = 100 * F.abs(F.col("distance") - odo) / odo
    status = (
        F.when(F.col("attempt").isNull(), "NotAttempted").when(F.col("code") == "NoMatch", "NoMatch").when(F.col("code") != "Ok", F.concat(F.lit("Error_"), "code"))
        .when(F.col("distance").isNull() | F.isnan("distance"), "Error_MatchDistanceNaN").when(odo.isNull(), "OK_NoToleranceCheck").when(odo <= least_m, "OK_OdoTooSmall").when(off <= tolerance, "OK_InTolerance").otherwise("OK_ToleranceFail")
    )
    joined = joined.withColumn("_status", status)
    done = F.col("_status").isin("OK_InTolerance", "OK_OdoTooSmall", "OK_NoToleranceCheck")
    rank = F.struct((~done).alias("later"), F.when(done, F.col("attempt")).otherwise(-F.col("attempt")).alias("a"))
    best = F.min_by(F.struct(F.col("_status").alias("match_status"), "attempt", "distance", "duration", "confidence", "legs"), rank)
    steps = F.array(*map(F.lit, radii()))
    out = joined.groupBy(*KEYS).agg(best.alias("m"))
    return out.select(
        *KEYS, F.col("m.distance").alias("matched_route_distance_m"), F.col("m.duration").alias("matched_route_duration_s"), F.col("m.confidence").alias("match_confidence"),
        F.col("m.match_status").alias("match_status"), F.coalesce("m.attempt", F.lit(0)).alias("match_attempts"), F.get(steps, F.col("m.attempt") - 1).alias("final_match_radius_m"), F.col("m.legs").alias("legs"),
    )


def match_features(segments: DataFrame, routes: DataFrame, direct: DataFrame, speeds: DataFrame) -> DataFrame:
    """The ten match columns of each segment: `matched`, and of an answered match (also one out of tolerance) the direct
    route, the deviation from it, and the time over the limit and the limit.

    direct: distance between a segment's ends; speeds: kph, one speed for each leg. Without an answer they are null.
    """
    told = matched(segments, routes).join(direct.select(*KEYS, F.col("distance").alias("_direct")), KEYS, "left").join(speeds.select(*KEYS, "kph"), KEYS, "left")
    answered = F.col("match_status").startswith("OK")
    over, limit = speeding(F.col("legs"), F.col("kph"))
    told = told.withColumn("direct_route_distance_m", F.when(answered, F.col("_direct")))
    return told.select(
        *KEYS, "matched_route_distance_m", "matched_route_duration_s", "match_confidence", "match_status", "match_attempts", "final_match_radius_m",
        "direct_route_distance_m", deviation_pct(F.col("matched_route_distance_m"), F.col("direct_route_distance_m")).alias("route_deviation_pct"),
        F.when(answered & F.col("kph").isNotNull(), over).alias("percent_time_over_limit_seg_agg"), F.when(answered & F.col("kph").isNotNull(), limit).alias("avg_speed_limit_kph_seg_agg"),
    )


def deviation_pct(matched_m: Column, direct_m: Column) -> Column:
    """How much longer the matched route is than the direct one; 0 where that can't be said."""
    return F.when(direct_m.isNotNull(), F.when(matched_m.isNotNull() & (direct_m > 1e-3), 100 * (matched_m - direct_m) / direct_m).otherwise(F.lit(0.0)))


def predicted(direct: DataFrame) -> DataFrame:
    """distance, duration and speed of a route between a segment's ends."""
    m, s = F.col("distance"), F.col("duration")
    return direct.select(*KEYS, m.alias("distance_seg_pred_m"), s.alias("duration_seg_pred_s"), F.when(s > 1e-6, m / s * 3.6).alias("speed_seg_pred_kph"))


def speeding(legs: Column, actual_kph: Column) -> tuple[Column, Column]:
    """Share of the time over the limit (percent) and the limit weighted by time.

    The annotation's speed (m/s) stands for the limit of each piece of road; `actual_kph` has one speed for each leg.
    """
    pieces = F.flatten(F.transform(legs, lambda leg, i: F.zip_with(leg["annotation"]["duration"], leg["annotation"]["speed"], lambda d, v: F.struct(d.alias("d"), (v * 3.6).alias("v"), F.get(actual_kph, i).alias("a")))))
    pieces = F.filter(pieces, lambda p: (p["d"] > 0) & p["v"].isNotNull())
    total = lambda f: F.aggregate(pieces, F.lit(0.0), lambda s, p: s + f(p))
    time = total(lambda p: p["d"])
    over = total(lambda p: F.when(p["a"] > p["v"], p["d"]).otherwise(F.lit(0.0)))
    return scalars.clip(F.coalesce(scalars.safe_div(100 * over, time), F.lit(0.0)), 0, 100), scalars.safe_div(total(lambda p: p["d"] * p["v"]), time)


def elevation_change(df: DataFrame) -> DataFrame:
    """Gain and loss of a route: no elevation model is there, so both are 0."""
    return df.withColumns({"dem_gain_m": F.lit(0.0), "dem_loss_m": F.lit(0.0)})
