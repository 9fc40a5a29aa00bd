"""Features of segments. Input: labelled rows (see segments.label_segments)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions import arrays, scalars
from voltrail.operators import rows as R
from voltrail.operators import segments

KEYS = [R.TRIP, "segment_id"]
HARSH = 1.5  # m/s^2


def _in_span() -> Window:
    return Window.partitionBy(*KEYS).orderBy("row_no")


_START = {"soc": "current_soc", "odo": "current_odo", "time": R.TIME, "battery_health": "battery_health", "lat": "latitude", "lon": "longitude", "temp": "outside_temp"}
_STATIC = {"car_model_trip": "car_model", "manufacturer_trip": "manufacturer", "battery_type_trip": "battery_type", "weight_trip_kg": "empty_weight_kg", "soc_trip_start": "trip_soc_start", "odo_trip_start": "trip_odo_start"}


def _outcome_aggregates(d: DataFrame) -> dict[str, Column]:
    first = {**{f"{k}_seg_start": c for k, c in _START.items()}, **_STATIC}
    last = {"soc_seg_end": "current_soc", "odo_seg_end": "current_odo", "time_seg_end": R.TIME}
    return {**{k: F.min_by(c, "row_no") for k, c in first.items() if c in d.columns}, **{k: F.max_by(c, "row_no") for k, c in last.items()}}


def _outcome_columns(out: DataFrame) -> DataFrame:
    out = out.withColumns({f"{k}_seg_start": c for k, c in scalars.start_parts(F.col("time_seg_start")).items()})
    return out.withColumns(
        {
            "gt_soc_seg_delta": F.col("soc_seg_start") - F.col("soc_seg_end"),
            "distance_seg_actual_km": scalars.clip(F.col("odo_seg_end") - F.col("odo_seg_start"), low=0),
            "duration_seg_actual_s": scalars.clip(scalars.seconds(F.col("time_seg_end")) - scalars.seconds(F.col("time_seg_start")), low=0),
        }
    )


def _with_dt(d: DataFrame) -> DataFrame:
    """dt: seconds since the row before in the span; a span's first row takes the median, or 1 if there is none above 0."""
    us = F.unix_micros(F.col(R.TIME).cast("timestamp"))
    d = d.withColumn("_raw", (us - F.lag(us).over(_in_span())) / F.lit(1e6))
    median = F.median("_raw").over(Window.partitionBy(*KEYS))
    return d.withColumn("dt", F.coalesce("_raw", F.when(median > 0, median).otherwise(F.lit(1.0)))).drop("_raw")


def _with_kinematics(d: DataFrame) -> DataFrame:
    w = _in_span()
    filled = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0))
    rate = lambda c: F.try_divide(F.col(c) - F.lag(c).over(w), F.col("dt"))
    d = d.withColumn("speed_mps", filled(scalars.mps(arrays.mean(F.col("speed_array")))))
    d = d.withColumn("_a", rate("speed_mps")).withColumn("accel", filled(F.col("_a")))
    d = d.withColumn("_j", rate("accel")).withColumn("jerk", filled(F.col("_j")))
    return d.drop("_a", "_j")


def kinematics(labelled: DataFrame) -> DataFrame:
    """Span rows with speed in m/s, acceleration and jerk; what cannot be computed takes the value before, else 0."""
    return _with_kinematics(_with_dt(segments.span_rows(labelled)))


def _kinematic_aggregates(harsh: float) -> dict[str, Column]:
    n = F.count("*")
    up, down = F.when(F.col("accel") > 1e-3, F.col("accel")), F.when(F.col("accel") < -1e-3, F.col("accel"))
    jerk = F.abs("jerk")
    known = {
        "speed_seg_agg_mean_mps": F.avg("speed_mps"), "speed_seg_agg_std_mps": F.stddev_samp("speed_mps"), "speed_seg_agg_max_mps": F.max("speed_mps"), "speed_seg_agg_min_mps": F.min("speed_mps"),
        "accel_seg_agg_mean": F.avg(up), "accel_seg_agg_std": F.stddev_samp(up), "accel_seg_agg_max": F.max(up),
        "decel_seg_agg_mean": F.avg(down), "decel_seg_agg_std": F.stddev_samp(down), "decel_seg_agg_max": F.min(down),
        "jerk_abs_seg_agg_mean": F.avg(jerk), "jerk_abs_seg_agg_std": F.stddev_samp(jerk), "jerk_abs_seg_agg_max": F.max(jerk),
    }
    events = {"accel_high_event_count": F.count_if(F.col("accel") >= harsh), "decel_high_event_count": F.count_if(F.col("accel") <= -harsh)}
    return {**{k: F.when(n >= 2, F.coalesce(c, F.lit(0.0))) for k, c in known.items()}, **{k: F.when(n >= 2, c) for k, c in events.items()}}


def _stop_aggregates() -> dict[str, Column]:
    stop = F.col("seg_label") == segments.STOP
    return {"stops_seg_count": F.sum("_begins"), "stop_duration_seg_agg_s": F.coalesce(F.sum(F.when(stop, F.col("dt"))), F.lit(0.0))}


def _surrounding_aggregates() -> dict[str, Column]:
    """Of a segment's own drive rows: altitude is that of rows' means."""
    own = F.col("seg_label") > 0
    alt, temp = F.when(own, F.col("_alt")), F.when(own, F.col("outside_temp"))
    order = F.when(alt.isNotNull(), F.col("row_no"))
    return {
        "altitude_seg_agg_mean": F.avg(alt), "altitude_seg_agg_std": F.stddev_samp(alt), "altitude_seg_agg_delta": F.max_by(alt, order) - F.min_by(alt, order),
        "temp_seg_agg_mean": F.avg(temp), "temp_seg_agg_std": F.stddev_samp(temp), "temp_seg_agg_min": F.min(temp), "temp_seg_agg_max": F.max(temp),
    }


PARTS = ("outcomes", "kinematics", "stops", "surroundings")


def segment_table(labelled: DataFrame, parts: Sequence[str] = PARTS, harsh: float = HARSH) -> DataFrame:
    """One row per segment with the features of `parts`, from one pass over the spans' rows and one aggregate."""
    d = segments.span_rows(labelled)
    made: dict[str, Column] = {}
    if "outcomes" in parts:
        made |= _outcome_aggregates(d)
    if "kinematics" in parts or "stops" in parts:
        d = _with_dt(d)
    if "kinematics" in parts:
        d = _with_kinematics(d)
        made |= _kinematic_aggregates(harsh)
    if "stops" in parts:
        stop = F.col("seg_label") == segments.STOP
        d = d.withColumn("_begins", R.flag(stop & (F.coalesce(F.lag("seg_label").over(_in_span()), F.lit(0)) != segments.STOP)))
        made |= _stop_aggregates()
    if "surroundings" in parts:
        d = d.withColumn("_alt", arrays.mean(F.col("altitude_array")))
        made |= _surrounding_aggregates()
    out = d.groupBy(*KEYS).agg(*(c.alias(k) for k, c in made.items()))
    return _outcome_columns(out) if "outcomes" in parts else out


def outcomes(labelled: DataFrame) -> DataFrame:
    """Start, static and outcome columns of each segment."""
    return segment_table(labelled, ["outcomes"])


def kinematic_features(labelled: DataFrame, harsh: float = HARSH) -> DataFrame:
    """Speed, acceleration, deceleration and jerk of each span of two rows or more; the others have nulls."""
    return segment_table(labelled, ["kinematics"], harsh)


def stop_features(labelled: DataFrame) -> DataFrame:
    """Runs of stop rows in each span, and the seconds of those rows."""
    return segment_table(labelled, ["stops"])


def surroundings(labelled: DataFrame) -> DataFrame:
    """Altitude (of rows' means) and temperature over a segment's own drive rows."""
    return segment_table(labelled, ["surroundings"])


def trip_level(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's first value of the trip that is not missing."""
    order = F.struct(R.TIME, R.TIE)
    return df.groupBy(R.TRIP).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns))


def all_features(labelled: DataFrame) -> DataFrame:
    """One row per segment with every feature."""
    return reordered(segment_table(labelled))


#: Groups of columns in the order of the output, by what their names hold.
_ORDER = ("trip_id", "segment_id", "_seg_start", "_trip", "_seg_agg_", "_count", "_seg_end", "_seg_actual", "gt_", "match", "_pred", "residual")


def reordered(df: DataFrame) -> DataFrame:
    place = lambda c: next((k for k, part in enumerate(_ORDER) if part in c), len(_ORDER))
    return df.select(*sorted(df.columns, key=lambda c: (place(c), df.columns.index(c))))


def with_global_prediction(segments_df: DataFrame, model: object, inputs: list[str], target: str = "gt_soc_seg_delta") -> DataFrame:
    """global_pred_soc_seg_delta where every input is there, and the residual; the model scores all rows at once."""
    whole = segments_df.dropna(subset=inputs)
    scored = model.transform(whole).select(*KEYS, F.col("prediction").alias("global_pred_soc_seg_delta"))
    return segments_df.join(scored, KEYS, "left").withColumn("residual_error_soc_seg_delta", F.col(target) - F.col("global_pred_soc_seg_delta"))
