"""Queries on segments: labels, spans, features, history, windows, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions import arrays
from voltrail.operators import features, history, metrics, routes, scan, segments, sequences, windows
from voltrail.operators import rows as R
from voltrail.plans.registry import query
from voltrail.plans.rows import GAPS, T, W
from voltrail.plans.telemetry import telemetry
from voltrail.sources.stage import staged
from voltrail.streaming import gaps

MIN_ROWS, FULL_STOP, MOST = 5, 3, 30
_TRIP = "(partition by trip_id order by row_no)"
_FLAGS = f"""{T}, {GAPS}, s as (select *, row_number() over {W} as row_no, coalesce(list_max(speed_array), 1e9) < 2 as low, coalesce(len([x for x in speed_array if x < 0.5]) / len(speed_array), 0) >= 0.9 as mostly,
  abs(coalesce(current_odo - lag(current_odo) over {W}, 0)) < 0.05 as stays from gf),
  sf as (select *, case when low and mostly and stays then -1 else 0 end as stop0 from s), fl as (select *, case when is_start_after_gap = 1 then case when stop0 = -1 then -3 else -2 end else stop0 end as stop_flag from sf)"""


def _cuts_sql() -> str:
    out = []
    for n in range(1, MOST + 1):
        for rem in range(MIN_ROWS):
            at = 0
            for k, extra in enumerate(segments.parted(rem, n)):
                out.append(f"({rem},{n},{k},{at},{at + MIN_ROWS + extra})")
                at += MIN_ROWS + extra
    return "cuts(rem, n, sidx, lo, hi) as (values " + ",".join(out) + ")"


_LABELS = f"""{_FLAGS}, {_cuts_sql()},
  l1 as (select *, case when stop_flag = lag(stop_flag) over {_TRIP} then 0 else 1 end as edge from fl), l2 as (select *, sum(edge) over (partition by trip_id order by row_no) as run from l1),
  l3 as (select *, stop_flag = -3 or (stop_flag = -1 and count(*) over (partition by trip_id, run) >= {FULL_STOP}) as hard from l2), l4 as (select *, sum(case when hard or stop_flag = -2 then 1 else 0 end) over {_TRIP} as isl from l3),
  l5 as (select *, max(case when stop_flag = 0 then row_no end) over (partition by trip_id, isl, hard) as lastz from l4),
  l6 as (select *, case when not hard and stop_flag in (0, -2) and coalesce(row_no <= lastz, false) then 1 else 0 end as drv from l5),
  l7 as (select *, sum(drv) over (partition by trip_id, isl, hard) as dn, sum(drv) over (partition by trip_id, isl, hard order by row_no) as ord from l6),
  l8 as (select l7.*, sidx from l7 left join cuts on drv = 1 and cuts.n = dn // {MIN_ROWS} and cuts.rem = dn % {MIN_ROWS} and ord > lo and ord <= hi),
  l9 as (select *, case when stop_flag = 0 and sidx is not null then dense_rank() over (partition by trip_id, (stop_flag = 0 and sidx is not null) order by isl, sidx) else stop_flag end as seg_label from l8)"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    return segments.gap_labels(segments.stop_flags(sequences.gap_flags(telemetry(spark, d))))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return segments.label_segments(flags(spark, d), MIN_ROWS, FULL_STOP)


@query("src_row_id:i stop_flag:i", f"{_FLAGS}, q as (select src_row_id, stop0 as stop_flag from fl)")
def seg_stops(spark: SparkSession, d: str) -> DataFrame:
    return segments.stop_flags(telemetry(spark, d))


@query("src_row_id:i conditions:i", f"{_FLAGS}, c as (select *, low::int + mostly::int + stays::int as conditions from fl), q as (select src_row_id, conditions from c where conditions between 1 and 2 and (row_no > 1 or low <> mostly))")
def seg_stops_debug(spark: SparkSession, d: str) -> DataFrame:
    return segments.half_stops(telemetry(spark, d))


@query("rows:i stops:i trips:i trips_with_stop:i stop_pct:d stops_per_trip:d", f"{_FLAGS}, a as (select count(*) as rows, count(*) filter (stop0 = -1) as stops, count(distinct trip_id) as trips, count(distinct case when stop0 = -1 then trip_id end) as trips_with_stop from fl), q as (select *, 100.0 * stops / rows as stop_pct, stops / trips as stops_per_trip from a)")
def agg_stop_stats(spark: SparkSession, d: str) -> DataFrame:
    return segments.stop_summary(segments.stop_flags(telemetry(spark, d)))


@query("src_row_id:i stop_flag:i", f"{_FLAGS}, q as (select src_row_id, stop_flag from fl)")
def seg_gaps(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d)


@query("rows:i trips:i gaps:i trips_with_gap:i gap_only:i stop_at_gap:i stops_left:i stops_before:i trips_pct:d gap_only_pct:d stop_at_gap_pct:d", f"""{_FLAGS}, gs as (select count(*) as rows, count(distinct trip_id) as trips, count(*) filter (is_start_after_gap = 1) as gaps, count(distinct trip_id) filter (stop_flag in (-2, -3)) as trips_with_gap,
  count(*) filter (stop_flag = -2) as gap_only, count(*) filter (stop_flag = -3) as stop_at_gap, count(*) filter (stop_flag = -1) as stops_left, count(*) filter (stop_flag in (-1, -3)) as stops_before from fl),
  q as (select *, 100.0 * trips_with_gap / trips as trips_pct, 100.0 * gap_only / rows as gap_only_pct, 100.0 * stop_at_gap / rows as stop_at_gap_pct from gs)""")
def agg_gap_stats(spark: SparkSession, d: str) -> DataFrame:
    return segments.gap_summary(flags(spark, d))


@query("trip_id:i src_row_id:i place:i", f"{T}, q as (select trip_id, src_row_id, row_number() over {W} as place from t)")
def sort_trip_time(spark: SparkSession, d: str) -> DataFrame:
    return R.sorted_by_trip_time(telemetry(spark, d)).withColumn("place", F.row_number().over(R.ordered()))


@query("trip_id:i row_no:i seg_label:i", f"{_LABELS}, q as (select * from l9)")
def seg_label(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d)


@query("trip_id:i row_no:i seg_label:i", f"{_LABELS}, q as (select * from l9)")
def scan_label(spark: SparkSession, d: str) -> DataFrame:
    """The same labels by trips in pieces: the table cut into 64 ranges of trip and time."""
    # every step writes the rows, so only what the next ones read goes along
    cut = scan.pieces(telemetry(spark, d).select(R.TRIP, R.TIME, R.TIE, "current_odo", "speed_array"), 64)
    flagged = segments.gap_labels(segments.stop_flags(sequences.gap_flags(cut)))
    return segments.label_segments(flagged.select(R.TRIP, R.TIME, R.TIE, scan.PIECE, "stop_flag"), MIN_ROWS, FULL_STOP)


@query("in_segment:i unsegmented:i stops:i gaps:i stops_at_gap:i", f"{_LABELS}, q as (select count(*) filter (seg_label > 0) as in_segment, count(*) filter (seg_label = 0) as unsegmented, count(*) filter (seg_label = -1) as stops, count(*) filter (seg_label = -2) as gaps, count(*) filter (seg_label = -3) as stops_at_gap from l9)")
def seg_summary(spark: SparkSession, d: str) -> DataFrame:
    return segments.label_summary(labels(spark, d))


@query("trips:i none:i at_least_1:i at_least_2:i at_least_3:i", f"{_LABELS}, m as (select trip_id, greatest(0, max(seg_label)) as n from l9 group by 1), q as (select count(*) as trips, count(*) filter (n = 0) as none, count(*) filter (n >= 1) as at_least_1, count(*) filter (n >= 2) as at_least_2, count(*) filter (n >= 3) as at_least_3 from m)")
def agg_seg_per_trip(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_coverage(labels(spark, d))


@query("trip_id:i rows:i", f"{_LABELS}, q as (select trip_id, count(*) as rows from l9 group by 1 having max(seg_label) >= 4)")
def min_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.at_least_segments(labels(spark, d), 4).groupBy(R.TRIP).agg(F.count("*").alias("rows"))


_SPANS = f"""{_LABELS}, b1 as (select trip_id, seg_label as segment_id, min(row_no) as first_row, max(row_no) as last_row from l9 where seg_label > 0 group by 1, 2),
  b2 as (select b1.*, (select max(row_no) from l9 where l9.trip_id = b1.trip_id and row_no < first_row and seg_label <> -1) as prow from b1),
  sp as (select b2.*, case when l9.seg_label = -2 and first_row - prow - 1 < {FULL_STOP} then prow else first_row end as anchor_row from b2 left join l9 on l9.trip_id = b2.trip_id and l9.row_no = prow),
  x as (select l9.*, segment_id from l9 join sp on l9.trip_id = sp.trip_id and row_no between first_row and last_row),
  xa as (select l9.*, segment_id from l9 join sp on l9.trip_id = sp.trip_id and row_no between anchor_row and last_row)"""


@query("trip_id:i segment_id:i first_row:i last_row:i anchor_row:i", f"{_SPANS}, q as (select * from sp)")
def seg_anchor(spark: SparkSession, d: str) -> DataFrame:
    return segments.spans(labels(spark, d), FULL_STOP)


@query("trip_id:i segment_id:i span_rows:i", f"{_SPANS}, q as (select trip_id, segment_id, last_row - first_row + 1 as span_rows from sp order by 3 desc, 1, 2 limit 1)")
def seg_max(spark: SparkSession, d: str) -> DataFrame:
    return segments.longest_span(labels(spark, d))


@query("trip_id:i segment_id:i rule:s", f"""{_SPANS}, r1 as (select trip_id, segment_id, arg_min(seg_label, row_no) as s, arg_max(seg_label, row_no) as e, count(*) filter (seg_label in (-2, -3)) as g, count(*) filter (seg_label in (0, -2) or seg_label > 0) as drv from xa group by 1, 2),
  q as (select trip_id, segment_id, 'start' as rule from r1 where s in (-1, -3) union all select trip_id, segment_id, 'end' from r1 where e < 0 union all select trip_id, segment_id, 'inside_gap' from r1 where g - (s in (-2, -3))::int > 0
   union all select trip_id, segment_id, 'too_short' from r1 where drv < {MIN_ROWS} union all select trip_id, segment_id, 'too_long' from r1 where drv > {2 * MIN_ROWS - 2})""")
def seg_rules(spark: SparkSession, d: str) -> DataFrame:
    # a limit one tighter than the invariant's, so that rows come out; no span holds a full stop
    return segments.rule_violations(labels(spark, d), MIN_ROWS, FULL_STOP, most_rows=2 * MIN_ROWS - 2)


_OUT = """o as (select trip_id, segment_id, arg_min(current_soc, row_no) as soc_seg_start, arg_max(current_soc, row_no) as soc_seg_end, arg_min(current_odo, row_no) as odo_seg_start, arg_max(current_odo, row_no) as odo_seg_end,
  arg_min(t_us, row_no) as t0, arg_max(t_us, row_no) as t1, arg_min(empty_weight_kg, row_no) as weight_trip_kg from x group by 1, 2),
  oo as (select *, soc_seg_start - soc_seg_end as gt_soc_seg_delta, greatest(0, odo_seg_end - odo_seg_start) as distance_seg_actual_km, (t1 - t0) / 1e6 as duration_seg_actual_s from o)"""


@query("trip_id:i segment_id:i soc_seg_start:d soc_seg_end:d gt_soc_seg_delta:d distance_seg_actual_km:d duration_seg_actual_s:d weight_trip_kg:d", f"{_SPANS}, {_OUT}, q as (select * from oo)")
def feat_outcome(spark: SparkSession, d: str) -> DataFrame:
    return features.outcomes(labels(spark, d))


_SEG = "(partition by trip_id, segment_id order by row_no)"
_KIN = f"""k0 as (select *, (t_us - lag(t_us) over {_SEG}) / 1e6 as raw, list_avg(speed_array) * 1000 / 3600 as v0 from x), k1 as (select *, median(raw) over (partition by trip_id, segment_id) as med from k0),
  k2 as (select *, coalesce(raw, case when med > 0 then med else 1 end) as dt2, coalesce(last_value(v0 ignore nulls) over {_SEG}, 0) as v from k1),
  k3 as (select *, case when dt2 <> 0 then (v - lag(v) over {_SEG}) / dt2 end as a0 from k2), k4 as (select *, coalesce(last_value(a0 ignore nulls) over {_SEG}, 0) as a from k3),
  k5 as (select *, case when dt2 <> 0 then (a - lag(a) over {_SEG}) / dt2 end as j0 from k4), k6 as (select *, coalesce(last_value(j0 ignore nulls) over {_SEG}, 0) as j from k5)"""


@query(
    "trip_id:i segment_id:i speed_seg_agg_mean_mps:d speed_seg_agg_std_mps:d speed_seg_agg_max_mps:d speed_seg_agg_min_mps:d accel_seg_agg_mean:d accel_seg_agg_std:d accel_seg_agg_max:d decel_seg_agg_mean:d decel_seg_agg_std:d decel_seg_agg_max:d jerk_abs_seg_agg_mean:d jerk_abs_seg_agg_std:d jerk_abs_seg_agg_max:d accel_high_event_count:i decel_high_event_count:i",
    f"""{_SPANS}, {_KIN}, q as (select trip_id, segment_id, avg(v) as speed_seg_agg_mean_mps, stddev_samp(v) as speed_seg_agg_std_mps, max(v) as speed_seg_agg_max_mps, min(v) as speed_seg_agg_min_mps,
  coalesce(avg(a) filter (a > 1e-3), 0) as accel_seg_agg_mean, coalesce(stddev_samp(a) filter (a > 1e-3), 0) as accel_seg_agg_std, coalesce(max(a) filter (a > 1e-3), 0) as accel_seg_agg_max,
  coalesce(avg(a) filter (a < -1e-3), 0) as decel_seg_agg_mean, coalesce(stddev_samp(a) filter (a < -1e-3), 0) as decel_seg_agg_std, coalesce(min(a) filter (a < -1e-3), 0) as decel_seg_agg_max,
  avg(abs(j)) as jerk_abs_seg_agg_mean, stddev_samp(abs(j)) as jerk_abs_seg_agg_std, max(abs(j)) as jerk_abs_seg_agg_max, count(*) filter (a >= 0.1) as accel_high_event_count, count(*) filter (a <= -0.1) as decel_high_event_count from k6 group by 1, 2)""",
)
def feat_kinematics(spark: SparkSession, d: str) -> DataFrame:
    return features.kinematic_features(labels(spark, d), harsh=0.1)


@query("trip_id:i segment_id:i stops_seg_count:i stop_duration_seg_agg_s:d", f"""{_SPANS}, {_KIN}, b as (select *, case when seg_label = -1 and coalesce(lag(seg_label) over {_SEG}, 0) <> -1 then 1 else 0 end as begins from k2),
  q as (select trip_id, segment_id, sum(begins) as stops_seg_count, coalesce(sum(dt2) filter (seg_label = -1), 0) as stop_duration_seg_agg_s from b group by 1, 2)""")
def feat_stops(spark: SparkSession, d: str) -> DataFrame:
    return features.stop_features(labels(spark, d))


@query("trip_id:i segment_id:i altitude_seg_agg_mean:d altitude_seg_agg_std:d altitude_seg_agg_delta:d temp_seg_agg_mean:d temp_seg_agg_std:d temp_seg_agg_min:d temp_seg_agg_max:d", f"""{_LABELS}, a as (select *, list_avg(altitude_array) as alt, seg_label as segment_id from l9 where seg_label > 0),
  q as (select trip_id, segment_id, avg(alt) as altitude_seg_agg_mean, stddev_samp(alt) as altitude_seg_agg_std, arg_max(alt, row_no) - arg_min(alt, row_no) as altitude_seg_agg_delta, avg(outside_temp) as temp_seg_agg_mean, stddev_samp(outside_temp) as temp_seg_agg_std, min(outside_temp) as temp_seg_agg_min, max(outside_temp) as temp_seg_agg_max from a group by 1, 2)""")
def feat_alt_temp(spark: SparkSession, d: str) -> DataFrame:
    return features.surroundings(labels(spark, d))


def small(spark: SparkSession, d: str) -> DataFrame:
    """Outcome and stop columns of segments."""
    return features.segment_table(labels(spark, d), ["outcomes", "stops"])


SMALL_SQL = f"""{_SPANS}, {_OUT}, {_KIN}, sb as (select *, case when seg_label = -1 and coalesce(lag(seg_label) over {_SEG}, 0) <> -1 then 1 else 0 end as begins from k2),
  sc as (select trip_id, segment_id, sum(begins) as stops_seg_count, coalesce(sum(dt2) filter (seg_label = -1), 0) as stop_duration_seg_agg_s from sb group by 1, 2), sm as (select * from oo join sc using (trip_id, segment_id))"""
_OTHERS = "(partition by trip_id rows between unbounded preceding and unbounded following exclude current row)"
_TOTALS = ["distance_seg_actual_km", "duration_seg_actual_s", "stops_seg_count", "stop_duration_seg_agg_s"]


@query("trip_id:i segment_id:i others_avg_gt_soc_seg_delta:d others_std_gt_soc_seg_delta:d others_avg_distance_seg_actual_km:d others_std_distance_seg_actual_km:d others_avg_duration_seg_actual_s:d others_std_duration_seg_actual_s:d others_total_distance_seg_actual_km:d others_segment_count:i", f"""{SMALL_SQL}, q as (select * from (select trip_id, segment_id, avg(gt_soc_seg_delta) over {_OTHERS} as others_avg_gt_soc_seg_delta, stddev_samp(gt_soc_seg_delta) over {_OTHERS} as others_std_gt_soc_seg_delta,
  avg(distance_seg_actual_km) over {_OTHERS} as others_avg_distance_seg_actual_km, stddev_samp(distance_seg_actual_km) over {_OTHERS} as others_std_distance_seg_actual_km, avg(duration_seg_actual_s) over {_OTHERS} as others_avg_duration_seg_actual_s, stddev_samp(duration_seg_actual_s) over {_OTHERS} as others_std_duration_seg_actual_s, sum(distance_seg_actual_km) over {_OTHERS} as others_total_distance_seg_actual_km, count(*) over {_OTHERS} as others_segment_count from sm) where others_segment_count > 0)""")
def loso_others(spark: SparkSession, d: str) -> DataFrame:
    return history.others(small(spark, d), ["gt_soc_seg_delta", "distance_seg_actual_km", "duration_seg_actual_s"], ["distance_seg_actual_km"])


@query("trip_id:i segment_id:i others_stops_seg_count_per_km:d others_stops_seg_count_per_minute:d others_stop_share:d", f"""{SMALL_SQL}, a as (select trip_id, segment_id, sum(distance_seg_actual_km) over {_OTHERS} as km, sum(duration_seg_actual_s) over {_OTHERS} as s, sum(stops_seg_count) over {_OTHERS} as n, sum(stop_duration_seg_agg_s) over {_OTHERS} as st, count(*) over {_OTHERS} as c from sm),
  q as (select trip_id, segment_id, case when km > 1e-6 then n / km else 0 end as others_stops_seg_count_per_km, case when s > 1e-6 then n * 60 / s else 0 end as others_stops_seg_count_per_minute, case when s > 1e-6 then st / s else 0 end as others_stop_share from a where c > 0)""")
def loso_rates(spark: SparkSession, d: str) -> DataFrame:
    return history.rates(history.others(small(spark, d), [], _TOTALS), ["stops_seg_count"])


@query("trip_id:i segment_id:i prev_gt:d", f"{SMALL_SQL}, q as (select trip_id, segment_id, lag(gt_soc_seg_delta) over (partition by trip_id order by segment_id) as prev_gt from sm)")
def wf_lag(spark: SparkSession, d: str) -> DataFrame:
    return history.lagged(small(spark, d), ["gt_soc_seg_delta"]).withColumnRenamed("k-1_gt_soc_seg_delta", "prev_gt")


_PRIOR = "(partition by trip_id order by segment_id rows between unbounded preceding and 1 preceding)"


@query("trip_id:i segment_id:i hist_segments:i hist_distance_km:d hist_soc_per_km:d hist_stops_per_km:d hist_stop_s_per_stop:d hist_avg_gt_soc_seg_delta:d", f"""{SMALL_SQL}, h as (select trip_id, segment_id, count(*) over {_PRIOR} as hist_segments, coalesce(sum(distance_seg_actual_km) over {_PRIOR}, 0) as hist_distance_km, coalesce(sum(gt_soc_seg_delta) over {_PRIOR}, 0) as soc,
  coalesce(sum(stops_seg_count) over {_PRIOR}, 0) as st, coalesce(sum(stop_duration_seg_agg_s) over {_PRIOR}, 0) as ss, avg(gt_soc_seg_delta) over {_PRIOR} as hist_avg_gt_soc_seg_delta from sm),
  q as (select *, case when hist_distance_km > 1e-6 then soc / hist_distance_km else 0 end as hist_soc_per_km, case when hist_distance_km > 1e-6 then st / hist_distance_km else 0 end as hist_stops_per_km, case when st > 1e-6 then ss / st else 0 end as hist_stop_s_per_stop from h)""")
def wf_hist(spark: SparkSession, d: str) -> DataFrame:
    return history.so_far(small(spark, d), ["gt_soc_seg_delta"])


@query("trip_id:i segment_id:i", f"{SMALL_SQL}, q as (select * from (select *, count(*) over (partition by trip_id) as n from sm) where n > 3)")
def loso_min(spark: SparkSession, d: str) -> DataFrame:
    return history.enough_segments(small(spark, d), 3)


@query("segments:i possible:i", f"{SMALL_SQL}, n as (select count(*) as n from sm group by trip_id), q as (select sum(n) as segments, coalesce(sum(n) filter (n - 1 >= 3), 0) as possible from n)")
def agg_possible(spark: SparkSession, d: str) -> DataFrame:
    return metrics.predictions_possible(small(spark, d), 3)


@query("trip_id:i seg_id:i win_id:i start_sample:i accel_sum:d accel_at_3:d", f"""{_SPANS}, f as (select trip_id, segment_id as seg_id, flatten(list(speed_array order by row_no) filter (speed_array is not null)) as kph from xa group by 1, 2),
  u as (select *, unnest(range(0, len(kph) // 1 - 29, 15)) as start_sample from f where len(kph) >= 30), v as (select trip_id, seg_id, start_sample // 15 as win_id, start_sample, [case when i > 1 then (kph[i] - kph[i - 1]) * 1000 / 3600 end for i in range(start_sample + 1, start_sample + 31)] as a from u),
  q as (select trip_id, seg_id, win_id, start_sample, list_sum(a) as accel_sum, a[3] as accel_at_3 from v)""")
def windows30(spark: SparkSession, d: str) -> DataFrame:
    w = windows.windows(windows.signals(labels(spark, d), FULL_STOP))
    total = F.aggregate(arrays.present(F.col("accel")), F.lit(0.0), lambda s, x: s + x)
    return w.withColumns({"accel_sum": total, "accel_at_3": F.try_element_at("accel", F.lit(3))})


def _h(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', '7', {', '.join(parts)})), 1, 13)) AS BIGINT)"


_PAIRS = f"""{_SPANS}, f as (select trip_id, segment_id as seg_id, flatten(list(speed_array order by row_no) filter (speed_array is not null)) as kph from xa group by 1, 2),
  w0 as (select trip_id, seg_id, unnest(range(0, len(kph) // 1 - 29, 15)) // 15 as win_id from f where len(kph) >= 30), w1 as (select *, {_h("trip_id", "seg_id", "win_id")} as h from w0),
  w2 as (select *, h % 1048576 < 0.2 * 1048576 as same, row_number() over (partition by trip_id order by seg_id, win_id) as p, count(*) over (partition by trip_id) as n, count(*) over (partition by trip_id, seg_id) as m from w1),
  w3 as (select *, min(p) over (partition by trip_id, seg_id) as lo, greatest(0, p - 5) as fl, greatest(0, n - p - 4) as fr from w2),
  w4 as (select *, {_h("h", "'p'")} % greatest(1, n - m) + 1 as pick, {_h("h", "'q'")} % greatest(1, fl + fr) + 1 as far from w3),
  w5 as (select *, case when n > m then case when pick < lo then pick else pick + m end when fl + fr > 0 then case when far <= fl then far else far - fl + p + 4 end end as place from w4),
  tr as (select trip_id as t, count(*) as tn, {_h("trip_id")} as o, {_h("trip_id", "'r'")} as r from w1 group by trip_id), tc as (select count(*) as c, arg_min(t, o) as ft, arg_min(tn, o) as fn, arg_max(t, o) as zt, arg_max(tn, o) as zn from tr),
  tb as (select tr.*, {_h("t", "'b'")} % greatest(1, c // 1000) as bk from tr, tc),
  seat as (select bk, row_number() over g - 1 as o, t as xt, tn as xn, coalesce(lead(t) over g, first_value(t) over g) as yt, coalesce(lead(tn) over g, first_value(tn) over g) as yn from tb window g as (partition by bk order by r, t)),
  sz as (select bk, count(*) as s from tb group by 1), d1 as (select w5.*, {_h("h", "'b'")} % greatest(1, c // 1000) as bk from w5, tc where not same),
  d2 as (select d1.*, {_h("h", "'o'")} % coalesce(s, 1) as o from d1 left join sz using (bk)),
  d3 as (select d2.*, case when xt <> trip_id then xt when yt <> trip_id then yt when trip_id <> ft then ft else zt end as bt, case when xt <> trip_id then xn when yt <> trip_id then yn when trip_id <> ft then fn else zn end as bn from d2 left join seat using (bk, o), tc),
  d4 as (select *, {_h("h", "'w'")} % bn + 1 as there from d3 where bt <> trip_id),
  q as (select a.trip_id, a.seg_id, a.win_id, b.trip_id as b_trip_id, b.seg_id as b_seg_id, b.win_id as b_win_id, 1 as label from w5 a join w5 b on a.trip_id = b.trip_id and a.place = b.p where a.same
   union all select d4.trip_id, d4.seg_id, d4.win_id, b.trip_id, b.seg_id, b.win_id, 0 from d4 join w5 b on b.trip_id = bt and b.p = there)"""


@query("trip_id:i seg_id:i win_id:i b_trip_id:i b_seg_id:i b_win_id:i label:i", _PAIRS)
def self_pair(spark: SparkSession, d: str) -> DataFrame:
    # the windows' keys are read several times
    return windows.pairs(staged(windows.windows(windows.signals(labels(spark, d), FULL_STOP)).select(*windows.KEYS)))


_ROUTES = "rt as (select trip_id, segment_id, attempt, case when segment_id % 7 = 0 then 'NoMatch' else 'Ok' end as code, case when segment_id % 7 <> 0 then distance_seg_actual_km * 1000 * (1.3 - attempt * 0.08) end as distance from oo, (values (1), (2), (3), (4)) a(attempt) where segment_id % 5 <> 0)"


@query(
    "trip_id:i segment_id:i match_status:s match_attempts:i matched_route_distance_m:d matched_route_duration_s:d match_confidence:d final_match_radius_m:d direct_route_distance_m:d route_deviation_pct:d percent_time_over_limit_seg_agg:d avg_speed_limit_kph_seg_agg:d",
    f"""{_SPANS}, {_OUT}, {_ROUTES}, j as (select oo.trip_id, oo.segment_id, attempt, distance, case when attempt is null then 'NotAttempted' when code = 'NoMatch' then 'NoMatch' when distance_seg_actual_km * 1000 <= 10 then 'OK_OdoTooSmall' when 100 * abs(distance - distance_seg_actual_km * 1000) / (distance_seg_actual_km * 1000) <= 10 then 'OK_InTolerance' else 'OK_ToleranceFail' end as st
   from oo left join rt on oo.trip_id = rt.trip_id and oo.segment_id = rt.segment_id),
  n as (select *, row_number() over (partition by trip_id, segment_id order by st not in ('OK_InTolerance', 'OK_OdoTooSmall'), case when st in ('OK_InTolerance', 'OK_OdoTooSmall') then attempt else -attempt end) as n from j),
  lm as (select trip_id, segment_id, 100.0 * coalesce(sum(10 + i) filter (30 + segment_id * 3 > (8 + i * 2) * 3.6), 0) / sum(10 + i) as over_pct, sum((10 + i) * (8 + i * 2) * 3.6) / sum(10 + i) as limit_kph from oo, range(4) r(i) group by 1, 2),
  d as (select n.*, starts_with(st, 'OK') as ok, distance_seg_actual_km * 900 as direct, over_pct, limit_kph from n join oo on oo.trip_id = n.trip_id and oo.segment_id = n.segment_id join lm on lm.trip_id = n.trip_id and lm.segment_id = n.segment_id where n = 1),
  q as (select trip_id, segment_id, st as match_status, coalesce(attempt, 0) as match_attempts, distance as matched_route_distance_m, distance / 12.5 as matched_route_duration_s, case when ok then 1 / (attempt + 1.0) end as match_confidence, [25.0, 37.5, 56.25, 84.375][attempt] as final_match_radius_m,
    case when ok then direct end as direct_route_distance_m, case when ok then case when direct > 1e-3 then 100 * (distance - direct) / direct else 0 end end as route_deviation_pct, case when ok then over_pct end as percent_time_over_limit_seg_agg, case when ok then limit_kph end as avg_speed_limit_kph_seg_agg from d)""",
)
def route_match(spark: SparkSession, d: str) -> DataFrame:
    seg = staged(features.outcomes(labels(spark, d)).select(*routes.KEYS, "distance_seg_actual_km", "duration_seg_actual_s"))
    tries = F.explode(F.array(*map(F.lit, range(1, 5))))
    odo = F.col("distance_seg_actual_km") * 1000
    ok = F.col("segment_id") % 7 != 0
    rt = seg.where("segment_id % 5 <> 0").select(*routes.KEYS, odo.alias("_m"), tries.alias("attempt")).withColumn("distance", F.when(ok, F.col("_m") * (1.3 - F.col("attempt") * 0.08)))
    rt = rt.select(
        *routes.KEYS, "attempt", F.when(ok, "Ok").otherwise("NoMatch").alias("code"), "distance", (F.col("distance") / 12.5).alias("duration"),
        F.when(ok, 1 / (F.col("attempt") + 1.0)).alias("confidence"), F.when(ok, _legs()).alias("legs"),
    )
    return routes.match_features(seg, rt, _direct(seg), seg.select(*routes.KEYS, _kph().alias("kph")))


def _legs() -> Column:
    """Four made-up legs of one piece of road each."""
    leg = lambda i: F.struct(F.struct(F.array(10.0 + i).alias("duration"), F.array(8.0 + i * 2).alias("speed")).alias("annotation"))
    return F.transform(F.sequence(F.lit(0), F.lit(3)), leg)


def _kph() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.lit(30.0) + F.col("segment_id") * 3)


@query("trip_id:i segment_id:i points:i bad:b split_gaps:b", f"""{_SPANS}, w as (select *, (t_us // 1000000) - lag(t_us // 1000000) over {_SEG} as st from x), q as (select trip_id, segment_id, count(*) as points, count(*) < 2 or count(*) filter (latitude is null or longitude is null) > 0 or count(*) filter (st <= 0) > 0 as bad, count(*) filter (st > 300) > 0 as split_gaps from w group by 1, 2)""")
def match_precheck(spark: SparkSession, d: str) -> DataFrame:
    return routes.precheck(segments.span_rows(labels(spark, d))).withColumn("bad", F.col("match_status").isNotNull())


@query("trip_id:i segment_id:i over_pct:d limit_kph:d", f"""{_SPANS}, {_OUT}, p as (select trip_id, segment_id, i, 10 + i as dur, 8 + i * 2 as lim, 30 + segment_id * 3 as act from oo, range(4) r(i)),
  q as (select trip_id, segment_id, 100.0 * coalesce(sum(dur) filter (act > lim * 3.6), 0) / sum(dur) as over_pct, sum(dur * lim * 3.6) / sum(dur) as limit_kph from p group by 1, 2)""")
def speeding(spark: SparkSession, d: str) -> DataFrame:
    seg = features.outcomes(labels(spark, d)).select(*routes.KEYS)
    seg = seg.withColumn("legs", _legs()).withColumn("kph", _kph())
    over, limit = routes.speeding(F.col("legs"), F.col("kph"))
    return seg.withColumns({"over_pct": over, "limit_kph": limit})


@query("trip_id:i sessions:i longest:i", f"""{T}, b as (select *, case when (t_us - lag(t_us) over {W}) < 100000000 then 0 else 1 end as new from t), c as (select *, sum(new) over (partition by trip_id order by t_us, src_row_id rows unbounded preceding) as s from b),
  r as (select trip_id, s, count(*) as n from c group by 1, 2), q as (select trip_id, count(*) as sessions, max(n) as longest from r group by 1)""")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = gaps.sessions(telemetry(spark, d), "100 seconds")
    return s.groupBy(R.TRIP).agg(F.count("*").alias("sessions"), F.max("rows").alias("longest"))


def _at(i: str) -> str:
    """The altitude at sample i (from 1) of len(kph), between its neighbours."""
    x = f"(({i} - 1) * (len(alt) - 1) / greatest(1, len(kph) - 1)::double)"
    low = f"floor({x})::int"
    return f"(alt[{low} + 1] + (alt[least({low} + 1, len(alt) - 1) + 1] - alt[{low} + 1]) * ({x} - {low}))"


@query("trip_id:i seg_id:i win_id:i used:i accel_total:d slope_total:d", f"""{_SPANS}, f as (select trip_id, segment_id as seg_id, flatten(list(speed_array order by row_no) filter (speed_array is not null)) as kph, flatten(list(altitude_array order by row_no) filter (altitude_array is not null)) as alt from xa group by 1, 2),
  u as (select *, unnest(range(0, len(kph) // 1 - 29, 15)) as start_sample from f where len(kph) >= 30),
  v as (select *, [case when i > 1 then (kph[i] - kph[i - 1]) * 1000 / 3600 end for i in range(start_sample + 1, start_sample + 31)] as a, [case when i > 1 then {_at("i")} - {_at("(i - 1)")} end for i in range(start_sample + 1, start_sample + 31)] as r from u),
  q as (select trip_id, seg_id, start_sample // 15 as win_id, len([x for x in a[3:] if x is not null]) as used, list_sum(a) as accel_total, list_sum(r) as slope_total from v)""")
def window_tensors(spark: SparkSession, d: str) -> DataFrame:
    w = windows.tensors(windows.windows(windows.signals(labels(spark, d), FULL_STOP)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return w.withColumns({"used": total("mask"), "accel_total": total("accel"), "slope_total": total("slope_rate")})


@query("trip_id:i segment_id:i k_gt_soc_seg_delta:d k_distance_seg_actual_km:d", f"{_SPANS}, {_OUT}, q as (select trip_id, segment_id, gt_soc_seg_delta as k_gt_soc_seg_delta, distance_seg_actual_km as k_distance_seg_actual_km from oo)")
def loso_k(spark: SparkSession, d: str) -> DataFrame:
    return history.own_columns(features.outcomes(labels(spark, d)), ["gt_soc_seg_delta", "distance_seg_actual_km"])


def _direct(seg: DataFrame) -> DataFrame:
    """A made-up direct route for each segment: shorter and faster than the one driven."""
    return seg.select(*routes.KEYS, (F.col("distance_seg_actual_km") * 900).alias("distance"), (F.col("duration_seg_actual_s") * 0.8).alias("duration"))


@query("trip_id:i segment_id:i distance_seg_pred_m:d duration_seg_pred_s:d speed_seg_pred_kph:d", f"""{_SPANS}, {_OUT}, p as (select trip_id, segment_id, distance_seg_actual_km * 900 as distance_seg_pred_m, duration_seg_actual_s * 0.8 as duration_seg_pred_s from oo),
  q as (select *, case when duration_seg_pred_s > 1e-6 then distance_seg_pred_m / duration_seg_pred_s * 3.6 end as speed_seg_pred_kph from p)""")
def feat_pred(spark: SparkSession, d: str) -> DataFrame:
    return routes.predicted(_direct(features.outcomes(labels(spark, d))))


@query("trip_id:i segment_id:i deviation_pct:d dem_gain_m:d dem_loss_m:d", f"""{_SPANS}, {_OUT}, q as (select trip_id, segment_id, case when distance_seg_actual_km * 900 > 1e-3 then 100 * (distance_seg_actual_km * 1000 - distance_seg_actual_km * 900) / (distance_seg_actual_km * 900) else 0 end as deviation_pct, 0.0 as dem_gain_m, 0.0 as dem_loss_m from oo)""")
def route_deviation(spark: SparkSession, d: str) -> DataFrame:
    seg = staged(features.outcomes(labels(spark, d)))
    pair = seg.select(*routes.KEYS, (F.col("distance_seg_actual_km") * 1000).alias("driven")).join(_direct(seg), routes.KEYS)
    return routes.elevation_change(pair.withColumn("deviation_pct", routes.deviation_pct(F.col("driven"), F.col("distance"))))
