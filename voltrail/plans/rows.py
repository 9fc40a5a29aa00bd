"""Queries on telemetry rows: cleaning, sequences, scalar and array functions, quality rules."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions import arrays, cells, scalars
from voltrail.operators import clean, places, quality, sequences
from voltrail.operators import rows as R
from voltrail.plans.registry import query
from voltrail.plans.telemetry import TELEMETRY_SQL, telemetry
from voltrail.sources import files, reference
from voltrail.sources.stage import shared_dir

T = TELEMETRY_SQL
W = "(partition by trip_id order by t_us, src_row_id)"
_BEFORE = "(partition by trip_id order by t_us, src_row_id rows between unbounded preceding and 1 preceding)"
GAPS = f"g as (select *, (t_us - lag(t_us) over {W}) / 1e6 as dt from t), gf as (select *, case when dt > 0 and (dt < 59 or dt > 61) then 1 else 0 end as is_start_after_gap from g)"


@query("trip_id:i gaps:i rows:i", f"{T}, {GAPS}, q as (select trip_id, sum(is_start_after_gap) as gaps, count(*) as rows from gf group by 1)")
def gap_flag(spark: SparkSession, d: str) -> DataFrame:
    return sequences.gap_flags(telemetry(spark, d)).groupBy(R.TRIP).agg(F.sum("is_start_after_gap").alias("gaps"), F.count("*").alias("rows"))


@query("trip_id:i src_row_id:i latitude:d", f"{T}, q as (select trip_id, src_row_id, latitude from t where latitude between -90 and 90 and longitude between -180 and 180)")
def latlon_filter(spark: SparkSession, d: str) -> DataFrame:
    return clean.valid_positions(telemetry(spark, d))


_ZERO = "abs(latitude) <= 1e-3 and abs(longitude) <= 1e-3"


@query("trip_id:i rows:i", f"{T}, z as (select *, avg(case when {_ZERO} then 1 else 0 end) over (partition by trip_id) as share from t), q as (select trip_id, count(*) as rows from z where share <= 0.75 group by 1)")
def zero_trip_drop(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_mostly_zero_trips(telemetry(spark, d)).groupBy(R.TRIP).agg(F.count("*").alias("rows"))


@query("src_row_id:i", f"{T}, q as (select src_row_id from t where not coalesce({_ZERO}, false))")
def zero_point_drop(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_zero_points(telemetry(spark, d))


@query("src_row_id:i", f"{T}, q as (select src_row_id from t where coalesce(current_soc between 0 and 100, true) and coalesce(outside_temp between -15 and 46, true) and coalesce(current_odo between 0 and 1000000, true) and coalesce(empty_weight_kg between 950 and 4000, true))")
def range_drop(spark: SparkSession, d: str) -> DataFrame:
    return clean.in_range(telemetry(spark, d))


@query("src_row_id:i", f"{T}, q as (select src_row_id from t where len([x for x in altitude_array if x < -300 or x > 3375]) = 0)")
def range_drop_array(spark: SparkSession, d: str) -> DataFrame:
    return clean.arrays_in_range(telemetry(spark, d))


_FAST = "coalesce(len([x for x in speed_array if x < 0 or x > 250]), 0) > 0"


@query("trip_id:i", f"{T}, q as (select distinct trip_id from t where {_FAST})")
def range_trip_flag(spark: SparkSession, d: str) -> DataFrame:
    return clean.trips_out_of_range(telemetry(spark, d))


@query("trip_id:i rows:i", f"{T}, q as (select trip_id, count(*) as rows from t where trip_id not in (select trip_id from t where {_FAST}) group by 1)")
def trip_anti(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d)
    return clean.drop_trips(t, clean.trips_out_of_range(t)).groupBy(R.TRIP).agg(F.count("*").alias("rows"))


@query("src_row_id:i battery_health:d", f"""{T}, h as (select *, case when battery_health between 50 and 100 then battery_health end as good,
  max(case when battery_health not between 50 and 100 then 1 else 0 end) over (partition by trip_id) as hit from t),
  q as (select src_row_id, case when hit = 1 then coalesce(first_value(good ignore nulls) over (partition by trip_id order by t_us, src_row_id rows between current row and unbounded following),
    last_value(good ignore nulls) over (partition by trip_id order by t_us, src_row_id rows between unbounded preceding and current row)) else battery_health end as battery_health from h)""")
def range_fix_health(spark: SparkSession, d: str) -> DataFrame:
    return clean.repair_health(telemetry(spark, d))


@query("trip_id:i bad_rows:i rows:i bad_samples:i samples:i blocks:i bad_row_pct:d", f"""{T}, b as (select *, coalesce(len([x for x in speed_array if x < 0 or x > 60]), 0) as n, coalesce(len(speed_array), 0) as k from t),
  c as (select *, case when n > 0 and coalesce(lag(n) over {W}, 0) = 0 then 1 else 0 end as starts from b),
  a as (select trip_id, count(*) filter (n > 0) as bad_rows, count(*) as rows, sum(n) as bad_samples, sum(k) as samples, sum(starts) as blocks from c group by 1),
  q as (select *, 100 * bad_rows / rows as bad_row_pct from a where bad_rows > 0)""")
def agg_oor_report(spark: SparkSession, d: str) -> DataFrame:
    return clean.out_of_range_report(telemetry(spark, d), "speed_array", (0, 60))


@query("src_row_id:i", f"{T}, q as (select src_row_id from (select *, row_number() over (partition by trip_id, t_us // 300000000 order by src_row_id) as n from t) where n = 1)")
def dedup(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d).withColumn("slot", F.floor(F.col("t_us") / 300000000))
    return clean.keep_first(t, [R.TRIP, "slot"])


@query("trip_id:i", f"{T}, q as (select trip_id from t group by 1 having count(distinct car_model) > 1 or count(distinct manufacturer) > 1 or count(distinct battery_type) > 1 or count(distinct empty_weight_kg) > 1 or count(distinct message_session_id) > 1)")
def static_inconsistent(spark: SparkSession, d: str) -> DataFrame:
    return clean.inconsistent_trips(telemetry(spark, d))


_SCALARS = ("trip_id", "current_odo", "latitude", "manufacturer", "unit")


@query("name:s is_constant:b", f"{T}, u as (select *, 'km' as unit from t), q as (" + " union all ".join(f"select '{c}' as name, count(distinct {c}) + max(case when {c} is null then 1 else 0 end) = 1 as is_constant from u" for c in _SCALARS) + ")")
def const_cols(spark: SparkSession, d: str) -> DataFrame:
    return clean.constant_columns(telemetry(spark, d).withColumn("unit", F.lit("km")).select(*_SCALARS, "speed_array")).withColumnRenamed("column", "name")


@query("redundant:b", f"{T}, q as (select max(n) <= 1 as redundant from (select count(distinct message_session_id) as n from t group by trip_id))")
def redundant_id(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(clean.redundant_id(telemetry(spark, d))).alias("redundant"))


@query("trip_id:i skipped:i", f"""{T}, s as (select *, lag(t_us) over {W} as p1, lag(t_us, 2) over {W} as p2, lead(t_us) over {W} as n1, lead(t_us, 2) over {W} as n2 from t),
  q as (select trip_id, count(*) filter (n1 - p1 = 120000000 or n2 - p1 = 120000000 or n1 - p2 = 120000000) as skipped from s group by 1)""")
def skipped_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.skipped_rows(telemetry(spark, d), 120).groupBy(R.TRIP).agg(F.sum("skipped").alias("skipped"))


@query("src_row_id:i", f"{T}, q as (select src_row_id from t order by src_row_id limit 100)")
def subset_n(spark: SparkSession, d: str) -> DataFrame:
    return clean.first_rows(telemetry(spark, d), 100)


@query("trip_id:i rows:i", f"{T}, q as (select trip_id, count(*) as rows from t where trip_id not in (1, 2) group by 1)")
def exclude_trip(spark: SparkSession, d: str) -> DataFrame:
    return clean.exclude_trips(telemetry(spark, d), [1, 2]).groupBy(R.TRIP).agg(F.count("*").alias("rows"))


@query("event_id:i second:i", "e as (select event_id, try_cast(case when event_id % 5 = 0 then 'bad' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp) as x from events), q as (select event_id, epoch(x) as second from e where x is not null)")
def parse_ts(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.select("event_id", F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"))
    return clean.parse_timestamps(e).select("event_id", F.unix_seconds("timestamp").alias("second"))


@query("trip_id:i rows:i", f"{T}, a as (select trip_id, count(*) as rows, (max(t_us) - min(t_us)) / 1e6 as trip_duration, max(current_odo) - min(current_odo) as trip_distance from t group by 1), q as (select trip_id, rows from a where trip_duration > 4000 and trip_duration < 9000 and trip_distance > 5 and trip_distance < 40)")
def short_long(spark: SparkSession, d: str) -> DataFrame:
    a = telemetry(spark, d).groupBy(R.TRIP).agg(F.count("*").alias("rows"), ((F.max("t_us") - F.min("t_us")) / 1e6).alias("trip_duration"), (F.max("current_odo") - F.min("current_odo")).alias("trip_distance"))
    return clean.trips_within(a, (4000, 9000), (5, 40))


@query("trip_id:i violation_row:i value_before:d value:d violations:i", f"""{T}, s as (select *, row_number() over {W} as row_no, last_value(current_odo ignore nulls) over {_BEFORE} as p from t),
  v as (select * from s where current_odo - p < 0),
  q as (select trip_id, min(row_no) as violation_row, arg_min(p, row_no) as value_before, arg_min(current_odo, row_no) as value, count(*) as violations from v group by 1)""")
def win_sequence(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sequence_report(telemetry(spark, d), "current_odo", upwards=True)


@query("src_row_id:i battery_health:d", f"""{T}, s as (select *, row_number() over {W} as n, case when current_odo < last_value(current_odo ignore nulls) over {_BEFORE} then 1 end as o, case when battery_health > last_value(battery_health ignore nulls) over {_BEFORE} then 1 end as h from t),
  m as (select *, min(case when o = 1 then n end) over (partition by trip_id) as oa, min(case when h = 1 then n end) over (partition by trip_id) as ha from s),
  b as (select *, last_value(case when n < ha then battery_health end ignore nulls) over {_BEFORE} as good from m),
  q as (select src_row_id, case when n >= ha then good else battery_health end as battery_health from b where oa is null or n <> oa)""")
def win_fix_odo_health(spark: SparkSession, d: str) -> DataFrame:
    return sequences.repair_sequences(telemetry(spark, d))


@query("trip_id:i row_no:i value_before:d value:d diff:d", f"{T}, s as (select trip_id, row_number() over {W} as row_no, lag(current_soc) over {W} as value_before, current_soc as value from t), q as (select *, value - value_before as diff from s where value - value_before > 1.15)")
def win_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return sequences.step_violations(telemetry(spark, d), "current_soc", 0, 1.15, "pos")


@query("trip_id:i row_no:i diff:d", f"{T}, s as (select trip_id, row_number() over {W} as row_no, speed_array[1] - lag(speed_array[-1]) over {W} as diff from t), q as (select * from s where diff < 0 and -diff > 30)")
def win_consec_between(spark: SparkSession, d: str) -> DataFrame:
    return sequences.step_violations(telemetry(spark, d), "speed_array", 0, 30, "neg", kind="array")


@query("trip_id:i row_no:i sample:i diff:d", f"{T}, s as (select trip_id, row_number() over {W} as row_no, speed_array as a from t), u as (select trip_id, row_no, unnest(range(1, len(a))) as sample, a from s), q as (select trip_id, row_no, sample, a[sample + 1] - a[sample] as diff from u where abs(a[sample + 1] - a[sample]) > 45)")
def win_consec_within(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sample_violations(telemetry(spark, d), "speed_array", 0, 45)


def _km(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}latitude - {a}latitude) / 2), 2) + cos(radians({a}latitude)) * cos(radians({b}latitude)) * pow(sin(radians({b}longitude - {a}longitude) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h}))))"


@query("trip_id:i row_no:i km:d", f"""{T}, s as (select trip_id, t_us, src_row_id, row_number() over {W} as row_no, latitude, longitude, case when latitude between -90 and 90 and longitude between -180 and 180 then row_no end as ok from t),
  p as (select *, last_value(case when ok is not null then latitude end ignore nulls) over {_BEFORE} as p_latitude, last_value(case when ok is not null then longitude end ignore nulls) over {_BEFORE} as p_longitude from s),
  k as (select trip_id, row_no, {_km("p_", "")} as km from p where ok is not null), q as (select * from k where km > 0.5)""")
def win_consec_location(spark: SparkSession, d: str) -> DataFrame:
    return sequences.location_steps(telemetry(spark, d), 0.5)


@query("src_row_id:i", f"{T}, {GAPS}, n as (select *, max(is_start_after_gap) over (partition by trip_id order by t_us, src_row_id rows between 2 preceding and 2 following) as near from gf), q as (select src_row_id from n where near = 1)")
def context_rows(spark: SparkSession, d: str) -> DataFrame:
    return sequences.context(sequences.gap_flags(telemetry(spark, d)), "is_start_after_gap", 2)


@query("src_row_id:i gaps_near:i", f"{T}, {GAPS}, n as (select *, sum(is_start_after_gap) over (partition by trip_id order by t_us, src_row_id rows between 5 preceding and 5 following) as gaps_near from gf), q as (select * from n where is_start_after_gap = 1 and gaps_near > 1)")
def multi_gap_context(spark: SparkSession, d: str) -> DataFrame:
    return sequences.multi_gaps(sequences.gap_flags(telemetry(spark, d)), 5)


@query("src_row_id:i island:i island_length:i", f"""{T}, f as (select *, coalesce(current_soc > 90, false) as f from t), c as (select *, case when f = lag(f) over {W} then 0 else 1 end as c from f),
  i as (select *, sum(c) over (partition by trip_id order by t_us, src_row_id rows unbounded preceding) as island from c), q as (select *, count(*) over (partition by trip_id, island) as island_length from i)""")
def win_islands(spark: SparkSession, d: str) -> DataFrame:
    return sequences.islands(telemetry(spark, d), F.col("current_soc") > 90)


@query("src_row_id:i edge_error:i", f"{T}, e as (select *, case when {_FAST.replace('250', '70')} then 1 else 0 end as e from t), n as (select *, lead(e) over {W} as nx from e), q as (select src_row_id, greatest(e, nx) as edge_error from n where nx is not null)")
def dp_edges(spark: SparkSession, d: str) -> DataFrame:
    return sequences.edges(telemetry(spark, d), arrays.any_outside(F.col("speed_array"), 0, 70))


@query("trip_id:i kwh:d", f"{T}, k as (select distinct trip_id, trim(regexp_replace(regexp_replace(car_model, '\\s+', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g')) as car_model, manufacturer, battery_type from t), b(car_model, manufacturer, battery_type, kwh) as (values " + ", ".join(f"('{a}', '{b}', '{c}', {v})" for a, b, c, v in reference.BATTERIES) + "), q as (select trip_id, kwh from k left join b using (car_model, manufacturer, battery_type))")
def join_battery(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d).select(R.TRIP, *reference.KEYS).distinct()
    return reference.with_battery(t).withColumnRenamed("battery_capacity_kwh", "kwh")


@query("doc_id:i cleaned:s", "q as (select doc_id, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g')) as cleaned from documents)")
def fn_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.clean_text(F.col("text")).alias("cleaned"))


@query("src_row_id:i km:d", f"{T}, p as (select *, 48.8566 as p_latitude, 2.3522 as p_longitude from t), q as (select src_row_id, {_km('p_', '')} as km from p)")
def fn_haversine(spark: SparkSession, d: str) -> DataFrame:
    return telemetry(spark, d).withColumn("km", scalars.haversine_km(F.lit(48.8566), F.lit(2.3522), F.col("latitude"), F.col("longitude")))


@query("src_row_id:i bin:i hour:i dow:i month:i div:d clipped:d", f"{T}, q as (select src_row_id, case when current_soc between 80 and 95 then greatest(1, least(5, ceil((current_soc - 80) / 3))) else 0 end as bin, hour(make_timestamp(cast(t_us as bigint))) as hour, isodow(make_timestamp(cast(t_us as bigint))) - 1 as dow, month(make_timestamp(cast(t_us as bigint))) as month, case when abs(outside_temp) > 1e-6 then current_soc / outside_temp end as div, case when outside_temp < 0 then 0 when outside_temp > 30 then 30 else outside_temp end as clipped from t)")
def fn_scalars(spark: SparkSession, d: str) -> DataFrame:
    ts = scalars.start_parts(F.col(R.TIME))
    return telemetry(spark, d).select(
        "src_row_id", F.coalesce(scalars.equal_bins(F.col("current_soc"), 80, 95), F.lit(0)).alias("bin"), ts["hour"].alias("hour"), ts["dayofweek"].alias("dow"), ts["month"].alias("month"),
        scalars.safe_div(F.col("current_soc"), F.col("outside_temp")).alias("div"), scalars.clip(F.col("outside_temp"), 0, 30).alias("clipped"),
    )


@query("src_row_id:i mean:d slow:d top:d first:d last:d step:d km:d outside:i n:i", f"""{T}, q as (select src_row_id, list_avg(speed_array) as mean, coalesce(len([x for x in speed_array if x < 0.5]) / len(speed_array), 0) as slow, coalesce(list_max(speed_array), 1e9) as top,
  speed_array[1] as first, speed_array[-1] as last, list_max([abs(speed_array[i + 1] - speed_array[i]) for i in range(1, {6})]) as step, list_sum(speed_array) / 3600 as km, coalesce(len([x for x in speed_array if x < 0 or x > 60]), 0) as outside, coalesce(len(speed_array), -1) as n from t)""")
def arr_stats(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("speed_array")
    return telemetry(spark, d).select(
        "src_row_id", arrays.mean(a).alias("mean"), arrays.share_below(a, 0.5).alias("slow"), F.least(F.lit(1e9), arrays.max_or_inf(a)).alias("top"), arrays.first(a).alias("first"), arrays.last(a).alias("last"),
        arrays.max_step(a).alias("step"), arrays.total_km(a).alias("km"), arrays.count_outside(a, 0, 60).alias("outside"), arrays.length(a).alias("n"),
    )


@query("src_row_id:i", f"{T}, q as (select src_row_id from t where len(speed_array) <> 5)")
def agg_array_len(spark: SparkSession, d: str) -> DataFrame:
    return clean.wrong_lengths(telemetry(spark, d), "speed_array", 5)


_D = f"""dd as (select *, row_number() over {W} as n, (t_us - lag(t_us) over {W}) / 1e6 as time_s, current_odo - lag(current_odo) over {W} as odo_km, current_soc - lag(current_soc) over {W} as soc_pct,
  lag(latitude) over {W} as p_latitude, lag(longitude) over {W} as p_longitude, list_sum(speed_array) / 3600 as dist, list_max([abs(speed_array[i + 1] - speed_array[i]) for i in range(1, 6)]) as v_in,
  list_avg(altitude_array) - lag(list_avg(altitude_array)) over {W} as alt_m, speed_array[1] - lag(speed_array[-1]) over {W} as v_edge, altitude_array[1] - lag(altitude_array[-1]) over {W} as a_edge from t),
  de as (select *, {_km("p_", "")} as gps_km from dd where n > 1)"""


@query("src_row_id:i d_time_s:d d_odo_km:d d_soc_pct:d d_gps_km:d d_dist_from_speed_km:d d_speed_max_internal:d d_alt_m:d d_speed_edge:d d_alt_edge:d", f"{T}, {_D}, q as (select src_row_id, time_s as d_time_s, odo_km as d_odo_km, soc_pct as d_soc_pct, gps_km as d_gps_km, dist as d_dist_from_speed_km, v_in as d_speed_max_internal, alt_m as d_alt_m, v_edge as d_speed_edge, a_edge as d_alt_edge from de)")
def deltas(spark: SparkSession, d: str) -> DataFrame:
    numbered = quality.deltas(telemetry(spark, d)).withColumn("_n", F.row_number().over(R.ordered()))
    return numbered.where("_n > 1")


_RULES_SQL = {
    "odo_gps_ratio": "greatest(abs(odo_km), abs(gps_km)) > 0.05 and least(abs(odo_km), abs(gps_km)) > 1e-6 and greatest(abs(odo_km), abs(gps_km)) / greatest(least(abs(odo_km), abs(gps_km)), 1e-6) > 3",
    "gps_far": "gps_km > 3", "grade": "abs(odo_km) >= 0.05 and abs(alt_m / (odo_km * 1000)) > 0.25", "energy_per_100km": "abs(odo_km) > 0.5 and e < 0 and (-e / odo_km * 100 < 2 or -e / odo_km * 100 > 60)",
    "speed_spike": "v_in > 40", "alt_spike": "abs(a_edge) > 25", "charging_while_moving": "soc_pct > 0.01 and gps_km > 0.01", "uphill_no_energy": "alt_m > 20 and soc_pct < 0.1",
    "time_gap": "time_s < 59 or time_s > 61", "descent_no_speed_change": "alt_m < -50 and abs(v_edge) < 5", "speed_spike_stationary": "v_in > 30 and abs(gps_km) < 0.02",
    "odo_jump_short_time": "abs(odo_km) > 1 and time_s < 10", "teleport_no_energy": "gps_km > 2 and abs(soc_pct) < 0.5", "unrealistic_regen": "alt_m < -100 and soc_pct < -2",
}


@query("rule:s row_hits:i trip_hits:i", f"{T}, {_D}, ee as (select *, soc_pct / 100 * 50 as e from de), q as (" + " union all ".join(f"select '{k}' as rule, count(*) filter ({c}) as row_hits, count(distinct case when {c} then trip_id end) as trip_hits from ee" for k, c in _RULES_SQL.items()) + ")")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d).withColumn("battery_capacity_kwh", F.lit(50.0))
    return quality.hits(quality.flags(quality.deltas(t)))


@query("src_row_id:i fired:s", f"{T}, {_D}, ee as (select *, soc_pct / 100 * 50 as e from de), f as (select src_row_id, concat_ws(',', " + ", ".join(f"case when {c} then '{k}' end" for k, c in _RULES_SQL.items()) + ") as fired from ee), q as (select * from f where fired <> '')")
def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d).withColumn("battery_capacity_kwh", F.lit(50.0))
    return quality.analyse(t).withColumn("fired", F.array_join("fired", ","))


@query("trip_id:i odo:d temp:d", f"{T}, q as (select trip_id, arg_min(current_odo, (t_us, src_row_id)) as odo, arg_min(outside_temp, (t_us, src_row_id)) filter (outside_temp is not null) as temp from t group by 1)")
def agg_trip_level(spark: SparkSession, d: str) -> DataFrame:
    from voltrail.operators import features

    return features.trip_level(telemetry(spark, d), ["current_odo", "outside_temp"]).select(R.TRIP, F.col("current_odo").alias("odo"), F.col("outside_temp").alias("temp"))


_STATIONS = [(f"s{k:02d}", 40.0 + k % 11, 2.0 + k * 5 % 8) for k in range(40)]
_STATIONS_SQL = "st(station_id, slat, slon) as (values " + ", ".join(f"('{a}', {b}::double, {c}::double)" for a, b, c in _STATIONS) + ")"


@query("latitude:d longitude:d km:d", f"""{T}, {_STATIONS_SQL}, p as (select distinct latitude, longitude from t where latitude is not null and longitude is not null),
  x as (select latitude, longitude, slat as p_latitude, slon as p_longitude from p, st), q as (select latitude, longitude, min({_km("p_", "")}) as km from x group by 1, 2)""")
def nearest_station(spark: SparkSession, d: str) -> DataFrame:
    stations = spark.createDataFrame(_STATIONS, "station_id string, latitude double, longitude double")
    t = telemetry(spark, d).select("latitude", "longitude").where("latitude is not null and longitude is not null").distinct()
    return places.nearest_station(t, stations).withColumnRenamed("station_km", "km")


@query("src_row_id:i temp:d temp_suspect:b", f"{T}, h as (select distinct t_us // 3600000000 as h from t), q as (select src_row_id, (t_us // 3600000000) % 30 as temp, coalesce(abs(outside_temp - (t_us // 3600000000) % 30) > 5, false) as temp_suspect from t)")
def hourly_weather(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d).withColumn("station_id", F.lit("s01"))
    hours = t.select("station_id", F.date_trunc("hour", R.TIME).alias("hour")).distinct().withColumn("temp", (F.unix_seconds("hour") / 3600 % 30).cast("double"))
    return places.suspect_temperatures(places.hourly_weather(t, hours))


#: Made-up outlines: two countries, one with a hole, and a triangle.
_SHAPES = {
    "X": [[(3.0, 41.0), (7.0, 41.0), (7.0, 46.0), (3.0, 46.0)], [(4.0, 43.0), (6.0, 43.0), (6.0, 44.5), (4.0, 44.5)]],
    "Y": [[(7.3, 42.0), (9.0, 42.25), (7.5, 48.0)]],
}
_SIDES_SQL = "sides(p, x1, y1, x2, y2) as (values " + ", ".join(f"('{k}', {a}::double, {b}::double, {c}::double, {e}::double)" for k, rings in _SHAPES.items() for r in rings for (a, b), (c, e) in zip(r, [*r[1:], r[0]])) + ")"
_IN_SQL = f"""{_SIDES_SQL}, placed as (select distinct latitude as y, longitude as x from t where latitude is not null and longitude is not null),
  hits as (select p, x, y, count(*) filter ((y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 as inside from placed, sides group by 1, 2, 3), held as (select x, y, bool_or(inside) as inside from hits group by 1, 2)"""
_K = f"{places.METRES_A_DEGREE!r}::double"
_NEAR_SQL = f"""gaps as (select x, y, (x1 - x) * cos(radians(y)) as ax, y1 - y as ay, (x2 - x) * cos(radians(y)) as bx, y2 - y as "by" from placed, sides),
  feet as (select x, y, ax, ay, bx - ax as dx, "by" - ay as dy, greatest(0.0::double, least(1.0::double, -(ax * (bx - ax) + ay * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) as u from gaps),
  near as (select x, y, min(sqrt((ax + u * dx) * (ax + u * dx) + (ay + u * dy) * (ay + u * dy))) * {_K} as m from feet group by 1, 2)"""


def outlines(spark: SparkSession) -> DataFrame:
    rows = [(k, [[{"lon": a, "lat": b} for a, b in r] for r in rings]) for k, rings in _SHAPES.items()]
    return spark.createDataFrame(rows, "country string, rings array<array<struct<lon:double,lat:double>>>")


@query("trip_id:i latitude:d longitude:d", f"{T}, {_IN_SQL}, {_NEAR_SQL}, q as (select trip_id, latitude, longitude from t join held on latitude = held.y and longitude = held.x join near on near.x = held.x and near.y = held.y where not inside and m > 1000)")
def outside_area(spark: SparkSession, d: str) -> DataFrame:
    return places.outside_area(telemetry(spark, d), places.index(outlines(spark), buffer_m=1_000))


@query("src_row_id:i current_soc:d outside_temp:d latitude:d", f"{T}, q as (select src_row_id, current_soc, outside_temp, latitude from t)")
def rename_prune(spark: SparkSession, d: str) -> DataFrame:
    raw = {v: k for k, v in clean.STANDARD_NAMES.items()}
    source = telemetry(spark, d).select("src_row_id", "battery_type", *(F.col(c).alias(raw[c]) for c in ("current_soc", "outside_temp", "latitude")))
    return clean.rename_prune(source)


@query("trip_id:i row_no:i sample:i around:i total:d", f"""{T}, s as (select trip_id, row_number() over {W} as row_no, speed_array as a from t), u as (select trip_id, row_no, unnest(range(1, len(a))) as sample, a from s),
  v as (select *, a[greatest(1, sample - 1):sample + 3] as c from u where abs(a[sample + 1] - a[sample]) > 45), q as (select trip_id, row_no, sample, len(c) as around, list_sum(c) as total from v)""")
def violation_context(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d)
    found = sequences.sample_context(sequences.sample_violations(t, "speed_array", 0, 45), t, "speed_array", 2)
    return found.withColumns({"around": F.size("samples"), "total": F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)})


@query("src_row_id:i told:s", f"{T}, q as (select src_row_id, printf('%.6f,%.6f;', longitude, latitude) || '2.352200,48.856600' as told from t where latitude is not null)")
def fn_fmt(spark: SparkSession, d: str) -> DataFrame:
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    t = telemetry(spark, d).where("latitude is not null")
    return t.withColumn("told", scalars.coordinates(F.array(point(F.col("longitude"), F.col("latitude")), point(F.lit(2.3522), F.lit(48.8566)))))


@query("src_row_id:i land:b", f"{T}, {_IN_SQL}, q as (select src_row_id, inside as land from t join held on latitude = y and longitude = x)")
def on_land(spark: SparkSession, d: str) -> DataFrame:
    placed = telemetry(spark, d).where("latitude is not null and longitude is not null")
    return places.on_land(placed, places.index(outlines(spark)))


_DIGITS = [f"(src_row_id * {2 * r + 3} // {r + 2}) % {7 if r % 5 else 6}" for r in range(1, 16)]
_BASE, _RES = "src_row_id * 7 % 122", "src_row_id % 16"
#: Cell indexes of all resolutions and base cells; some have a digit too many, a few are of another kind.
_CELL = f"case when src_row_id % 31 = 0 then 1 else 576460752303423488 end + ({_RES}) * 4503599627370496 + ({_BASE}) * 35184372088832" + "".join(
    f" + case when {r} <= {_RES} and not (src_row_id % 29 = 0 and {r} = 2) then {d} else 7 end * {1 << 3 * (15 - r)}" for r, d in enumerate(_DIGITS, 1)
)


def _cells_sql() -> str:
    base = ", ".join(f"({k}, {f}, {a}, {b}, {str(p).lower()})" for k, (f, a, b, p) in enumerate(cells.BASE_CELLS))
    steps = [*cells.STEPS, *cells.TURNED]
    column = lambda rows, k: "[" + ", ".join(str(r[k]) for r in rows) + "]"
    reals = lambda k: "[" + ", ".join(f"{f[k]!r}::double" for f in cells.FACES) + "]"
    names = ["g", "m1", "m2", "m3", "m4", "t1", "t2"]
    tables = ", ".join([*(f"{column(cells.CROSSINGS, k)} as {n}" for k, n in enumerate(names)), f"{column(steps, 0)} as sa, {column(steps, 1)} as sb, {reals(0)} as la, {reals(1)} as lo, {reals(2)} as ax"])
    digits = ", ".join(f"(h >> {3 * (15 - r)}) & 7" for r in range(1, 16))
    finer = lambda odd, a, b: f"{{'a': case when {odd} then 2 * {a} + {b} else 3 * {a} - {b} end, 'b': case when {odd} then 3 * {b} - {a} else {a} + 2 * {b} end}}"
    step = f"{{'a': case when d.a % 2 = 1 then 2 * s.a + s.b else 3 * s.a - s.b end + sa[d.b + 1], 'b': case when d.a % 2 = 1 then 3 * s.b - s.a else s.a + 2 * s.b end + sb[d.b + 1]}}"
    low = "least(s.a, s.b, 0)"
    edge = f"case when {low} = 0 then 0 when s.b = {low} then 1 else 2 end"
    bent = f"(pent and lead = 4 and s.n = 0 and {edge} = 1)"
    pa, pb = f"case when {bent} then 2 * unit + s.b else s.a end", f"case when {bent} then s.b - (s.a - 2 * unit) else s.b end"
    i = f"s.f * 3 + {edge} + 1"
    crossed = f"{{'f': g[{i}], 'a': m1[{i}] * ({pa}) + m2[{i}] * ({pb}) + t1[{i}] * unit, 'b': m3[{i}] * ({pa}) + m4[{i}] * ({pb}) + t2[{i}] * unit, 'n': s.n + 1}}"
    return f"""bases(base, f0, a0, b0, pent) as (values {base}), k as (select {tables}),
  c1 as (select src_row_id, {_CELL} as h from t), c2 as (select *, (h >> 52) & 15 as res, (h >> 45) & 127 as base, [{digits}] as digits from c1),
  c3 as (select c2.*, f0, a0, b0, coalesce(pent, false) as pent, coalesce(list_filter(digits[1:res], lambda x: x <> 0)[1], 0) as lead, pow(7, (res + 1) // 2)::bigint as unit from c2 left join bases using (base)),
  c4 as (select *, (h >> 56) = 8 and base < 122 and len(list_filter(digits[1:res], lambda x: x = 7)) = 0 and len(list_filter(digits[res + 1:], lambda x: x <> 7)) = 0 and not (pent and lead = 1) as valid from c3),
  c5 as (select *, list_reduce(list_prepend({{'a': a0::bigint, 'b': b0::bigint}}, [{{'a': r, 'b': digits[r] + case when pent and lead = 5 then 8 else 0 end}} for r in range(1, res + 1)]), lambda s, d: {step}) as w from c4, k where valid),
  c6 as (select *, case when res % 2 = 1 then {finer("false", "w.a", "w.b")} else w end as v from c5),
  c7 as (select *, list_reduce(list_prepend({{'f': f0::bigint, 'a': v.a, 'b': v.b, 'n': 0::bigint}}, [{{'f': 0::bigint, 'a': 0::bigint, 'b': 0::bigint, 'n': z}} for z in range(0, 6)]),
    lambda s, d: case when s.a + s.b - 3 * {low} > 2 * unit and (pent or s.n = 0) then {crossed} else s end) as o from c6),
  c8 as (select *, (o.a - o.b / 2.0::double) / unit as x, o.b * (sqrt(3.0::double) / 2) / unit as y, la[o.f + 1] as lat0, lo[o.f + 1] as lon0, ax[o.f + 1] as axis from c7),
  c9 as (select *, atan(sqrt(x * x + y * y) * {cells.UNIT!r}::double) as dist, axis - atan2(y, x) as az from c8), c10 as (select *, sin(lat0) * cos(dist) + cos(lat0) * sin(dist) * cos(az) as up from c9),
  c11 as (select src_row_id, degrees(asin(greatest(-1.0::double, least(1.0::double, up)))) as latitude, degrees(lon0 + atan2(sin(az) * sin(dist) * cos(lat0), cos(dist) - sin(lat0) * up)) + 180 as east from c10),
  q as (select src_row_id, latitude, east - 360 * floor(east / 360) - 180 as longitude from c4 left join c11 using (src_row_id))"""


@query("src_row_id:i latitude:d longitude:d", f"{T}, {_cells_sql()}")
def fn_h3(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry(spark, d).withColumn("h", F.expr(_CELL.replace("//", "div")))
    return t.select("src_row_id", cells.cell_center(F.col("h")).alias("p")).select("src_row_id", "p.*")


_KINDS = ("parquet", "csv", "json", "text")


@query("kind:s src_row_id:i outside_temp:d message_session_id:s", f"{T}, q as (select kind, src_row_id, outside_temp, message_session_id from t, (values ('parquet'), ('csv'), ('json')) k(kind) union all select 'text', src_row_id, null, message_session_id from t)")
def io_formats(spark: SparkSession, d: str) -> DataFrame:
    """A table written and read again in each format; text holds one column, here both of its values."""
    t = telemetry(spark, d).select("src_row_id", "outside_temp", "message_session_id")
    at, out = f"{shared_dir(spark)}/formats-{uuid.uuid4().hex}", []
    for kind in _KINDS:
        files.save(t.select(F.concat_ws(" ", "src_row_id", "message_session_id").alias("line")) if kind == "text" else t, f"{at}/t.{kind}", kind)
        if kind == "text":
            words = F.split("value", " ")
            back = spark.read.text(f"{at}/t.text").select(words[0].cast("long").alias("src_row_id"), F.lit(None).cast("double").alias("outside_temp"), words[1].alias("message_session_id"))
        else:
            back = files.load(spark, f"{at}/t.{kind}", t.schema)
        out.append(back.withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out)
