"""Queries on errors, distributions, splits and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.operators import features, history, metrics, models, selection
from voltrail.operators import rows as R
from voltrail.plans.registry import query
from voltrail.plans.rows import T
from voltrail.plans.segments import SMALL_SQL, labels, small
from voltrail.plans.telemetry import telemetry
from voltrail.sources.stage import staged

_P = {"outcome": "(src_row_id * 13 % 200) / 1e1", "base_error": "(src_row_id * 7 % 100) / 1e1 - 5", "other_error": "case when src_row_id % 31 = 0 then null else (src_row_id * 11 % 100) / 12e0 - 4 end"}
_PREDICTED = f"{T}, p as (select *, {', '.join(f'{v} as {k}' for k, v in _P.items())} from t), pp as (select *, outcome - base_error as predicted from p)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    p = telemetry(spark, d).selectExpr("*", *(f"{v} as {k}" for k, v in _P.items()))
    return p.withColumn("predicted", F.col("outcome") - F.col("base_error"))


def _errors(e: str, of: str = "") -> str:
    return f"avg(abs({e})) as {of}mae, sqrt(avg({e} * {e})) as {of}rmse, avg({e}) as {of}mbe, stddev_samp({e}) as {of}std_dev"


@query("trip_id:i mae:d rmse:d mbe:d std_dev:d n:i", f"{_PREDICTED}, q as (select trip_id, {_errors('other_error')}, count(other_error) as n from pp group by 1)")
def agg_error_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_metrics(predictions(spark, d), "other_error", [R.TRIP])


@query("mae:d rmse:d mbe:d std_dev:d n:i", f"{_PREDICTED}, e as (select predicted - outcome as e from pp), q as (select {_errors('e')}, count(e) as n from e)")
def agg_resid_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.residual_metrics(predictions(spark, d), "outcome", "predicted")


@query("mae:d rmse:d r2:d n:i", f"{_PREDICTED}, q as (select avg(abs(base_error)) as mae, sqrt(avg(base_error * base_error)) as rmse, 1 - avg(base_error * base_error) / var_pop(outcome) as r2, count(*) as n from pp)")
def agg_reg_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.regression_metrics(predictions(spark, d), "outcome", "predicted")


@query("metric:s base:d other:d diff:d pct:d verdict:s", f"""{_PREDICTED}, a as (select {_errors('base_error', 'b_')}, {_errors('other_error', 'o_')} from pp),
  u as (select 'mae' as metric, b_mae as base, o_mae as other, o_mae - b_mae as gain from a union all select 'rmse', b_rmse, o_rmse, o_rmse - b_rmse from a union all select 'mbe', b_mbe, o_mbe, abs(o_mbe) - abs(b_mbe) from a union all select 'std_dev', b_std_dev, o_std_dev, o_std_dev - b_std_dev from a),
  q as (select metric, base, other, other - base as diff, case when abs(base) < 1e-9 then 'inf'::double else 100 * (other - base) / abs(base) end as pct, case when gain < -1e-9 then 'Better' when gain > 1e-9 then 'Worse' else 'Same' end as verdict from u)""")
def agg_compare(spark: SparkSession, d: str) -> DataFrame:
    return metrics.compared(predictions(spark, d), "base_error", "other_error")


_PER = f"{_PREDICTED}, per as (select trip_id, {_errors('base_error', 'base_')}, {_errors('other_error', 'other_')}, count(*) as segments, avg(outcome) as avg_outcome from pp where other_error is not null group by 1)"


@query("trip_id:i base_mae:d base_rmse:d base_mbe:d base_std_dev:d other_mae:d other_rmse:d other_mbe:d other_std_dev:d segments:i avg_outcome:d", f"{_PER}, q as (select * from per)")
def agg_per_driver(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_trip(metrics.both_errors(predictions(spark, d), "base_error", "other_error"), "base_error", "other_error", "outcome")


@query("improved:i worsened:i same:i mean_gain:d median_gain:d", f"{_PER}, g as (select base_mae - other_mae as g from per), q as (select count(*) filter (g > 1e-6) as improved, count(*) filter (g < -1e-6) as worsened, count(*) filter (abs(g) <= 1e-6) as same, avg(g) as mean_gain, median(g) as median_gain from g)")
def agg_improvement(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.both_errors(predictions(spark, d), "base_error", "other_error")
    return metrics.improvement(metrics.per_trip(p, "base_error", "other_error", "outcome"))


@query("trip_id:i outcome:d", f"{_PREDICTED}, q as (select trip_id, sum(outcome) as outcome from pp group by 1)")
def agg_trip_soc(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy(R.TRIP).agg(F.sum("outcome").alias("outcome"))


@query("trip_id:i rows:i", f"{T}, q as (select trip_id, count(*) as rows from t group by 1)")
def agg_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry(spark, d).groupBy(R.TRIP).agg(F.count("*").alias("rows"))


_D = ("outside_temp", "current_soc", "battery_health", "latitude")


@query("column:s n:i mean:d std:d min:d p25:d p50:d p75:d max:d", f"{T}, q as (" + " union all ".join(f"select '{c}' as \"column\", count({c}) as n, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.75) as p75, max({c}) as max from t" for c in _D) + ")")
def agg_describe(spark: SparkSession, d: str) -> DataFrame:
    return metrics.describe_all(telemetry(spark, d), _D)


_C = ("battery_health", "current_soc", "outside_temp")


@query("a:s b:s r:d", f"{T}, q as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from t" for i, a in enumerate(_C) for b in _C[i + 1 :]) + ")")
def agg_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.correlations(telemetry(spark, d), _C)


@query("feature:s r:d", f"{_PREDICTED}, q as (" + " union all ".join(f"select '{c}' as feature, corr({c}, outcome) as r from pp" for c in _C) + ")")
def agg_corr_target(spark: SparkSession, d: str) -> DataFrame:
    return metrics.target_correlations(predictions(spark, d), _C, "outcome")


@query("model:s mae:d", f"{_PREDICTED}, m as (select 'base' as model, avg(abs(base_error)) as mae from pp union all select 'other', avg(abs(other_error)) from pp), q as (select * from m order by mae, model limit 1)")
def agg_best(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    m = p.select(F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("base_error").alias("e")), F.struct(F.lit("other").alias("model"), F.col("other_error").alias("e")))).alias("x")).select("x.*")
    return metrics.best_model(metrics.error_metrics(m, "e", ["model"]))


@query("feature:s dropped:b", f"{T}, q as (" + " union all ".join(f"select '{c}' as feature, coalesce(var_pop({c}) <= 1.0, true) as dropped from t" for c in _C) + ")")
def nzv(spark: SparkSession, d: str) -> DataFrame:
    gone = selection.low_variance(telemetry(spark, d), _C, 1.0)
    return spark.createDataFrame([(c, c in gone) for c in _C], "feature string, dropped boolean")


def _hash_sql(key: str) -> str:
    return f"CAST(('0x' || substr(md5('42:' || {key}::VARCHAR), 1, 13)) AS BIGINT)"


@query("trip_id:i is_test:b", f"{T}, n as (select *, row_number() over (order by {_hash_sql('trip_id')}) as r, count(*) over () as n from (select distinct trip_id from t)), q as (select trip_id, n >= 2 and r <= greatest(1, least(n - 1, floor(n * 0.25))) as is_test from n)")
def split_trips(spark: SparkSession, d: str) -> DataFrame:
    return selection.split_trips(telemetry(spark, d)).select(R.TRIP, "is_test").distinct()


@query("src_row_id:i is_test:b", f"{T}, q as (select src_row_id, {_hash_sql('src_row_id')} < {int(0.2 * (1 << 52))} as is_test from t)")
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return selection.split_rows(telemetry(spark, d), ["src_row_id"])


@query("src_row_id:i", f"{T}, q as (select src_row_id from t order by {_hash_sql('src_row_id')}, src_row_id limit 200)")
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return selection.sample(telemetry(spark, d), 200, ["src_row_id"])


_NUMBERS = ["soc_seg_start", "odo_seg_start", "distance_seg_actual_km", "duration_seg_actual_s"]


@query("trip_id:i segment_id:i model:s actual:d predicted:d")
def loso_eval(spark: SparkSession, d: str) -> DataFrame:
    return history.leave_one_out(small(spark, d), _NUMBERS, "gt_soc_seg_delta")


@query("trip_id:i segment_id:i model:s actual:d predicted:d")
def wf_eval(spark: SparkSession, d: str) -> DataFrame:
    return history.walk_forward(small(spark, d), _NUMBERS, "gt_soc_seg_delta")


def _line_sql(over: str) -> str:
    """Predictions from one input by the rows of a window: a line, and the line with a ridge penalty of 1 on the standardised input."""
    x, y = "distance_seg_actual_km", "gt_soc_seg_delta"
    return f"""{SMALL_SQL}, f as (select trip_id, segment_id, {x} as x, {y} as y, count(*) over {over} as n, avg({x}) over {over} as mx, avg({y}) over {over} as my, var_pop({x}) over {over} as v, covar_pop({x}, {y}) over {over} as c from sm),
  q as (select trip_id, segment_id, m as model, y as actual, my + c / v * (x - mx) * case when m = 'ridge' then n / (n + 1.0::double) else 1 end as predicted from f, (values ('linear'), ('ridge')) k(m) where n >= 3 and v > 1e-3)"""


_LINE = "trip_id:i segment_id:i model:s actual:d predicted:d"


@query(_LINE, _line_sql("(partition by trip_id rows between unbounded preceding and unbounded following exclude current row)"))
def loso_line(spark: SparkSession, d: str) -> DataFrame:
    return history.leave_one_out(small(spark, d), ["distance_seg_actual_km"], "gt_soc_seg_delta")


@query(_LINE, _line_sql("(partition by trip_id order by segment_id rows between unbounded preceding and 1 preceding)"))
def wf_line(spark: SparkSession, d: str) -> DataFrame:
    """The same forward, each trip of more than three segments in pieces."""
    return history.walk_forward(small(spark, d), ["distance_seg_actual_km"], "gt_soc_seg_delta", most_segments=3)


_TEXTS = ["manufacturer_trip", "car_model_trip"]


def _global(seg: DataFrame) -> tuple[str, dict[str, PipelineModel], DataFrame]:
    """The best of the four candidates on held-out trips, all of them fitted, and the training rows."""
    whole = staged(selection.split_trips(seg))
    train = whole.where("not is_test")
    fitted, table = models.fit_all(train, whole.where("is_test"), _NUMBERS, _TEXTS, "gt_soc_seg_delta")
    return metrics.best_model(table).first()["model"], fitted, train


@query("trip_id:i segment_id:i is_test:b personal_prediction:d personal_error:d")
def lgr_eval(spark: SparkSession, d: str) -> DataFrame:
    """A first model over all trips, then a model of its residual from the trip's other segments; each the best of all four candidates."""
    seg = staged(small(spark, d))

    def personal(first: PipelineModel) -> DataFrame:
        told = staged(features.with_global_prediction(seg, first, [*_NUMBERS, *_TEXTS]))
        others = history.others(told, ["residual_error_soc_seg_delta", "distance_seg_actual_km"])
        whole = staged(told.join(others, history.KEYS))
        columns = [*_NUMBERS, "others_avg_residual_error_soc_seg_delta", "others_std_residual_error_soc_seg_delta", "others_avg_distance_seg_actual_km"]
        return models.residual_model(whole, columns, _TEXTS, "residual_error_soc_seg_delta", "global_pred_soc_seg_delta", "gt_soc_seg_delta")[0]

    parts = staged(selection.split_trips(seg))
    return models.with_best(parts.where("not is_test"), parts.where("is_test"), _NUMBERS, _TEXTS, "gt_soc_seg_delta", personal)


_PAIR = ("distance_seg_actual_km", "duration_seg_actual_s")


@query("feature:s importance:d", f"""{SMALL_SQL}, c as (select corr({_PAIR[0]}, gt_soc_seg_delta) as r1, corr({_PAIR[1]}, gt_soc_seg_delta) as r2, corr({_PAIR[0]}, {_PAIR[1]}) as r, stddev_pop(gt_soc_seg_delta) as s from sm),
  u as (select '{_PAIR[0]}' as feature, abs((r1 - r2 * r) / (1 - r * r) * s) as importance from c union all select '{_PAIR[1]}', abs((r2 - r1 * r) / (1 - r * r) * s) from c), q as (select * from u order by importance desc, feature limit 2)""")
def topk_importance(spark: SparkSession, d: str) -> DataFrame:
    """The two most important inputs of a fitted linear model: sizes of coefficients of standardised inputs."""
    seg = staged(small(spark, d).select(*history.KEYS, *_PAIR, "gt_soc_seg_delta").dropna())
    fitted = models.pipeline(_PAIR, [], models.regressors(seg, "gt_soc_seg_delta")["linear"], seg.count()).fit(seg)
    return spark.createDataFrame(models.importances(fitted, seg)[:2], "feature string, importance double")


@query("trip_id:i segment_id:i global_pred_soc_seg_delta:d residual_error_soc_seg_delta:d", f"""{SMALL_SQL}, fit as (select regr_slope(gt_soc_seg_delta, distance_seg_actual_km) as k, regr_intercept(gt_soc_seg_delta, distance_seg_actual_km) as b from sm),
  told as (select trip_id, segment_id, gt_soc_seg_delta, case when distance_seg_actual_km is not null then k * distance_seg_actual_km + b end as global_pred_soc_seg_delta from sm, fit), q as (select *, gt_soc_seg_delta - global_pred_soc_seg_delta as residual_error_soc_seg_delta from told)""")
def feat_global(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of one linear model of the distance, fitted on all segments, joined to them."""
    seg = staged(small(spark, d))
    x, target = ["distance_seg_actual_km"], "gt_soc_seg_delta"
    rows = selection.model_rows(seg, x, target).dropna()
    return features.with_global_prediction(seg, models.pipeline(x, [], models.regressors(rows, target)["linear"]).fit(rows), x)


@query("trip_id:i segment_id:i soc_seg_start:d duration_seg_actual_s:d gt_soc_seg_delta:d", f"{SMALL_SQL}, q as (select * from sm where gt_soc_seg_delta is not null)")
def prep_xy(spark: SparkSession, d: str) -> DataFrame:
    return selection.model_rows(small(spark, d), ["soc_seg_start", "duration_seg_actual_s", "absent"], "gt_soc_seg_delta")


@query(
    "trip_id:i segment_id:i soc_seg_start:d soc_seg_end:d gt_soc_seg_delta:d distance_seg_actual_km:d duration_seg_actual_s:d weight_trip_kg:d speed_seg_agg_mean_mps:d accel_seg_agg_mean:d jerk_abs_seg_agg_mean:d stops_seg_count:i stop_duration_seg_agg_s:d altitude_seg_agg_mean:d altitude_seg_agg_delta:d temp_seg_agg_std:d",
    f"""{SMALL_SQL}, kf as (select trip_id, segment_id, avg(v) as speed_seg_agg_mean_mps, coalesce(avg(a) filter (a > 1e-3), 0) as accel_seg_agg_mean, avg(abs(j)) as jerk_abs_seg_agg_mean from k6 group by 1, 2),
  al as (select *, list_avg(altitude_array) as alt, seg_label as segment_id from l9 where seg_label > 0),
  af as (select trip_id, segment_id, avg(alt) as altitude_seg_agg_mean, arg_max(alt, row_no) - arg_min(alt, row_no) as altitude_seg_agg_delta, stddev_samp(outside_temp) as temp_seg_agg_std from al group by 1, 2),
  q as (select * from sm join kf using (trip_id, segment_id) join af using (trip_id, segment_id))""",
)
def feat_reorder(spark: SparkSession, d: str) -> DataFrame:
    return features.all_features(labels(spark, d))


@query("trip_id:i segment_id:i outcome:d base_error:d", f"{_PREDICTED}, q as (select trip_id, src_row_id as segment_id, outcome, try_cast(case when src_row_id % 41 = 0 then 'n/a' else base_error::varchar end as double) as base_error from pp)")
def eval_validate(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("src_row_id") % 41 == 0, "n/a").otherwise(F.col("base_error").cast("string"))
    told = predictions(spark, d).withColumn("segment_id", F.col("src_row_id")).withColumn("base_error", text)
    return metrics.validated(told, [R.TRIP, "segment_id"], ["base_error"], "outcome")


@query("feature:s importance:d")
def model_importance(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of the best of the four candidates by importance (or size of coefficient), numbers and one-hot texts, on all segments."""
    best, fitted, train = _global(features.outcomes(labels(spark, d)))
    return spark.createDataFrame(models.importances(fitted[best], train), "feature string, importance double")
