"""Small hand-made tables: limits, nulls, order."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.functions import arrays, scalars
from voltrail.operators import categories, clean, history, metrics, models, quality, routes, segments, selection, sequences, windows
from voltrail.operators import rows as R
from voltrail.sources import files, reference
from voltrail.streaming import gaps

START = dt.datetime(2024, 1, 1)


def trip(spark, seconds, trip_id="a", **columns):
    rows = [(trip_id, START + dt.timedelta(seconds=s), i, *(v[i] for v in columns.values())) for i, s in enumerate(seconds)]
    kinds = {"stop_flag": "int", "speed_array": "array<double>", "altitude_array": "array<double>"}
    return spark.createDataFrame(rows, ", ".join(["trip_id string, timestamp timestamp, src_row_id long", *(f"{c} {kinds.get(c, 'double')}" for c in columns)]))


def column(df, c, order="src_row_id"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_gap_limits(spark):
    df = trip(spark, [0, 58, 117, 177, 238, 300, 300])
    assert column(sequences.gap_flags(df), "is_start_after_gap") == [0, 1, 0, 0, 0, 1, 0]


def test_zero_trips_strictly_above(spark):
    def of(n, share):
        k = round(n * share)
        return trip(spark, range(n), latitude=[0.0005] * k + [5.0] * (n - k), longitude=[0.0] * n)

    assert [clean.drop_mostly_zero_trips(of(100, s)).count() for s in (0.74, 0.75, 0.76)] == [100, 100, 0]


def test_ranges_and_nulls(spark):
    df = trip(spark, range(5), current_soc=[0.0, 100.0, 100.1, -0.1, None])
    assert column(clean.in_range(df, {"current_soc": (0, 100)}), "src_row_id") == [0, 1, 4]
    df = trip(spark, range(4), altitude_array=[[1.0, float("nan")], [], None, [3376.0]])
    assert column(clean.arrays_in_range(df), "src_row_id") == [1, 2]


def test_health_repair(spark):
    df = trip(spark, range(5), battery_health=[10.0, 90.0, 20.0, 80.0, 30.0])
    assert column(clean.repair_health(df), "battery_health") == [90, 90, 80, 80, 80]
    df = trip(spark, range(2), battery_health=[10.0, 20.0])
    assert column(clean.repair_health(df), "battery_health") == [None, None]


def test_skipped_rows(spark):
    assert column(clean.skipped_rows(trip(spark, [0, 30, 60, 120])), "skipped") == [0, 1, 0, 0]
    assert column(clean.skipped_rows(trip(spark, [0, 20, 40, 60])), "skipped") == [0, 1, 1, 0]


def test_keep_first_by_input_order(spark):
    df = trip(spark, [0, 0, 60], current_soc=[1.0, 2.0, 3.0]).repartition(3)
    assert column(clean.keep_first(df), "current_soc") == [1, 3]


def test_sequences_judged_on_the_same_rows(spark):
    df = trip(spark, range(4), current_odo=[1.0, 2.0, 1.5, 3.0], battery_health=[90.0, 91.0, 89.0, 88.0])
    out = sequences.repair_sequences(df)
    assert column(out, "src_row_id") == [0, 1, 3]
    assert column(out, "battery_health") == [90, 90, 90]


def test_stop_limits(spark):
    speed = [[1.99] + [0.0] * 9, [2.0] + [0.0] * 9, [0.0] * 89 + [1.0] * 11, [0.0] * 9 + [1.0], None, [float("nan")]]
    df = trip(spark, range(6), speed_array=speed, current_odo=[0.0] * 6)
    assert column(segments.stop_flags(df), "stop_flag") == [-1, 0, 0, -1, 0, 0]
    df = trip(spark, range(3), speed_array=[[0.0]] * 3, current_odo=[0.0, 0.049, 0.1])
    assert column(segments.stop_flags(df), "stop_flag") == [-1, -1, 0]


def by_loop(flags, min_rows, full_stop):
    """Labels by walking along the rows."""
    n, out, blocks, now = len(flags), list(flags), [], []
    i = 0
    while i < n:
        j = i
        while j < n and flags[j] == flags[i] == -1:
            j += 1
        if flags[i] == -3 or j - i >= full_stop:
            blocks.append(now)
            now, i = [], max(j, i + 1)
        elif flags[i] == -1:
            now += range(i, j)
            i = j
        else:
            if flags[i] == -2:
                blocks.append(now)
                now = []
            now.append(i)
            i += 1
    blocks.append(now)
    seg = 0
    for block in blocks:
        zeros = [k for k in block if flags[k] == 0]
        driving = [k for k in block if flags[k] in (0, -2) and zeros and k <= zeros[-1]]
        parts = len(driving) // min_rows
        if not parts:
            continue
        at = 0
        for extra in segments.parted(len(driving) % min_rows, parts):
            own = [k for k in driving[at : at + min_rows + extra] if flags[k] == 0]
            at += min_rows + extra
            seg += bool(own)
            for k in own:
                out[k] = seg
    return out


@pytest.mark.parametrize(("min_rows", "full_stop"), [(3, 2), (5, 3), (10, 3)])
def test_labels_as_by_loop(spark, min_rows, full_stop):
    r = random.Random(min_rows)
    trips = {f"t{k:02d}": [r.choices([0, -1, -2, -3], [12, 3, 1, 1])[0] for _ in range(r.randint(1, 90))] for k in range(40)}
    rows = [(t, START + dt.timedelta(minutes=i), i, f) for t, fs in trips.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "trip_id string, timestamp timestamp, src_row_id long, stop_flag int").repartition(5)
    got: dict = {}
    for x in segments.label_segments(df, min_rows, full_stop).orderBy("trip_id", "row_no").collect():
        got.setdefault(x["trip_id"], []).append(x["seg_label"])
    assert got == {t: by_loop(fs, min_rows, full_stop) for t, fs in trips.items()}


def test_parted_sums():
    for total in range(12):
        for parts in range(1, 8):
            p = segments.parted(total, parts)
            assert sum(p) == total and len(p) == parts and min(p) >= 0
            assert p == segments.parted(total, parts)


def test_arrays(spark):
    a = F.col("a")
    df = spark.createDataFrame([([1.0, None, 3.0],), ([],), (None,), ([float("nan")],)], "a array<double>")
    out = df.select(arrays.mean(a), arrays.max_or_inf(a), arrays.share_below(a, 2), arrays.max_step(a), arrays.length(a)).collect()
    assert [tuple(r) for r in out] == [(2, 3, 1 / 3, 2, 3), (None, float("inf"), 0, None, 0), (None, float("inf"), 0, None, -1), (None, float("inf"), 0, None, 1)]
    v = spark.createDataFrame([([float(x * x) for x in range(7)],)], "a array<double>").select(arrays.resampled(a, F.lit(20)).alias("r")).first()["r"]
    assert np.allclose(v, np.interp(np.linspace(0, 6, 20), range(7), [x * x for x in range(7)]))
    starts = [spark.range(1).select(arrays.window_starts(F.lit(n)).alias("s")).first()["s"] for n in (29, 30, 44, 45, 60)]
    assert starts == [[], [0], [0], [0, 15], [0, 15, 30]]


def test_scalars(spark):
    assert spark.range(1).select(scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0] == pytest.approx(np.pi * 6371)
    assert spark.createDataFrame([(" a  bé ",), (None,)], "t string").select(scalars.clean_text(F.col("t"))).collect()[0][0] == "a b"
    assert spark.range(1).select(scalars.safe_div(F.lit(1.0), F.lit(1e-7))).first()[0] is None


def test_rules(spark):
    df = trip(spark, [0, 5], current_odo=[0.0, 2.0], current_soc=[50.0, 50.0], latitude=[1.0, 1.0], longitude=[1.0, 1.0], speed_array=[[0.0], [0.0, 50.0]], altitude_array=[[0.0], [0.0]])
    row = quality.analyse(df).collect()
    assert len(row) == 1
    assert set(row[0]["fired"]) >= {"speed_spike", "time_gap", "odo_jump_short_time", "speed_spike_stationary"}


def test_metrics_of_nothing(spark):
    m = metrics.error_metrics(spark.createDataFrame([(None,)], "e double"), "e").first()
    assert m["n"] == 0 and m["mae"] is None


def test_split_trips(spark):
    for n in (1, 2, 3, 40):
        df = spark.createDataFrame([(f"t{k}", s) for k in range(n) for s in range(3)], "trip_id string, segment_id int")
        sides = {(r["trip_id"], r["is_test"]) for r in selection.split_trips(df).collect()}
        assert len(sides) == n
        assert sum(x for _, x in sides) == (0 if n < 2 else max(1, min(n - 1, int(n * 0.25))))


def test_collinear(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1, float((x * 7) % 5)) for x in range(30)], "a double, b double, c double")
    gone = selection.collinear(df, ["a", "b", "c"])
    assert gone in (["a"], ["b"])
    assert selection.low_variance(df.withColumn("k", F.lit(1.0)), ["a", "k"]) == ["k"]


def test_leave_one_out_is_a_fit_of_the_rest(spark):
    rows = [("t", k, float(k), 3.0 * k + 1) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "trip_id string, segment_id int, x double, y double")
    for r in history.leave_one_out(df, ["x"], "y", {"linear": 0.0}).collect():
        assert r["predicted"] == pytest.approx(r["actual"])


def test_pairs(spark):
    rows = [(f"t{t}", s, w) for t in range(12) for s in range(1, 4) for w in range(8)]
    df = spark.createDataFrame(rows, "trip_id string, seg_id int, win_id int")
    out = windows.pairs(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["trip_id"] == r["b_trip_id"]) == (r["label"] == 1)
        assert r["label"] == 0 or r["seg_id"] != r["b_seg_id"]
    alone = windows.pairs(spark.createDataFrame([("t", 1, w) for w in range(12)] + [("u", 1, 0)], "trip_id string, seg_id int, win_id int"), same_share=1.0).collect()
    assert {r["trip_id"] for r in alone} == {"t"} and all(abs(r["win_id"] - r["b_win_id"]) >= 5 for r in alone)


@pytest.mark.parametrize("bucket", [1, 4, 1_000])
def test_windows_of_a_trip_draw_different_partners(spark, monkeypatch, bucket):
    monkeypatch.setattr(windows, "BUCKET", bucket)
    rows = [(f"t{t}", s, w) for t in range(12) for s in range(1, 3) for w in range(10)]
    out = windows.pairs(spark.createDataFrame(rows, "trip_id string, seg_id int, win_id int"), same_share=0.0).collect()
    assert len(out) == len(rows) and all(r["trip_id"] != r["b_trip_id"] for r in out)
    own = [r for r in out if r["trip_id"] == "t3"]
    assert len({r["b_trip_id"] for r in own}) >= 4 and len({(r["b_seg_id"], r["b_win_id"]) for r in own}) >= 6
    assert windows.pairs(spark.createDataFrame([("t", 1, 0)], "trip_id string, seg_id int, win_id int"), same_share=0.0).collect() == []


def test_text_and_model_sinks(spark, tmp_path):
    files.save(spark.createDataFrame([("a",), ("b",)], "line string"), f"{tmp_path}/t", "text")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()) == ["a", "b"]
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(20)], "x double, y double")
    files.save_model(models.pipeline(["x"], [], models.regressors(df, "y")["linear"]).fit(df), f"{tmp_path}/m")
    assert files.load_model(f"{tmp_path}/m").transform(df.limit(1)).count() == 1



def test_battery_lookup(spark):
    df = spark.createDataFrame([("308  V3 (P512)", "PEUGEOT", "L3 720 70AH EF 720 EN"), ("x", "y", None)], "car_model string, manufacturer string, battery_type string")
    assert sorted((r["battery_capacity_kwh"] or 0) for r in reference.with_battery(df).collect()) == [0, 54]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_files(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", 0.5)], "i int, s string, x double")
    files.save(df, f"{tmp_path}/t.{kind}", kind)
    assert [tuple(r) for r in files.load(spark, f"{tmp_path}/t.{kind}", df.schema).collect()] == [(1, "a", 0.5)]
    with pytest.raises(ValueError):
        files.load(spark, "t.pickle")


def test_sessions_over_a_stream(spark, tmp_path):
    df = trip(spark, [0, 60, 120, 1000, 1060, 90_000])
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = gaps.sessions(stream, "100 seconds").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["rows"] for r in spark.table("sessions").collect()) == [2, 3]


def test_parted_is_the_same_draw_everywhere():
    # fixed values: seed 42
    assert segments.parted(5, 3) == [0, 4, 1]
    assert segments.parted(9, 4) == [0, 0, 8, 1]


def test_labels_of_a_long_block(spark):
    n = 3 * 120 + 2  # more segments than any table of cuts would hold
    df = spark.createDataFrame([("t", START + dt.timedelta(minutes=i), i, 0) for i in range(n)], "trip_id string, timestamp timestamp, src_row_id long, stop_flag int")
    assert [x["seg_label"] for x in segments.label_segments(df, 3, 2).orderBy("row_no").collect()] == by_loop([0] * n, 3, 2)


def test_others_by_hand(spark):
    import statistics

    value = [1e9, 1.0, 2.5, None, -3.0]
    df = spark.createDataFrame([("t", k, v) for k, v in enumerate(value)] + [("alone", 0, 1.0)], "trip_id string, segment_id int, v double")
    got = {x["segment_id"]: x for x in history.others(df, ["v"], ["v"], residual="v").collect()}
    assert len(got) == len(value)
    for k, x in got.items():
        rest = [v for i, v in enumerate(value) if i != k and v is not None]
        assert x["others_segment_count"] == 4
        assert x["others_avg_v"] == pytest.approx(statistics.mean(rest)) and x["others_std_v"] == pytest.approx(statistics.stdev(rest))
        assert x["others_total_v"] == pytest.approx(sum(rest)) and x["others_abs_avg_v"] == pytest.approx(statistics.mean(map(abs, rest)))


def test_missing_columns_are_told(spark):
    df = spark.createDataFrame([("t", "x")], "trip_id string, e string")
    with pytest.raises(KeyError, match="timestamp"):
        R.sorted_by_trip_time(df)
    with pytest.raises(KeyError, match="gone"):
        metrics.validated(df, ["gone"], ["e"])
    assert metrics.validated(df, ["trip_id"], ["e"]).first()["e"] is None


def test_splits(spark):
    df = spark.createDataFrame([(t, i) for t in range(40) for i in range(3)], "trip_id long, src_row_id long")
    sides = {(x["trip_id"], x["is_test"]) for x in selection.split_trips(df).collect()}
    assert len(sides) == 40 and sum(t for _, t in sides) == 10
    assert {x["is_test"] for x in selection.split_trips(df.where("trip_id = 1")).collect()} == {False}
    assert sum(x["is_test"] for x in selection.split_trips(df.where("trip_id < 2")).collect()) == 3


def test_importances_name_one_hot_values(spark):
    rows = [(k, float(k % 7), float(k % 3), "ab"[k % 2], float(k % 7) + 10 * (k % 2)) for k in range(200)]
    df = spark.createDataFrame(rows, "trip_id long, x double, y double, c string, t double")
    fitted, table = models.fit_all(df, df, ["x", "y"], ["c"], "t", trees=5, rounds=3)
    assert sorted(fitted) == ["boosted", "forest", "linear", "ridge"] and {r["failure"] for r in table.collect()} == {None}
    for name, m in fitted.items():
        names = [n for n, _ in models.importances(m, df)]
        assert {"x", "y"} < set(names) and names[0] != "y"
        # boosting has one statistic of a text, the others a column for each of its values
        assert "c" in names if name == "boosted" else any("_c_v" in n or n in "ab" for n in names)


@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_ordered_statistics_of_the_rows_before(spark, bucket_rows):
    """Of each category the mean of the earlier rows' targets, in order of the keys' hash; one category holds most rows."""
    rows = [(k, None if k % 11 == 0 else "b" if k % 5 == 0 else "a", float(k % 9)) for k in range(120)]
    df = spark.createDataFrame(rows, "k long, c string, t double").repartition(3)
    got = {x["k"]: x["_c_target"] for x in categories.ordered(df, ["c"], "t", ["k"], bucket_rows=bucket_rows).collect()}
    order = [x["k"] for x in df.orderBy(selection.hashed(["k"], 42)).select("k").collect()]
    known, seen, sums = {k: (c, t) for k, c, t in rows}, [], {}
    for k in order:
        c, t = known[k]
        s, n = sums.get(c, (0.0, 0))
        prior = sum(seen) / len(seen) if seen else 0.0
        assert got[k] == pytest.approx((s + prior) / (n + 1))
        sums[c] = s + t, n + 1
        seen.append(t)


def test_own_target_never_enters_its_statistic(spark):
    rows = [(k, "ab"[k % 2], float(k)) for k in range(40)]
    of = lambda r: {x["k"]: x["_c_target"] for x in categories.ordered(spark.createDataFrame(r, "k long, c string, t double"), ["c"], "t", ["k"]).collect()}
    base = of(rows)
    for k in (0, 17, 39):
        changed = of([(i, c, 1e6 if i == k else t) for i, c, t in rows])
        assert changed[k] == base[k] and changed != base


def test_boosting_beats_one_hot_on_many_categories(spark):
    """Held out: a category of few rows tells its level by one number instead of a column."""
    import random

    r = random.Random(1)
    level = {f"c{k}": r.gauss(0, 5) for k in range(60)}
    rows = [(k, c := f"c{r.randrange(60)}", x := r.random(), level[c] + x + r.gauss(0, 0.3)) for k in range(1500)]
    df = spark.createDataFrame(rows, "segment_id long, c string, x double, t double")
    train, test = df.where("segment_id % 4 > 0"), df.where("segment_id % 4 = 0")
    boosted = models.regressors(train, "t", rounds=15)["boosted"]
    mae = lambda m: metrics.regression_metrics(m.transform(test), "t", "prediction").first()["mae"]
    ordered = mae(models.fit_ordered(train, ["x"], ["c"], "t", ["segment_id"], boosted))
    one_hot = mae(models.pipeline(["x"], ["c"], boosted).fit(train))
    assert ordered < 0.8 * one_hot, (ordered, one_hot)


def test_numbers_are_scaled_by_the_population(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0), (8.0, 1.0)], "x double, t double")
    out = models.pipeline(["x"], [], models.regressors(df, "t")["ridge"], 3).fit(df).transform(df)
    x = np.array([1.0, 3.0, 8.0])
    assert [v["features"][0] for v in out.select("features").collect()] == pytest.approx(((x - x.mean()) / x.std()).tolist())


def test_a_bad_fit_is_told_and_other_failures_are_raised(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k), 2.0 * k) for k in range(20)], "segment_id long, x double, t double")
    from pyspark.errors import IllegalArgumentException

    def failing(error):
        def fit(name, *a):
            raise error
        return fit

    monkeypatch.setattr(models, "_fit", failing(IllegalArgumentException("no variance")))
    fitted, table = models.fit_all(df, df, ["x"], [], "t", only=["linear"])
    assert not fitted and table.first()["failure"] == "no variance"
    monkeypatch.setattr(models, "_fit", failing(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        models.fit_all(df, df, ["x"], [], "t", only=["linear"])


def test_candidates_are_fitted_at_the_same_time(spark, monkeypatch):
    import threading

    from pyspark.errors import IllegalArgumentException

    all_there = threading.Barrier(4)

    def fit(name, *a):
        all_there.wait(20)
        raise IllegalArgumentException(name)

    df = spark.createDataFrame([(k, float(k), 2.0 * k) for k in range(20)], "segment_id long, x double, t double")
    monkeypatch.setattr(models, "_fit", fit)
    fitted, table = models.fit_all(df, df, ["x"], [], "t")
    assert not fitted and [(r["model"], r["failure"]) for r in table.collect()] == [(n, n) for n in ("linear", "ridge", "forest", "boosted")]


def test_boosting_has_no_more_tasks_than_its_rows_need(spark, monkeypatch):
    class Regressor:
        def fit(self, rows):
            self.parts, self.rows = rows.rdd.getNumPartitions(), rows.count()

    df = spark.range(40).selectExpr("id as segment_id", "id * 1e0 as x", "id * 2e0 as t").repartition(8)
    for task_rows, parts in ((100_000, 1), (20, 2), (1, 8)):
        monkeypatch.setattr(models, "TASK_ROWS", task_rows)
        models.fit_ordered(df, ["x"], [], "t", ["segment_id"], r := Regressor())
        assert (r.parts, r.rows) == (parts, 40)


@pytest.mark.parametrize(("late_mae", "best"), [(2.0, "forest"), (0.5, "boosted"), (1.0, "boosted"), (None, "forest")])
def test_what_follows_a_model_begins_before_the_late_candidates_end(spark, monkeypatch, late_mae, best):
    """It is that of the best in any case; what has begun with another one is cancelled, in threads of its own too."""
    import threading
    import time

    from pyspark import inheritable_thread_target

    begun, seen = threading.Event(), []
    table = lambda rows: spark.createDataFrame(rows, "model string, mae double")

    def fit_all(train, test, numbers, texts, target, only):
        if only == models.LATE:
            assert begun.wait(30)
            time.sleep(1)
            return {"boosted": "boosted"} if late_mae else {}, table([("boosted", late_mae)])
        return {n: n for n in only}, table([("linear", 3.0), ("ridge", None), ("forest", 1.0)])

    def then(model):
        seen.append(model)
        begun.set()
        if model == "forest" and best != "forest":
            t = threading.Thread(target=inheritable_thread_target(spark)(lambda: spark.range(2, numPartitions=2).rdd.foreach(lambda _: time.sleep(60))))
            t.start()
            t.join()
            raise RuntimeError("cancelled")
        return model

    monkeypatch.setattr(models, "fit_all", fit_all)
    df, start = spark.range(1), time.monotonic()
    assert models.with_best(df, df, [], [], "t", then) == best
    assert seen == list(dict.fromkeys(["forest", best])) and time.monotonic() - start < 30


def test_a_failure_of_a_late_candidate_is_raised(spark, monkeypatch):
    def fit_all(train, test, numbers, texts, target, only):
        if only == models.LATE:
            raise RuntimeError("lost")
        return {"linear": "linear"}, spark.createDataFrame([("linear", 1.0)], "model string, mae double")

    monkeypatch.setattr(models, "fit_all", fit_all)
    with pytest.raises(RuntimeError, match="lost"):
        models.with_best(spark.range(1), spark.range(1), [], [], "t", lambda model: model)


def test_errors_of_files(spark, tmp_path):
    from pyspark.errors import AnalysisException

    df = spark.createDataFrame([(k, f"a{k}") for k in range(40)], "i int, s string").repartition(3)
    for kind in ("parquet", "csv", "json"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            files.load(spark, f"{tmp_path}/none.{kind}", df.schema)
    with pytest.raises(ValueError, match="pickle"):
        files.load(spark, f"{tmp_path}/t.pickle")
    with pytest.raises(ValueError):
        files.save(df, f"{tmp_path}/t", "pickle")
    with pytest.raises(TypeError):
        files.save([1], f"{tmp_path}/t")
    files.save(df, f"{tmp_path}/t.json", "json")
    assert files.load(spark, f"{tmp_path}/t.json", df.schema).count() == 40
    (tmp_path / "one.json").write_text('[{"i": 1, "s": "x"},\n {"i": 2, "s": null}]')
    assert sorted(x["i"] for x in files.load(spark, f"{tmp_path}/one.json").collect()) == [1, 2]
    (tmp_path / "bad.csv").write_text("i,s\nx,y\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        spark.read.schema(df.schema).option("header", True).option("mode", "FAILFAST").csv(f"{tmp_path}/bad.csv").collect()


@pytest.mark.parametrize("few, buckets", [(1, 2), (3, 5), (2_048, 1_024)])
def test_quantiles_are_exact(spark, monkeypatch, few, buckets):
    """Against numpy: ties, one value, nulls, NaN, tiny and huge values, several columns at once."""
    monkeypatch.setattr(metrics, "FEW", few)
    monkeypatch.setattr(metrics, "BUCKETS", buckets)
    r = random.Random(few)
    columns = {
        "a": [r.gauss(0, 1) for _ in range(300)], "b": [float(r.randrange(3)) for _ in range(300)], "c": [7.0] * 300, "d": [None] * 300,
        "e": [r.choice([None, float("nan"), 1e308, -1e308, 5e-324, 0.0, 2.5]) for _ in range(300)], "f": [10.0 ** r.randrange(-300, 300) * r.choice([1, -1]) for _ in range(300)], "g": [4.0, *[None] * 299],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = metrics.quantiles(df.cache(), list(columns), shares)
    for c, v in columns.items():
        v = sorted(x for x in v if x is not None and x == x)
        for p in shares:
            if not v:
                assert got[c][p] is None
                continue
            place = (len(v) - 1) * p
            a, z = v[int(np.floor(place))], v[int(np.ceil(place))]
            assert got[c][p] == (a if a == z else pytest.approx(a + (z - a) * (place - np.floor(place)), rel=1e-12))


def test_correlations_of_many_columns(spark, monkeypatch):
    """As pandas computes them over the rows that have both values; columns that are constant, far from 0 or empty."""
    import pandas as pd

    r = np.random.default_rng(5)
    base = r.normal(size=(400, 3))
    x = base @ r.normal(size=(3, 40)) + r.normal(size=(400, 40)) * 0.5
    x[:, 3] += 1e6
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8], x[:, 9] = 3.0, np.nan, 0.1
    x[:50, 9] = np.nan
    names = [f"k{k}" for k in range(40)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names)).repartition(4)
    want = pdf.corr(min_periods=1)
    for limit in (8, 40):
        monkeypatch.setattr(metrics, "FEW_COLUMNS", limit)
        use = names if limit == 8 else names[:12]
        got = {(y["a"], y["b"]): y["r"] for y in metrics.correlations(df, use).collect()}
        assert len(got) == len(use) * (len(use) - 1) // 2
        for (a, b), v in got.items():
            if {a, b} & {"k7", "k8", "k9"}:
                assert v is None, (a, b)
            else:
                assert v == pytest.approx(want.loc[a, b], abs=1e-8)
    monkeypatch.setattr(metrics, "FEW_COLUMNS", 2)
    told = metrics.target_correlations(df, names[:3], "k4").collect()
    assert [y["r"] for y in told] == sorted((y["r"] for y in told), reverse=True) and len(told) == 3


def test_two_hundred_columns(spark):
    df = spark.range(60).select(*(((F.col("id") * (k + 3)) % 17 + F.col("id") * k * 1e-3).cast("double").alias(f"c{k}") for k in range(200)))
    assert metrics.correlations(df, df.columns).where("r is not null").count() == 200 * 199 // 2


def test_match_statuses(spark):
    """One segment for each status; an answered match has the ten columns, the others have nulls."""
    seg = spark.createDataFrame([("t", k, km) for k, km in enumerate([1.0, 1.0, 1.0, 1.0, 0.005, None, 1.0, 1.0])], "trip_id string, segment_id int, distance_seg_actual_km double")
    legs = [{"annotation": {"duration": [10.0, 30.0], "distance": [1.0, 1.0], "speed": [10.0, 20.0]}}]
    tries = [
        (1, 1, "NoMatch", None), (2, 1, "Timeout", None), (3, 1, "Ok", float("nan")), (4, 1, "Ok", 900.0), (5, 1, "Ok", 900.0),
        (6, 1, "Ok", 1300.0), (6, 2, "Ok", 1050.0), (6, 3, "Ok", 1000.0), (7, 1, "Ok", 2000.0), (7, 2, "Ok", 1500.0),
    ]
    rt = spark.createDataFrame([("t", s, a, code, m, 60.0, 0.9, legs if code == "Ok" else None) for s, a, code, m in tries], routes.ROUTE)
    direct = spark.createDataFrame([("t", s, 1000.0, 50.0) for s in range(7)], "trip_id string, segment_id int, distance double, duration double")
    speeds = spark.createDataFrame([("t", s, [40.0]) for s in range(8)], "trip_id string, segment_id int, kph array<double>")
    got = {x["segment_id"]: x for x in routes.match_features(seg, rt, direct, speeds).collect()}
    assert {k: (x["match_status"], x["match_attempts"]) for k, x in got.items()} == {
        0: ("NotAttempted", 0), 1: ("NoMatch", 1), 2: ("Error_Timeout", 1), 3: ("Error_MatchDistanceNaN", 1), 4: ("OK_OdoTooSmall", 1), 5: ("OK_NoToleranceCheck", 1), 6: ("OK_InTolerance", 2), 7: ("OK_ToleranceFail", 2),
    }
    late = ("direct_route_distance_m", "route_deviation_pct", "percent_time_over_limit_seg_agg", "avg_speed_limit_kph_seg_agg")
    assert all(got[k][c] is None for k in range(4) for c in late)
    assert tuple(got[6][c] for c in late) == pytest.approx((1000.0, 5.0, 25.0, 63.0))
    assert got[7]["direct_route_distance_m"] is None and got[7]["route_deviation_pct"] is None and got[7]["final_match_radius_m"] == 37.5
    assert len(got[6].asDict()) == 2 + 10
