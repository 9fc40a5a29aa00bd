"""Trips in pieces: the same rows as trip by trip; per-trip fits from Gram matrices: the same predictions as fits of their own."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltrail.operators import clean, features, history, quality, scan, segments, sequences
from voltrail.operators import rows as R

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def trips(spark):
    """Trips of 1 to 300 rows with gaps, stops, nulls, equal times, values that fall or rise, and one null trip."""
    r, out = random.Random(4), []
    for t in [*(f"t{k}" for k in range(7)), None]:
        at, odo, health, stop = 0, 100.0, 95.0, False
        for i in range(r.choice([1, 5, 60, 150, 300])):
            at += r.choice([60, 60, 60, 60, 60, 60, 60, 59, 400, 0, 30])
            stop = r.random() < (0.6 if stop else 0.15)
            odo += 0 if stop else r.choice([0.4, 0.9, -0.2])
            health += r.choice([0, 0, 0, -1, 1])
            speed = [0.0] * 5 if stop else [r.choice([30.0, 55.0, 0.2, 260.0, None]) for _ in range(5)]
            odd = r.random()
            out.append((t, START + dt.timedelta(seconds=at), len(out), None if odd < 0.05 else odo, 130.0 if odd > 0.9 else None if odd > 0.85 else health, 80 - i / 10, None if odd < 0.1 else 40 + i * 1e-3, None if odd > 0.95 else 2 + i * 1e-3, r.choice([20.0, None, 50.0]), None if odd < 0.02 else speed, [100.0 + i, 120.0]))
    kinds = "trip_id string, timestamp timestamp, src_row_id long, current_odo double, battery_health double, current_soc double, latitude double, longitude double, outside_temp double, speed_array array<double>, altitude_array array<double>"
    return spark.createDataFrame(out, kinds).repartition(5).cache()


def labelled(t):
    return segments.label_segments(segments.gap_labels(segments.stop_flags(sequences.gap_flags(t))), 4, 3)


CHAINS = {
    "gap_flags": sequences.gap_flags,
    "falls": lambda t: sequences.falls(t, "current_odo"),
    "rises": lambda t: sequences.rises(t, "battery_health", 0.5),
    "first_violation": lambda t: sequences.first_violation(sequences.falls(t, "current_odo"), "falls"),
    "sequence_report": lambda t: sequences.sequence_report(t, "current_odo", True),
    "repair_sequences": sequences.repair_sequences,
    "steps_scalar": lambda t: sequences.step_violations(t, "current_odo", 0, 0.5),
    "steps_time": lambda t: sequences.step_violations(t, "timestamp", 59, 61, kind="time"),
    "steps_array": lambda t: sequences.step_violations(sequences.gap_flags(t), "speed_array", 0, 10, "neg", "array", True),
    "sample_violations": lambda t: sequences.sample_violations(t, "speed_array", 0, 20),
    "location_steps": lambda t: sequences.location_steps(t, 0.1),
    "context": lambda t: sequences.context(sequences.gap_flags(t), "is_start_after_gap", 3),
    "multi_gaps": lambda t: sequences.multi_gaps(sequences.gap_flags(t), 4),
    "islands": lambda t: sequences.islands(t, F.col("outside_temp") == 20),
    "edges": lambda t: sequences.edges(t, F.col("outside_temp") == 20),
    "zero_trips": lambda t: clean.drop_mostly_zero_trips(t.withColumn("latitude", F.col("latitude") - 40).withColumn("longitude", F.col("longitude") - 2), 0.01),
    "repair_health": lambda t: clean.repair_health(t, (50, 100)),
    "skipped_rows": clean.skipped_rows,
    "out_of_range": lambda t: clean.out_of_range_report(t, "speed_array", (0, 250)),
    "deltas": quality.deltas,
    "half_stops": segments.half_stops,
    "labels": labelled,
    "spans": lambda t: segments.spans(labelled(t), 3),
    "span_rows": lambda t: segments.span_rows(labelled(t), 3),
    "anchored_rows": lambda t: segments.span_rows(labelled(t), 3, anchored=True),
    "rules": lambda t: segments.rule_violations(labelled(t), 4, 3, 5),
    "at_least": lambda t: segments.at_least_segments(labelled(t), 3),
    "features": lambda t: features.segment_table(labelled(t), harsh=0.1),
}


def told(df):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    df = df.drop(scan.PIECE)
    return sorted(repr({c: plain(r[c]) for c in sorted(df.columns)}) for r in df.collect())


@pytest.mark.parametrize("name", CHAINS)
def test_pieces_give_the_same_rows(trips, name):
    pieces = trips.withColumn(scan.PIECE, F.ntile(8).over(Window.partitionBy(R.TRIP).orderBy(R.TIME, R.TIE)))
    want = told(CHAINS[name](trips))
    assert told(CHAINS[name](pieces)) == want and want


@pytest.mark.parametrize("name", ["labels", "features", "deltas"])
def test_long_trips_are_spread(trips, name, monkeypatch):
    """Some trips are long and some are not; carries may be joined by a shuffle; one trip lies in several partitions."""
    monkeypatch.setattr(scan, "BROADCAST_CARRIES", 0)
    seen = []
    cut = scan.pieces
    monkeypatch.setattr(scan, "pieces", lambda *a: seen.append(cut(*a)) or seen[-1])
    assert told(scan.spread(trips, CHAINS[name], most_rows=100)) == told(CHAINS[name](trips))
    longest = seen[0].groupBy(R.TRIP).agg(F.countDistinct(scan.PIECE).alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows")).first()
    assert longest["n"] >= 2 and longest["rows"] > 100
    monkeypatch.setattr(scan, "pieces", None)
    assert told(scan.spread(trips, CHAINS[name])) == told(CHAINS[name](trips))


@pytest.fixture(scope="module")
def table(spark):
    """Segments with nulls, a constant column, a repeated column, and a row far away from all others."""
    r = np.random.default_rng(2)
    rows = []
    for t, n in (("a", 90), ("b", 6), ("c", 3), ("d", 1), ("far", 12), (None, 8)):
        for k in range(n):
            a, b = r.normal(50, 9), r.normal(0, 0.2)
            y = 0.3 * a - 2 * b + r.normal(0, 0.5)
            if t == "far" and k == 4:
                a, y = 1e7, 3.0
            rows.append((t, k * 3, None if k % 17 == 5 else float(a), float(b), 2 * float(b) + 1, 7.0, None if k % 13 == 7 else float(y)))
    return spark.createDataFrame(rows, "trip_id string, segment_id int, a double, b double, c double, k double, y double").repartition(4)


def fitted(table, forward, least=3, least_variance=1e-3):
    out, columns = {}, ["a", "b", "c", "k"]
    trips: dict = {}
    for x in table.orderBy("segment_id").collect():
        trips.setdefault(x["trip_id"], []).append(x)
    for t, rows in trips.items():
        x = np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows], float)
        y = np.array([np.nan if r["y"] is None else r["y"] for r in rows], float)
        for k, r in enumerate(rows):
            train = ~np.isnan(x).any(1) & ~np.isnan(y) & (np.arange(len(rows)) < k if forward else np.arange(len(rows)) != k)
            if np.isnan(x[k]).any() or train.sum() < least or not (keep := x[train].var(0) > least_variance).any():
                continue
            for model, alpha in history.MODELS.items():
                out[t, r["segment_id"], model] = history.least_squares(x[train][:, keep], y[train], x[k, keep], alpha)
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("most", [10, 50_000])
def test_predictions_are_those_of_fits_of_their_own(table, forward, most):
    f = history.walk_forward if forward else history.leave_one_out
    got = {(x["trip_id"], x["segment_id"], x["model"]): x["predicted"] for x in f(table, ["a", "b", "c", "k"], "y", most_segments=most).collect()}
    want = fitted(table, forward)
    assert got.keys() == want.keys() and len(want) > 100
    for key, v in want.items():
        assert got[key] == pytest.approx(v, rel=1e-6, abs=1e-6), key


def test_gram_matrices_merge():
    r = np.random.default_rng(0)
    rows = r.normal(1e6, 1, (50, 4))
    a, whole = history.Gram.of(rows[:20]) + history.Gram.of(rows[20:]), history.Gram.of(rows)
    assert a.n == 50 and np.allclose(a.mean, whole.mean, rtol=1e-14) and np.allclose(a.products, whole.products, rtol=1e-8)
    none = history.Gram.of(rows[:0])
    assert (none + whole).n == (whole + none).n == 50 and np.allclose((whole + none).products, whole.products)


def test_no_group_is_held(table):
    plan = history.leave_one_out(table, ["a", "b"], "y")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan


def test_short_pieces_share_ranges(spark, monkeypatch):
    """Pieces of three rows are as many as rows need, but ranges, and so tasks, no more than cores; the trips that are long come by a join, too."""
    df = spark.range(3_000).selectExpr("id div 10 as trip_id", "cast(id % 10 as int) as segment_id", "cast(id * 37 % 101 as double) as x", "cast(id * 53 % 89 as double) as y")
    asked, cut = [], scan.pieces
    monkeypatch.setattr(scan, "BROADCAST_CARRIES", 0)
    monkeypatch.setattr(scan, "pieces", lambda df, n, *a: asked.append((n, cut(df, n, *a))) or asked[-1][1])
    f = lambda most: {(r["trip_id"], r["segment_id"], r["model"]): r["predicted"] for r in history.walk_forward(df, ["x"], "y", most_segments=most).collect()}
    short, whole = f(3), f(50_000)
    (n, rows) = asked[0]
    assert n == spark.sparkContext.defaultParallelism and len(asked) == 1
    sizes = rows.groupBy(scan.PIECE).agg(F.count("*").alias("n"), F.min(F.struct("trip_id", "segment_id")).alias("a"), F.max(F.struct("trip_id", "segment_id")).alias("b")).orderBy(scan.PIECE).collect()
    assert max(r["n"] for r in sizes) <= 3 and len(sizes) >= 1_000 and all(tuple(p["b"]) < tuple(q["a"]) for p, q in zip(sizes, sizes[1:]))
    assert short.keys() == whole.keys() and len(whole) == 300 * 7 * 2
    assert all(short[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in whole.items())


@pytest.mark.parametrize("forward", [False, True])
def test_short_trips_are_fitted_together(forward):
    """A thousand trips of five segments are a few groups, not a thousand frames of each model; trips that are cut by a batch stay whole."""
    k = np.arange(5_000)
    z = [np.array([a * 37 % 101, a * 53 % 89], float) for a in k.tolist()]
    rows = pd.DataFrame({R.TRIP: k // 5, "segment_id": k % 5, "z": z, scan.PIECE: 0, "n": None, "mean": None, "products": None})
    frames = [rows.iloc[a : a + 777] for a in range(0, len(rows), 777)]
    out = list(history._predicting(forward, history.MODELS, 3, 1e-3)(iter(frames)))
    assert len(out) <= 40 and sum(map(len, out)) == 1_000 * (2 if forward else 5) * 2
    got = pd.concat(out).set_index([R.TRIP, "segment_id", "model"])["predicted"]
    for trip in (0, 155, 999):
        x = np.array(z[trip * 5 : trip * 5 + 4])
        assert got[trip, 4, "linear"] == pytest.approx(history.least_squares(x[:, :1], x[:, 1], z[trip * 5 + 4][:1], 0.0))
