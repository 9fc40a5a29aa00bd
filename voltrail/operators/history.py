"""What a segment can know of its trip's other segments: all others, or those before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions import scalars
from voltrail.operators import rows as R
from voltrail.operators import scan
from voltrail.sources.stage import staged

KEYS = [R.TRIP, "segment_id"]
TOTALS = {"distance_seg_actual_km": "distance", "duration_seg_actual_s": "duration", "stops_seg_count": "stops", "stop_duration_seg_agg_s": "stop_duration"}
COUNTERS = ("accel_high_event_count", "decel_high_event_count", "stops_seg_count")


def enough_segments(segments: DataFrame, least: int = 3) -> DataFrame:
    """Segments of trips with more than `least`."""
    return segments.withColumn("_n", F.count("*").over(Window.partitionBy(R.TRIP))).where(F.col("_n") > least).drop("_n")


def own_columns(segments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """k_ copies of what is known of the segment itself."""
    return segments.select(*KEYS, *(F.col(c).alias(f"k_{c}") for c in columns))


def others(segments: DataFrame, averages: Sequence[str], totals: Sequence[str] = (), residual: str | None = None) -> DataFrame:
    """Means and deviations of columns over the trip's other segments, totals, and how many there are.

    Two running windows, the segments before and those after, are merged for each segment: linear in
    a trip's length, and nothing is subtracted, so nothing cancels. Trips of one segment have no others.
    """
    trip = Window.partitionBy(R.TRIP)
    sides = [trip.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("segment_id").asc(), F.col("segment_id").desc())]
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def merged(c: Column) -> tuple[Column, Column]:
        (n, m, v), (k, o, u) = ((F.count(c).over(w), F.avg(c).over(w), F.var_pop(c).over(w)) for w in sides)
        mean = F.when(n + k > 0, (zero(m) * n + zero(o) * k) / (n + k))
        squares = zero(v) * n + zero(u) * k + F.when((n > 0) & (k > 0), (m - o) * (m - o) * n * k / (n + k)).otherwise(0.0)
        return mean, F.when(n + k > 1, F.sqrt(squares / (n + k - 1)))

    both = {c: merged(F.col(c).cast("double")) for c in averages}
    total = lambda c: sum((F.coalesce(F.sum(c).over(w), F.lit(0)) for w in sides), F.lit(0))
    out = segments.select(
        *KEYS, *(both[c][0].alias(f"others_avg_{c}") for c in averages), *(both[c][1].alias(f"others_std_{c}") for c in averages), *(total(c).alias(f"others_total_{c}") for c in totals),
        *([merged(F.abs(F.col(residual)))[0].alias(f"others_abs_avg_{residual}")] if residual else []), (F.count("*").over(trip) - 1).alias("others_segment_count"),
    )
    return out.where("others_segment_count > 0")


def rates(totals: DataFrame, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Counters per km and per minute, and the share of time standing; 0 where there is no distance or time."""
    km, s = F.col("others_total_distance_seg_actual_km"), F.col("others_total_duration_seg_actual_s")
    out = totals
    for c in counters:
        n = F.col(f"others_total_{c}")
        out = out.withColumns({f"others_{c}_per_km": scalars.div_or_zero(n, km), f"others_{c}_per_minute": scalars.div_or_zero(n * 60, s)})
    return out.withColumn("others_stop_share", scalars.div_or_zero(F.col("others_total_stop_duration_seg_agg_s"), s))


def lagged(segments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """k-1_ columns: the values of the segment before."""
    w = Window.partitionBy(R.TRIP).orderBy("segment_id")
    return segments.select(*KEYS, *(F.lag(c).over(w).alias(f"k-1_{c}") for c in columns))


def so_far(segments: DataFrame, averages: Sequence[str] = (), residual: str | None = None) -> DataFrame:
    """Running history before each segment: counts, distance, duration, consumption, means, rates."""
    w = Window.partitionBy(R.TRIP).orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    out = segments.select(
        *KEYS, F.count("*").over(w).alias("hist_segments"), total("distance_seg_actual_km").alias("hist_distance_km"), total("duration_seg_actual_s").alias("hist_duration_s"),
        total("gt_soc_seg_delta").alias("hist_soc"), total("stops_seg_count").alias("hist_stops"), total("stop_duration_seg_agg_s").alias("hist_stop_s"),
        *(f(c).over(w).alias(f"hist_{n}_{c}") for c in averages for n, f in (("avg", F.avg), ("std", F.stddev_samp))),
        *([F.avg(residual).over(w).alias("hist_avg_residual"), F.stddev_samp(residual).over(w).alias("hist_std_residual"), F.avg(F.abs(F.col(residual))).over(w).alias("hist_abs_avg_residual")] if residual else []),
    )
    return out.withColumns(
        {
            "hist_soc_per_km": scalars.div_or_zero(F.col("hist_soc"), F.col("hist_distance_km")),
            "hist_stops_per_km": scalars.div_or_zero(F.col("hist_stops"), F.col("hist_distance_km")),
            "hist_stop_s_per_stop": scalars.div_or_zero(F.col("hist_stop_s"), F.col("hist_stops")),
        }
    )


#: Directions of the standardised inputs below this share of the largest one's variance are left out of a fit.
LEAST_DIRECTION = 1e-11
#: Segments of a trip above which it is evaluated in pieces.
MOST_SEGMENTS = 50_000
#: A row that holds all but this share of a column's squares is not subtracted; the others are summed again.
OWN_SHARE = 1e-7
STRIP = 1_024


def least_squares(x: np.ndarray, y: np.ndarray, at: np.ndarray, alpha: float) -> float:
    """The prediction at one point of a linear fit with a free intercept; alpha: ridge penalty on standardised columns."""
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z, q = (x - mean) / std, (at - mean) / std
    if alpha:
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    else:
        w = np.linalg.lstsq(z, y - y.mean(), rcond=LEAST_DIRECTION**0.5)[0]
    return float(q @ w + y.mean())


@dataclass
class Gram:
    """How many rows, their mean, and the products of their differences from it; of one run, or of many, one beside the other."""

    n: int | np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Gram:
        mean = rows.mean(0) if len(rows) else np.zeros(rows.shape[1])
        return cls(len(rows), mean, (rows - mean).T @ (rows - mean))

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        if not self.n or not n:
            return other
        d = other.mean - self.mean
        return Gram(n, self.mean + d * (other.n / n), self.products + other.products + np.outer(d, d) * (self.n * other.n / n))


def predicted(n: np.ndarray, mean: np.ndarray, products: np.ndarray, at: np.ndarray, alpha: float, least_variance: float) -> np.ndarray:
    """Predictions at many points, each of a fit of its own from a Gram matrix whose last column is the target; nan where no column varies."""
    c = at.shape[1]
    var = np.diagonal(products, axis1=1, axis2=2)[:, :c] / n[:, None]
    keep = var > least_variance
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, var, 1)), 0)
    z = products[:, :c, :c] * scale[:, :, None] * scale[:, None, :]
    goal = products[:, :c, c] * scale
    if alpha:
        w = np.linalg.solve(z + np.eye(c) * alpha, goal[:, :, None])[:, :, 0]
    else:
        size, axes = np.linalg.eigh(z)
        known = size > LEAST_DIRECTION * size[:, -1:]
        w = ((axes * np.where(known, 1 / np.where(known, size, 1), 0)[:, None, :]) @ (axes.transpose(0, 2, 1) @ goal[:, :, None]))[:, :, 0]
    out = ((at - mean[:, :c]) * scale * w).sum(1) + mean[:, c]
    return np.where(keep.any(1), out, np.nan)


def _merged(a: Gram, b: Gram) -> Gram:
    """Grams of many runs, one beside the other, merged pair by pair; those of no rows are zeros."""
    n = a.n + b.n
    d = b.mean - a.mean
    share = np.divide(b.n, n, out=np.zeros(n.shape), where=n > 0)
    return Gram(n, a.mean + d * share[:, None], a.products + b.products + d[:, :, None] * d[:, None, :] * (a.n * share)[:, None, None])


def _none(runs: int, d: int) -> Gram:
    return Gram(np.zeros(runs, np.int64), np.zeros((runs, d)), np.zeros((runs, d, d)))


def _sums(values: np.ndarray, train: np.ndarray, at: np.ndarray) -> Gram:
    """The Gram of the training rows of each run; `at`: where the runs begin."""
    which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(values))))
    n = np.add.reduceat(train.astype(np.int64), at)
    mean = np.add.reduceat(np.where(train[:, None], values, 0), at) / np.maximum(n, 1)[:, None]
    d = np.where(train[:, None], values - mean[which], 0)
    return Gram(n, mean, np.add.reduceat(d[:, :, None] * d[:, None, :], at))


def _before(own: Gram, at: np.ndarray, start: Gram) -> Gram:
    """For each of the Grams `own`, the merged ones before it in its run, from the run's `start` on: all runs go forward together."""
    size = np.diff(np.append(at, len(own.n)))
    out = _none(*own.mean.shape)
    live, now = np.arange(len(at)), start
    for k in range(int(size.max(initial=0))):
        stays = size[live] > k
        live, now = live[stays], Gram(now.n[stays], now.mean[stays], now.products[stays])
        i = at[live] + k
        out.n[i], out.mean[i], out.products[i] = now.n, now.mean, now.products
        now = _merged(now, Gram(own.n[i], own.mean[i], own.products[i]))
    return out


def _without_each(rows: np.ndarray, total: Gram, rest_of: Callable[[int], Gram], least: int) -> Gram:
    """For each of `rows` its `total` without it; where its own part is nearly all, of at least `least` rows, the others' are summed again."""
    n = np.broadcast_to(total.n - 1, len(rows))
    d = rows - total.mean
    share = np.divide(1.0, n, out=np.zeros(len(rows)), where=n > 0)
    mean = total.mean - d * share[:, None]
    products = total.products - d[:, :, None] * d[:, None, :] * (total.n * share)[:, None, None]
    own = np.diagonal(products, axis1=1, axis2=2) < OWN_SHARE * np.diagonal(total.products, axis1=-2, axis2=-1)
    for k in np.flatnonzero(own.any(1) & (n >= least)).tolist():
        rest = rest_of(k)
        mean[k], products[k] = rest.mean, rest.products
    return Gram(n, mean, products)


MODELS = {"linear": 0.0, "ridge": 1.0}
_HEAD = "n long, mean array<double>, products array<double>"


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole runs of (trip, piece), from frames that come sorted by them."""
    held: pd.DataFrame | None = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        cut = int((_run_numbers(f) != _run_numbers(f)[-1]).sum())
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        held = f.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _run_numbers(f: pd.DataFrame) -> np.ndarray:
    change = (f[R.TRIP] != f[R.TRIP].shift()) & ~(f[R.TRIP].isna() & f[R.TRIP].shift().isna()) | (f[scan.PIECE] != f[scan.PIECE].shift())
    return change.cumsum().to_numpy()


def _short_runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole runs and the runs' beginnings: many short runs together, up to about STRIP rows, a longer one alone."""
    for f in _runs(frames):
        at = np.flatnonzero(np.diff(_run_numbers(f), prepend=-1))
        ends, lo = np.append(at[1:], len(f)), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + STRIP, side="right")))
            yield f.iloc[at[lo] : ends[hi - 1]].reset_index(drop=True), at[lo:hi] - at[lo]
            lo = hi


def _told(f: pd.DataFrame) -> Gram:
    d = len(f["mean"].iloc[0])
    return Gram(f["n"].to_numpy().astype(np.int64), np.array(f["mean"].tolist(), float).reshape(-1, d), np.array(f["products"].tolist(), float).reshape(-1, d, d))


def _each_group(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, Gram, np.ndarray, np.ndarray]]:
    """Of each group of runs its rows, where the runs begin in them, what the runs' headers tell of other pieces, the rows' values, and which of them train."""
    for f, at in _short_runs(frames):
        head = f["n"].notna().to_numpy()
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(f))))
        rows = f[~head].reset_index(drop=True)
        if not len(rows):
            continue
        values = np.array(rows["z"].tolist(), float).reshape(len(rows), -1)
        told = _none(len(at), values.shape[1])
        if head.any():
            h, i = _told(f[head]), run[head]
            told.n[i], told.mean[i], told.products[i] = h.n, h.mean, h.products
        at = np.flatnonzero(np.diff(run[~head], prepend=-1))
        here = run[~head][at]
        yield rows, at, Gram(told.n[here], told.mean[here], told.products[here]), values, ~np.isnan(values).any(1)


def _predicting(forward: bool, models: dict[str, float], least: int, least_variance: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def made(rows: pd.DataFrame, values: np.ndarray, g: Gram) -> Iterator[pd.DataFrame]:
        ok = ~np.isnan(values[:, :-1]).any(1) & (g.n >= least)
        if ok.any():
            for name, alpha in models.items():
                out = rows.loc[ok, [R.TRIP, "segment_id"]].assign(model=name, actual=values[ok, -1], predicted=predicted(g.n[ok], g.mean[ok], g.products[ok], values[ok, :-1], alpha, least_variance))
                yield out[out["predicted"].notna()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, at, told, values, train in _each_group(frames):
            which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(rows))))
            total = None if forward else _merged(told, _sums(values, train, at))
            for lo in range(0, len(rows), STRIP):  # a group of more than STRIP rows is one run
                part, own, of = values[lo : lo + STRIP], train[lo : lo + STRIP], which[lo : lo + STRIP]
                if forward:
                    one = Gram(own.astype(np.int64), np.where(own[:, None], part, 0), np.zeros((*part.shape, part.shape[1])))
                    states = _before(one, at, told)
                    if len(at) == 1:
                        last = Gram(states.n[-1:], states.mean[-1:], states.products[-1:])
                        told = _merged(last, Gram(one.n[-1:], one.mean[-1:], one.products[-1:]))
                else:
                    states = Gram(total.n[of], total.mean[of], total.products[of])
                    k = np.flatnonzero(own)

                    def rest_of(i: int, k: np.ndarray = k, lo: int = lo) -> Gram:
                        others = train & (which == which[lo + k[i]])
                        others[lo + k[i]] = False
                        r = which[lo + k[i]]
                        return Gram(int(told.n[r]), told.mean[r], told.products[r]) + Gram.of(values[others])  # noqa: B023

                    without = _without_each(part[k], Gram(states.n[k], states.mean[k], states.products[k]), rest_of, least)
                    states.n[k], states.mean[k], states.products[k] = without.n, without.mean, without.products
                yield from made(rows.iloc[lo : lo + STRIP], part, states)

    return run


def _gram_rows(keys: pd.DataFrame, piece: pd.Series, g: Gram) -> pd.DataFrame:
    return pd.DataFrame({R.TRIP: keys[R.TRIP].to_numpy(), scan.PIECE: piece.to_numpy(), "n": g.n, "mean": list(g.mean), "products": list(g.products.reshape(len(g.n), -1))})


def _summing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, at, _, values, train in _each_group(frames):
        yield _gram_rows(rows.iloc[at], rows[scan.PIECE].iloc[at], _sums(values, train, at))


def _carrying(forward: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each piece of a trip, what the pieces before it (forward) or all others hold: two scans, so nothing is subtracted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, at in _short_runs(g.assign(**{"_piece": g[scan.PIECE], scan.PIECE: 0}) for g in frames):
            own = _told(f)
            none = _none(len(at), own.mean.shape[1])
            both = _before(own, at, none)
            if not forward:
                back = Gram(own.n[::-1], own.mean[::-1], own.products[::-1])
                after = _before(back, len(f) - np.append(at[1:], len(f))[::-1], none)
                both = _merged(both, Gram(after.n[::-1], after.mean[::-1], after.products[::-1]))
            yield _gram_rows(f, f["_piece"], both)

    return run


def _evaluated(segments: DataFrame, columns: Sequence[str], target: str, forward: bool, models: dict[str, float], least: int, least_variance: float, most_segments: int) -> DataFrame:
    trip, segment = dict(segments.dtypes)[R.TRIP], dict(segments.dtypes)["segment_id"]
    z = F.array(*(F.col(c).cast("double") for c in [*columns, target]))
    out = f"{R.TRIP} {trip}, segment_id {segment}, model string, actual double, predicted double"
    keys = [R.TRIP, scan.PIECE]

    def chain(rows: DataFrame) -> DataFrame:
        head = [F.lit(None).cast(kind).alias(c) for c, kind in (("n", "long"), ("mean", "array<double>"), ("products", "array<double>"))]
        if scan.PIECE not in rows.columns:
            dealt = rows.withColumn(scan.PIECE, F.lit(0)).select("*", *head).repartition(R.TRIP).sortWithinPartitions(R.TRIP, "segment_id")
            return dealt.mapInPandas(_predicting(forward, models, least, least_variance), out)
        rows = rows.select("*", *head)
        told = rows.repartition(*keys).sortWithinPartitions(*keys, "segment_id").mapInPandas(_summing, f"{R.TRIP} {trip}, {scan.PIECE} long, {_HEAD}")
        told = told.repartition(R.TRIP).sortWithinPartitions(*keys).mapInPandas(_carrying(forward), f"{R.TRIP} {trip}, {scan.PIECE} long, {_HEAD}")
        # a piece's carry is a row before its own ones
        both = rows.unionByName(told, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, F.col("n").isNull(), "segment_id")
        return both.mapInPandas(_predicting(forward, models, least, least_variance), out)

    return scan.spread(staged(segments.select(*KEYS, z.alias("z"))), chain, most_segments, ["segment_id"])


def leave_one_out(segments: DataFrame, columns: Sequence[str], target: str, models: dict[str, float] = MODELS, least: int = 3, least_variance: float = 1e-3, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """Each segment predicted by models of the trip's other ones.

    A trip's rows give one Gram matrix; each row's own part is taken out of it, and all fits are solved in
    batches: linear in a trip's length. Trips of more than `most_segments` segments are summed in pieces.
    """
    return _evaluated(segments, columns, target, False, models, least, least_variance, most_segments)


def walk_forward(segments: DataFrame, columns: Sequence[str], target: str, models: dict[str, float] = MODELS, least: int = 3, least_variance: float = 1e-3, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """Each segment predicted by models of the trip's earlier ones: a running Gram matrix, carried from piece to piece of a long trip."""
    return _evaluated(segments, columns, target, True, models, least, least_variance, most_segments)
