"""Error metrics, comparisons of two models, correlations, distributions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.operators import rows as R
from voltrail.sources.stage import staged


def _errors(e: Column) -> dict[str, Column]:
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mbe": F.avg(e), "std_dev": F.stddev_samp(e), "n": F.count(e)}


def error_metrics(df: DataFrame, error: str, by: Sequence[str] = ()) -> DataFrame:
    """Of an error column (actual less predicted): mean absolute, root mean square, mean, deviation, count."""
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in _errors(F.col(error)).items()))


def residual_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """The same with the bias as predicted less actual."""
    e = F.when(F.col(actual).isNotNull() & F.col(predicted).isNotNull(), F.col(predicted) - F.col(actual))
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in _errors(e).items()))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse, r2 over rows that have both values."""
    whole = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(actual) - F.col(predicted)
    unexplained = F.try_divide(F.avg(e * e), F.var_pop(actual))
    return whole.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - unexplained).alias("r2"), F.count("*").alias("n"))


def both_errors(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.dropna(subset=[first, second])


def compared(df: DataFrame, base: str, other: str) -> DataFrame:
    """metric, base, other, diff, pct, verdict for two error columns; the bias is judged by its size."""
    kinds = ("mae", "rmse", "mbe", "std_dev")
    row = df.agg(*(c.alias(f"{p}_{k}") for p, e in (("b", base), ("o", other)) for k, c in _errors(F.col(e)).items() if k in kinds))
    parts = []
    for k in kinds:
        b, o = F.col(f"b_{k}"), F.col(f"o_{k}")
        size = (F.abs(o) - F.abs(b)) if k == "mbe" else o - b
        verdict = F.when(size < -1e-9, "Better").when(size > 1e-9, "Worse").otherwise("Same")
        pct = F.when(F.abs(b) < 1e-9, F.lit(float("inf"))).otherwise(F.try_divide(100 * (o - b), F.abs(b)))
        parts.append(F.struct(F.lit(k).alias("metric"), b.alias("base"), o.alias("other"), (o - b).alias("diff"), pct.alias("pct"), verdict.alias("verdict")))
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def per_trip(df: DataFrame, base: str, other: str, outcome: str) -> DataFrame:
    both = [(p, e) for p, e in (("base", base), ("other", other))]
    return df.groupBy(R.TRIP).agg(*(c.alias(f"{p}_{k}") for p, e in both for k, c in _errors(F.col(e)).items() if k != "n"), F.count("*").alias("segments"), F.avg(outcome).alias("avg_outcome"))


def improvement(per: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """How many trips got better, worse or stayed, and the mean and median gain."""
    gain = F.col("base_mae") - F.col("other_mae")
    gains = staged(per.select(gain.alias("gain")))
    median = quantiles(gains, ["gain"], [0.5])["gain"][0.5]
    g = F.col("gain")
    return gains.agg(
        F.count_if(g > tolerance).alias("improved"), F.count_if(g < -tolerance).alias("worsened"), F.count_if(F.abs(g) <= tolerance).alias("same"),
        F.avg(g).alias("mean_gain"), F.lit(median).cast("double").alias("median_gain"),
    )


def best_model(metrics: DataFrame, model: str = "model", by: str = "mae", largest: bool = False) -> DataFrame:
    """The row of the best model; of equals the first by name."""
    return metrics.where(F.col(by).isNotNull()).orderBy(F.desc(by) if largest else F.asc(by), model).limit(1)


#: Values of an interval that are fetched instead of counted again, and buckets of an interval.
FEW, BUCKETS = 2_048, 1_024


def quantiles(values: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of columns, between neighbours by a straight line; nulls and NaN are left out.

    The place of each quantile lies in an interval of values, at first the whole range. Each pass counts all
    intervals' values in equal buckets; the bucket that holds the place is the next interval, from its least
    to its greatest value, until it holds one value or few, which are fetched. So memory doesn't grow with the
    table or its different values, and a pass takes all columns. `values` is read some times.
    """
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    row = values.agg(*(f(v).alias(f"{k}{i}") for i, v in enumerate(x.values()) for k, f in (("n", F.count), ("a", F.min), ("z", F.max)))).first()
    known: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int, int]] = {}  # of a rank: the interval, how many values lie below and in it
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        for p in shares if n else ():
            for rank in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                open_[c, rank] = row[f"a{i}"], row[f"z{i}"], 0, n
    while open_:
        for key, (a, z, _, _) in list(open_.items()):
            if a == z:
                known[key] = a
                del open_[key]
        spans = sorted({(c, a, z, below, n) for (c, _), (a, z, below, n) in open_.items()}, key=repr)
        inside = [F.when(x[c].between(a, z), F.struct(F.lit(k).alias("k"), (F.lit(0) if n <= FEW else _bucket(x[c], a, z)).alias("b"), x[c].alias("x"))) for k, (c, a, z, _, n) in enumerate(spans)]
        if not spans:
            break
        held = values.select(F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s")).select("s.*")
        few = [k for k, s in enumerate(spans) if s[4] <= FEW]
        found: dict[int, list[float]] = {}
        for r in held.where(F.col("k").isin(few)).collect() if few else ():  # FEW rows a span at most
            found.setdefault(r["k"], []).append(r["x"])
        counted: dict[int, list] = {}
        for r in held.where(~F.col("k").isin(few)).groupBy("k", "b").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).collect() if len(few) < len(spans) else ():
            counted.setdefault(r["k"], []).append(r)
        of = {s[:3]: k for k, s in enumerate(spans)}
        for key, (a, z, below, n) in list(open_.items()):
            k = of[key[0], a, z]
            if n <= FEW:
                known[key] = sorted(found[k])[key[1] - below]
                del open_[key]
                continue
            for r in sorted(counted[k], key=lambda r: r["b"]):
                if key[1] < below + r["n"]:
                    open_[key] = r["a"], r["z"], below, r["n"]
                    break
                below += r["n"]

    def at(c: str, n: int, p: float) -> float | None:
        if not n:
            return None
        place = (n - 1) * p
        a, z = known[c, math.floor(place)], known[c, math.ceil(place)]
        return a + (z - a) * (place - math.floor(place)) if z > a else a

    return {c: {p: at(c, row[f"n{i}"], p) for p in shares} for i, c in enumerate(columns)}


def _bucket(x: Column, a: float, z: float) -> Column:
    """A value's bucket in [a, z], never smaller for a larger value; halves keep the width finite."""
    width = z / 2 - a / 2
    if not width:
        return (x > a).cast("int")
    return F.least(F.lit(BUCKETS - 1), F.floor((x / 2 - a / 2) / width * BUCKETS)).cast("int")


def describe_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, mean, std, min, p25, p50, p75, max for each of the columns."""
    shares = (0.25, 0.5, 0.75)
    values = staged(df.select(*(F.col(c).cast("double").alias(c) for c in columns)))
    q = quantiles(values, columns, shares)
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *(F.lit(q[c][p]).cast("double").alias(f"p{100 * p:.0f}") for p in shares), F.max(c).alias("max"))
    return values.agg(F.array(*(one(c) for c in columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def describe(df: DataFrame, column: str) -> DataFrame:
    return describe_all(df, [column]).drop("column")


def _gram(columns: Sequence[str], centre: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums: of each column how many values and their sum, or, with a centre, of each pair over the rows that have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(columns)
        n, s, q, p = (np.zeros((c, c)) for _ in range(4))
        one = np.zeros((2, c))
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(c)])
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            if centre is None:
                one += there.sum(0), x.sum(0)
                continue
            x, m = np.where(there, x - centre, 0.0), there.astype(float)
            n, s, q, p = n + m.T @ m, s + x.T @ m, q + (x * x).T @ m, p + x.T @ x
        i, j = (np.arange(c), np.arange(c)) if centre is None else np.triu_indices(c)
        sums = [*one] if centre is None else [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), *sums)], names=["i", "j", *_SUMS[: len(sums)]])

    return run


_SUMS = ("n", "s", "t", "q", "u", "p")


def _summed(values: DataFrame, columns: Sequence[str], centre: np.ndarray | None) -> DataFrame:
    names = _SUMS[: 2 if centre is None else 6]
    parts = values.mapInArrow(_gram(columns, centre), "i int, j int, " + ", ".join(f"{k} double" for k in names))
    return parts.groupBy("i", "j").agg(*(F.sum(k).alias(k) for k in names))


#: Columns up to which an aggregate has an expression for each pair; more are multiplied as matrices.
FEW_COLUMNS = 8


def _corr(a: str, b: str) -> Column:
    whole = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(whole, F.col(c)) for c in (a, b))
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # rounding leaves a constant's deviation above 0
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i, j (places in `columns`, i < j), r: Pearson over the rows that have both; null where one is constant there; NaN is null.

    Of few columns one aggregate. Else two passes for any number of columns: the means, then products of centred
    values as matrices, a task at a time, summed over the tasks.
    """
    df = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)))
    if len(columns) <= FEW_COLUMNS:
        pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
        row = df.agg(*(_corr(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs))
        return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs))).alias("x")).select("x.*")
    return _gram_correlations(df, columns)


def _gram_correlations(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    told = {r["i"]: r for r in _summed(values, columns, None).collect()}
    centre = np.array([told[k]["s"] / told[k]["n"] if k in told and told[k]["n"] else 0.0 for k in range(len(columns))])
    sums = staged(_summed(values, columns, centre))
    own = sums.where("i = j").select(F.col("i").alias("k"), F.try_divide("q", "n").alias("v"))
    scale = F.get(F.array(*(F.lit(float(x)) for x in np.abs(centre))), F.col("k"))
    # what rounding leaves of a constant column's squares
    least = own.select("k", (F.col("v") * 1e-14 + scale * scale * 1e-26).alias("least"))
    n, s, t = F.col("n"), F.col("s"), F.col("t")
    var = lambda q, x: F.try_divide(F.col(q), n) - F.try_divide(x, n) * F.try_divide(x, n)
    pairs = sums.where("i < j").withColumns({"a": var("q", s), "b": var("u", t), "c": F.try_divide("p", n) - F.try_divide(s, n) * F.try_divide(t, n)})
    for side, v in (("i", "a"), ("j", "b")):
        pairs = pairs.join(F.broadcast(least.withColumnRenamed("k", side).withColumnRenamed("least", f"least_{v}")), side)
    sound = (F.col("a") > F.col("least_a")) & (F.col("b") > F.col("least_b"))
    return pairs.select("i", "j", F.when(sound, F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("r"))


def _named(columns: Sequence[str], i: str) -> Column:
    return F.get(F.array(*map(F.lit, columns)), F.col(i))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r for each pair of columns."""
    return pair_correlations(df, columns).select(_named(columns, "i").alias("a"), _named(columns, "j").alias("b"), "r")


def target_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """feature, r with the target, largest first."""
    pairs = pair_correlations(df, [*columns, target]).where(F.col("j") == len(columns))
    return pairs.select(_named(columns, "i").alias("feature"), "r").orderBy(F.desc_nulls_last("r"), "feature")


def predictions_possible(segments: DataFrame, least: int = 3) -> DataFrame:
    """Segments, and those whose trip has at least `least` others."""
    per = segments.groupBy(R.TRIP).count()
    return per.agg(F.sum("count").alias("segments"), F.coalesce(F.sum(F.when(F.col("count") - 1 >= least, F.col("count"))), F.lit(0)).alias("possible"))


def validated(df: DataFrame, required: Sequence[str], errors: Sequence[str], outcome: str | None = None, optional: Sequence[str] = ()) -> DataFrame:
    """`df` with its error columns (and the outcome) as numbers, null where they are none.

    KeyError if a required or an error column is missing; a missing optional one doesn't matter.
    """
    missing = [c for c in [*required, *errors] if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    numbers = [*errors, *([outcome] if outcome in df.columns else []), *(c for c in optional if c in errors)]
    return df.withColumns({c: F.col(c).try_cast("double") for c in dict.fromkeys(numbers)})
