"""Splits, samples and choice of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.operators import metrics
from voltrail.operators import rows as R
from voltrail.sources.stage import staged

BITS = 52  # of a hash: exact in a double, and in SQL


def drawn(seed: int, *values: Column) -> Column:
    """A number of BITS bits from the seed and the values (null: empty), the same in every run and engine."""
    told = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(v.cast("string"), F.lit("")) for v in values))
    return F.conv(F.substring(F.md5(told), 1, BITS // 4), 16, 10).cast("long")


def hashed(keys: Sequence[str], seed: int) -> Column:
    return drawn(seed, *map(F.col, keys))


def split_rows(df: DataFrame, keys: Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test by a hash of the keys: no shuffle, the same rows in every run."""
    return df.withColumn("is_test", hashed(keys, seed) < F.lit(int(test * (1 << BITS))))


def split_trips(df: DataFrame, test: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds is_test: all of a trip on one side; int(n * test) trips, at least one on each side where there are two.

    The trips of the least hashes are the test ones: their bound is the hash at that place, found by
    histograms of ever finer buckets over the staged hashes, without ranking all trips.
    """
    hashes = staged(df.select(R.TRIP).distinct().select(hashed([R.TRIP], seed).alias("h")))
    n = hashes.count()
    left = 0 if n < 2 else max(1, min(n - 1, int(n * test)))
    if not left:
        return df.withColumn("is_test", F.lit(False))
    low, step = 0, 13
    for shift in range(BITS - step, -1, -step):
        inside = hashes.where(F.col("h").between(low, low + (1 << (shift + step)) - 1))
        for r in inside.groupBy(F.shiftright(F.col("h") - low, shift).alias("p")).count().orderBy("p").collect():  # 8,192 rows at most
            if r["count"] >= left:
                low += r["p"] << shift
                break
            left -= r["count"]
    return df.withColumn("is_test", hashed([R.TRIP], seed) <= low)


def sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows (or all) of the least hashes."""
    return df.orderBy(hashed(keys, seed), *keys).limit(n)


def low_variance(df: DataFrame, columns: Sequence[str], most: float = 1e-3) -> list[str]:
    """Columns whose population variance is at most `most`; all-null ones too."""
    row = df.agg(*(F.var_pop(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is None or row[c] <= most]


def collinear(df: DataFrame, columns: Sequence[str], most: float = 0.9) -> list[str]:
    """Columns to drop until no pair's |r| is above `most`.

    The correlations come from one aggregate; the choice among them is made on the
    small matrix: the first pair by name, of which the one goes that correlates more
    with the rest (of equals the first).
    """
    names = sorted(columns)
    r = {(x["a"], x["b"]): abs(x["r"] or 0.0) for x in metrics.correlations(df, names).collect()} if len(names) > 1 else {}
    size = lambda a, b: r[min(a, b), max(a, b)]
    gone: list[str] = []
    while True:
        left = [c for c in names if c not in gone]
        pair = next(((a, b) for i, a in enumerate(left) for b in left[i + 1 :] if size(a, b) > most), None)
        if pair is None:
            return gone
        mean = {c: sum(size(c, o) for o in left if o != c) / (len(left) - 1) for c in pair}
        gone.append(pair[0] if mean[pair[0]] >= mean[pair[1]] else pair[1])


def model_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with a target and those of the features that exist."""
    if target in features:
        raise ValueError(f"{target} is among the features")
    present = [c for c in features if c in df.columns]
    if not present:
        raise ValueError("none of the features is a column")
    return df.where(F.col(target).isNotNull()).select(*[c for c in (R.TRIP, "segment_id") if c in df.columns], *present, target)
