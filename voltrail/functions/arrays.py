"""Functions on array<double> columns. NaN elements count as missing, and so does a null array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    v = present(a)
    return F.when(F.size(v) > 0, _sum(v) / F.size(v))


def total_km(kph_each_second: Column) -> Column:
    """Distance of a speed array sampled once a second."""
    return F.when(kph_each_second.isNotNull(), _sum(present(kph_each_second)) / 3600)


def max_or_inf(a: Column) -> Column:
    """The maximum; infinite for a null, empty or all-missing array, so that it never passes as slow."""
    return F.coalesce(F.array_max(present(a)), F.lit(INF))


def share_below(a: Column, limit: float) -> Column:
    """Share of elements below a limit; missing ones count in the denominator, an empty array gives 0."""
    below = F.size(F.filter(a, lambda x: F.coalesce(~F.isnan(x) & (x < limit), F.lit(False))))
    return F.when(F.size(a) > 0, below / F.size(a)).otherwise(F.lit(0.0))


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def steps(a: Column) -> Column:
    """Differences of neighbours."""
    n = F.size(a)
    return F.when(n > 1, F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1), lambda b, c: b - c)).otherwise(F.array().cast("array<double>"))


def max_step(a: Column) -> Column:
    return F.array_max(F.transform(steps(present(a)), F.abs))


def any_outside(a: Column, low: float, high: float) -> Column:
    """Whether an element is out of range; NaN is, null is not."""
    return F.coalesce(F.exists(a, lambda x: F.isnan(x) | (x < low) | (x > high)), F.lit(False))


def count_outside(a: Column, low: float, high: float) -> Column:
    return F.coalesce(F.size(F.filter(a, lambda x: F.coalesce(F.isnan(x) | (x < low) | (x > high), F.lit(False)))), F.lit(0))


def length(a: Column) -> Column:
    """Number of elements; -1 for null."""
    return F.coalesce(F.size(a), F.lit(-1))


def in_order(order: Column, a: Column) -> Column:
    """An aggregate: the group's arrays, one after another by `order`."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), a.alias("a"))))
    return F.flatten(F.transform(F.filter(rows, lambda r: r["a"].isNotNull()), lambda r: r["a"]))


def led_steps(a: Column) -> Column:
    """Differences of neighbours after one missing element, so the length stays."""
    return F.when(F.size(a) > 0, F.concat(F.array(F.lit(None).cast("double")), steps(a))).otherwise(a)


def resampled(a: Column, n: Column) -> Column:
    """Linear interpolation to n points, both ends included."""
    size = F.size(a)

    def at(i: Column) -> Column:
        x = i * (size - 1) / F.greatest(F.lit(1), n - 1)
        low = F.floor(x).cast("int")
        p, q = F.get(a, low), F.get(a, F.least(low + 1, size - 1))
        return p + (q - p) * (x - low)

    return F.when((size > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def window_starts(n: Column, length_: int = 30, hop: int = 15) -> Column:
    """First samples of the full windows of a series."""
    return F.when(n >= length_, F.sequence(F.lit(0), n - length_, F.lit(hop))).otherwise(F.array().cast("array<int>"))


def masked(a: Column, skip: int = 2) -> Column:
    """1 where an element can be used: not among the first `skip`, not missing."""
    return F.transform(a, lambda x, i: F.when((i >= skip) & x.isNotNull() & ~F.isnan(x), 1.0).otherwise(0.0))


def filled(a: Column) -> Column:
    return F.transform(a, lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)))
