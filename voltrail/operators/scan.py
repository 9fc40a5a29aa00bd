"""Running values over trips of any length: a segmented prefix scan.

A trip is ordered by time. Ordinary trips are one window each. A trip of very many rows is
cut into pieces: its rows are range-partitioned by trip and time, and a row's `piece` is the number of its
partition, or of a run of so many rows in it. Every operator here then works inside the pieces, reduces each
piece to a small carry (its last value, its sum, ...), scans the carries of a trip's pieces,
and applies them to the pieces' rows. Carries are as many as pieces, so they are broadcast
behind a count; the rows of long trips are written once a step, so no step is done twice.

    flagged = scan.spread(telemetry, lambda t: segments.label_segments(...))

runs any chain of operators so; without long trips it is the chain itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from voltrail.operators import rows as R
from voltrail.sources.stage import staged

PIECE = "piece"
#: Rows of a trip above which it is cut, and of a piece, about.
MOST_ROWS = 1_000_000
#: Carries, or long trips, up to which they are broadcast; beyond, the join shuffles.
BROADCAST_CARRIES = 100_000
#: Rows of a range, at least, where pieces are shorter: one range then holds many pieces.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class Carry:
    """A value that a row takes from the rows of its trip before or after it.

    kind: lag, lead (the neighbour's value), last, following (the nearest value before or after
    that is not null, the own row left out), total (the sum up to and with the own row),
    least, most, sum (over the whole trip). The value holds no window.
    """

    kind: str
    value: Column


def lag(c: str | Column) -> Carry:
    return Carry("lag", _column(c))


def lead(c: str | Column) -> Carry:
    return Carry("lead", _column(c))


def last(c: str | Column) -> Carry:
    return Carry("last", _column(c))


def following(c: str | Column) -> Carry:
    return Carry("following", _column(c))


def total(c: str | Column) -> Carry:
    return Carry("total", _column(c))


def least(c: str | Column) -> Carry:
    return Carry("least", _column(c))


def most(c: str | Column) -> Carry:
    return Carry("most", _column(c))


def whole_sum(c: str | Column) -> Carry:
    return Carry("sum", _column(c))


def row_no() -> Carry:
    return total(F.lit(1))


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WHOLE = {"least": F.min, "most": F.max, "sum": F.sum}


def _inside(c: Carry, keys: list[str]) -> Column:
    """The value as far as the rows of one window tell it; neighbours come in a struct, so that a null one differs from none."""
    forth = Window.partitionBy(*keys).orderBy(R.TIME, R.TIE)
    back = Window.partitionBy(*keys).orderBy(F.desc(R.TIME), F.desc(R.TIE))
    earlier: Callable[[WindowSpec], WindowSpec] = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "lag": lambda: F.lag(F.struct(c.value.alias("x"))).over(forth), "lead": lambda: F.lead(F.struct(c.value.alias("x"))).over(forth),
        "last": lambda: F.last(c.value, ignorenulls=True).over(earlier(forth)), "following": lambda: F.last(c.value, ignorenulls=True).over(earlier(back)),
        "total": lambda: F.sum(c.value).over(forth.rowsBetween(Window.unboundedPreceding, 0)),
    }.get(c.kind, lambda: _WHOLE[c.kind](c.value).over(Window.partitionBy(*keys)))()


def _end(c: Carry) -> Column:
    """What a piece gives to the others."""
    order = F.struct(R.TIME, R.TIE)
    some = F.when(c.value.isNotNull(), order)
    return {
        "lag": lambda: F.max_by(F.struct(c.value.alias("x")), order), "lead": lambda: F.min_by(F.struct(c.value.alias("x")), order),
        "last": lambda: F.max_by(c.value, some), "following": lambda: F.min_by(c.value, some), "total": lambda: F.sum(c.value),
    }.get(c.kind, lambda: _WHOLE[c.kind](c.value))()


def _carried(c: Carry, name: str) -> Column:
    """The scan of the pieces' ends."""
    forth = Window.partitionBy(R.TRIP).orderBy(PIECE)
    back = Window.partitionBy(R.TRIP).orderBy(F.desc(PIECE))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "lag": lambda: F.lag(name).over(forth), "lead": lambda: F.lead(name).over(forth),
        "last": lambda: F.last(name, ignorenulls=True).over(earlier(forth)), "following": lambda: F.last(name, ignorenulls=True).over(earlier(back)),
        "total": lambda: F.sum(name).over(earlier(forth)),
    }.get(c.kind, lambda: _WHOLE[c.kind](F.col(name)).over(Window.partitionBy(R.TRIP)))()


def _together(c: Carry, here: Column, carry: Column) -> Column:
    if c.kind in ("lag", "lead"):
        return F.coalesce(here, carry)["x"]
    if c.kind in ("last", "following"):
        return F.coalesce(here, carry)
    return F.coalesce(here + carry, here, carry) if c.kind == "total" else carry


def over_trips(df: DataFrame, **columns: Carry) -> DataFrame:
    """`df` with the columns; a table with `piece` is scanned piece by piece, any other one trip by trip."""
    if PIECE not in df.columns:
        return df.withColumns({k: _inside(c, [R.TRIP])["x"] if c.kind in ("lag", "lead") else _inside(c, [R.TRIP]) for k, c in columns.items()})
    whole = {k: c for k, c in columns.items() if c.kind in _WHOLE}
    here = {f"_here_{k}": F.lit(None) if k in whole else _inside(c, [R.TRIP, PIECE]) for k, c in columns.items()}
    local = staged(df.withColumns({k: c for k, c in here.items() if k[6:] not in whole}))
    ends = staged(local.groupBy(R.TRIP, PIECE).agg(*(_end(c).alias(f"_end_{k}") for k, c in columns.items())))
    carries = ends.select(F.col(R.TRIP).alias("_trip"), F.col(PIECE).alias("_piece"), *(_carried(c, f"_end_{k}").alias(f"_end_{k}") for k, c in columns.items()))
    carries = F.broadcast(carries) if ends.count() <= BROADCAST_CARRIES else carries
    joined = local.join(carries, F.col(R.TRIP).eqNullSafe(F.col("_trip")) & (F.col(PIECE) == F.col("_piece")))
    out = joined.withColumns({k: _together(c, F.lit(None) if k in whole else F.col(f"_here_{k}"), F.col(f"_end_{k}")) for k, c in columns.items()})
    return out.drop("_trip", "_piece", *here, *(f"_end_{k}" for k in columns))


def pieces(df: DataFrame, n: int, order: Sequence[str] = (R.TIME, R.TIE), most_rows: int | None = None) -> DataFrame:
    """`df` in n ranges of trip and time, or with `most_rows` in runs of so many rows of them, numbered by `piece` in order; written."""
    ranged = df.repartitionByRange(n, R.TRIP, *order)
    if most_rows is None:
        return staged(ranged.withColumn(PIECE, F.spark_partition_id()))
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's place in it
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    return staged(ranged.sortWithinPartitions(R.TRIP, *order).withColumn(PIECE, at - place + F.floor(place / most_rows)))


def spread(df: DataFrame, chain: Callable[[DataFrame], DataFrame], most_rows: int = MOST_ROWS, order: Sequence[str] = (R.TIME, R.TIE)) -> DataFrame:
    """`chain`, made of operators over trips, of `df`: trips of more than `most_rows` rows go through it in pieces.

    There are as many ranges as cores, or as RANGE_ROWS (or `most_rows`, if more) rows need, whatever a piece's size: tasks,
    and what they report to the driver, do not grow with the number of pieces.
    """
    counts = staged(df.groupBy(F.col(R.TRIP).alias("_trip")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most_rows))
    trips, rows = counts.agg(F.count("*"), F.sum("_rows")).first()
    if not rows:
        return chain(df)
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // max(most_rows, RANGE_ROWS)))
    long = F.col(R.TRIP).eqNullSafe(F.col("_trip"))
    counts = F.broadcast(counts) if trips <= BROADCAST_CARRIES else counts
    rest = chain(df.join(counts, long, "left_anti"))
    cut = chain(pieces(df.join(counts, long, "left_semi"), n, order, most_rows))
    return rest.unionByName(cut.drop(PIECE))
