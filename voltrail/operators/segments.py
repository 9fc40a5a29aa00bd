"""Segmentation: stops, gaps, driving blocks cut into segments, anchors, invariants, summaries.

Labels of a row: a segment's number (from 1 in each trip), 0 drive outside a
segment, -1 stop, -2 gap, -3 stop at a gap. All is running values over trips, which
may be cut into pieces (see scan).
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions import arrays
from voltrail.operators import rows as R
from voltrail.operators import scan

MIN_ROWS, FULL_STOP, SEED = 10, 3, 42
STOP, GAP, STOP_AT_GAP = -1, -2, -3


def slow(max_kph: float = 2.0, low_kph: float = 0.5, low_share: float = 0.9) -> Column:
    """Whether the whole minute is slow, and nearly all of it near standing."""
    a = F.col("speed_array")
    return (arrays.max_or_inf(a) < max_kph) & (arrays.share_below(a, low_kph) >= low_share)


def _with_still(df: DataFrame, odo_km: float) -> DataFrame:
    """_still: the odometer moved less than odo_km since the row before."""
    moved = F.col("current_odo") - F.col("_odo")
    return scan.over_trips(df, _odo=scan.lag("current_odo")).withColumn("_still", F.abs(F.coalesce(moved, F.lit(0.0))) < odo_km).drop("_odo")


def stop_flags(df: DataFrame, max_kph: float = 2.0, low_kph: float = 0.5, low_share: float = 0.9, odo_km: float = 0.05) -> DataFrame:
    """stop_flag -1 where the whole minute is slow, nearly all of it near standing, and the odometer stands."""
    placed = _with_still(df, odo_km)
    return placed.withColumn("stop_flag", F.when(slow(max_kph, low_kph, low_share) & F.col("_still"), STOP).otherwise(0)).drop("_still")


def half_stops(df: DataFrame, max_kph: float = 2.0, low_kph: float = 0.5, low_share: float = 0.9, odo_km: float = 0.05) -> DataFrame:
    """Rows at which one or two of the three conditions hold; a trip's first row only where the speed ones disagree."""
    a = F.col("speed_array")
    low, share = arrays.max_or_inf(a) < max_kph, arrays.share_below(a, low_kph) >= low_share
    placed = scan.over_trips(_with_still(df, odo_km), _row=scan.row_no())
    n = low.cast("int") + share.cast("int") + F.col("_still").cast("int")
    marked = placed.withColumns({"conditions": n, "_differ": low != share})
    return marked.where(F.col("conditions").between(1, 2) & ((F.col("_row") > 1) | F.col("_differ"))).drop("_row", "_differ", "_still")


def gap_labels(df: DataFrame, gap: str = "is_start_after_gap") -> DataFrame:
    """Marks gaps in stop_flag; without the column it stays as it is."""
    if gap not in df.columns:
        return df
    f = F.col("stop_flag")
    return df.withColumn("stop_flag", F.when(F.col(gap) == 1, F.when(f == STOP, STOP_AT_GAP).otherwise(GAP)).otherwise(f))


def parted(total: int, parts: int, seed: int = SEED) -> list[int]:
    """A random split of `total` into `parts` sizes of at least 0: bars drawn among stars."""
    if parts <= 1:
        return [total]
    bars = [0, *sorted(random.Random(seed).sample(range(1, total + parts), parts - 1)), total + parts]
    return [b - a - 1 for a, b in zip(bars, bars[1:])]


@lru_cache(maxsize=1024)
def segment_ends(n: int, rem: int, min_rows: int = MIN_ROWS, seed: int = SEED) -> np.ndarray:
    """The last driving row (from 1) of each segment of a block of n * min_rows + rem driving rows."""
    return np.cumsum([min_rows + extra for extra in parted(rem, n, seed)])


def _segment_of(min_rows: int, seed: int) -> Callable[..., Column]:
    """The segment (from 0) of a block's driving row, from the block's size in rows and the row's place; null if there is none."""

    @F.pandas_udf("int")
    def place(driving: pd.Series, order: pd.Series) -> pd.Series:
        out = pd.array([pd.NA] * len(order), dtype="Int32")
        size = driving.to_numpy(np.float64, na_value=np.nan)
        for d in np.unique(size[size >= min_rows]):
            at = np.flatnonzero(size == d)
            out[at] = np.searchsorted(segment_ends(int(d) // min_rows, int(d) % min_rows, min_rows, seed), order.to_numpy()[at])
        return pd.Series(out)

    return place


def label_segments(df: DataFrame, min_rows: int = MIN_ROWS, full_stop: int = FULL_STOP, seed: int = SEED) -> DataFrame:
    """Adds row_no and seg_label from stop_flag.

    Blocks lie between full stops (runs of at least `full_stop` stop rows), stops at
    gaps, and gaps; a gap row opens its block. A block's driving rows, up to its last
    drive row, make as many segments of `min_rows` as fit; what is left lengthens
    them at random, the same way for all blocks of one size, whatever it is.
    """
    f, row = F.col("stop_flag"), F.col("row_no")
    d = scan.over_trips(df, row_no=scan.row_no(), _before=scan.lag("stop_flag"), _rows=scan.whole_sum(F.lit(1)))
    # runs of equal flags: from the own edge to the next one
    edge = F.when(~F.coalesce(f == F.col("_before"), F.lit(False)), row)
    d = scan.over_trips(d, _start=scan.last(edge), _next=scan.following(edge))
    run = F.coalesce("_next", F.col("_rows") + 1) - F.coalesce(edge, "_start")
    d = d.withColumn("_hard", (f == STOP_AT_GAP) | ((f == STOP) & (run >= full_stop)))
    # blocks begin after hard rows and at gap rows; only drive rows are placed, so those before and in a block tell its size
    drive = ((f == 0) & ~F.col("_hard")).cast("int")
    d = scan.over_trips(d, _drives=scan.total(drive), _begun=scan.lag("_hard"))
    begins = F.when(F.col("_begun").isNull() | F.col("_begun") | F.col("_hard") | (f == GAP), F.struct(row.alias("i"), (F.col("_drives") - drive).alias("base"), (f == GAP).cast("int").alias("gap")))
    d = d.withColumn("_begins", begins)
    d = scan.over_trips(d, _block=scan.last("_begins"), _after=scan.following("_begins"), _all=scan.most("_drives"))
    d = d.withColumn("_block", F.coalesce("_begins", "_block"))
    # a gap row opens its block and counts in it, if drive rows follow
    driving = F.coalesce("_after.base", "_all") - F.col("_block.base") + F.col("_block.gap")
    order = F.col("_drives") - F.col("_block.base") + F.col("_block.gap")
    # only drive rows are placed; the split is a seeded draw, which SQL functions can't make
    d = d.withColumn("_s", _segment_of(min_rows, seed)(F.when((f == 0) & ~F.col("_hard"), driving).cast("int"), order.cast("int")))
    d = d.withColumn("_key", F.when((f == 0) & F.col("_s").isNotNull(), F.struct(F.col("_block.i").alias("i"), F.col("_s").alias("s"))))
    # segments are numbered where a new one begins, in order of rows
    d = scan.over_trips(d, _prev=scan.last("_key"))
    d = d.withColumn("_new", (F.col("_key").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_prev"))).cast("int"))
    d = scan.over_trips(d, _number=scan.total("_new"))
    d = d.withColumn("seg_label", F.when(F.col("_key").isNotNull(), F.col("_number")).otherwise(f).cast("int"))
    return d.select(*df.columns, "row_no", "seg_label")


def _neighbours(labelled: DataFrame, full_stop: int) -> DataFrame:
    """Around each row: _own, the segment row it is, with the first row of its span, plain or anchored; the last such row before it, the next one after it."""
    label, row = F.col("seg_label"), F.col("row_no")
    moving = F.when(label != STOP, F.struct("row_no", "seg_label"))
    d = scan.over_trips(labelled, _moving=scan.last(moving), _label=scan.last(F.when(label > 0, label)))
    near = (F.col("_moving.seg_label") == GAP) & (row - F.col("_moving.row_no") - 1 < full_stop)
    begins = ~F.coalesce(F.col("_label") == label, F.lit(False))
    own = F.struct(label.alias("segment_id"), row.alias("row_no"), begins.alias("begins"), F.when(begins & near, F.col("_moving.row_no")).otherwise(row).alias("anchor"))
    d = d.withColumn("_own", F.when(label > 0, own)).drop("_moving")
    return scan.over_trips(d, _next=scan.following("_own"))


def spans(labelled: DataFrame, full_stop: int = FULL_STOP) -> DataFrame:
    """trip_id, segment_id, first_row, last_row, anchor_row.

    The anchor is the gap row before the segment, where only a short stop lies between; else the first row.
    """
    d = _neighbours(labelled, full_stop).where("_own is not null")
    first = F.when(F.col("_own.begins"), F.col("_own.anchor"))
    return d.groupBy(R.TRIP, F.col("seg_label").alias("segment_id")).agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.max(first).alias("anchor_row"))


def span_rows(labelled: DataFrame, full_stop: int = FULL_STOP, anchored: bool = False) -> DataFrame:
    """The rows of each segment's span, from its first (or anchor) row to its last, with segment_id.

    A row lies in a span if it is one of the segment's, if the segment's rows are on both its
    sides, or if it lies between the anchor and the first row.
    """
    d = _neighbours(labelled, full_stop)
    inside = F.when(F.col("_next.segment_id") == F.col("_label"), F.col("_label"))
    ahead = F.when(F.col("_next.begins") & (F.col("row_no") >= F.col("_next.anchor")), F.col("_next.segment_id")) if anchored else F.lit(None).cast("int")
    d = d.withColumn("segment_id", F.coalesce("_own.segment_id", inside, ahead))
    return d.where("segment_id is not null").drop("_own", "_next", "_label")


def rule_violations(labelled: DataFrame, min_rows: int = MIN_ROWS, full_stop: int = FULL_STOP, most_rows: int | None = None) -> DataFrame:
    """trip_id, segment_id, rule for every broken invariant of a segment's anchored span; most_rows: driving rows, 2 * min_rows - 1 if not given."""
    d = span_rows(labelled, full_stop, anchored=True)
    seg = Window.partitionBy(R.TRIP, "segment_id")
    inner = seg.orderBy("row_no")
    d = d.withColumn("_stop", (F.col("seg_label") == STOP).cast("int"))
    d = d.withColumn("_block", F.sum(1 - F.col("_stop")).over(inner)).withColumn("_run", F.sum("_stop").over(Window.partitionBy(R.TRIP, "segment_id", "_block")))
    agg = d.groupBy(R.TRIP, "segment_id").agg(
        F.min_by("seg_label", "row_no").alias("at_start"), F.max_by("seg_label", "row_no").alias("at_end"),
        F.min("row_no").alias("lo"), F.max("_run").alias("run"),
        F.sum((F.col("seg_label").isin(GAP, STOP_AT_GAP)).cast("int")).alias("gaps"), F.sum(F.col("seg_label").isin(0, GAP).cast("int") + (F.col("seg_label") > 0).cast("int")).alias("driving"),
    )
    inside = F.col("gaps") - F.col("at_start").isin(GAP, STOP_AT_GAP).cast("int")
    broken = {
        "start": F.col("at_start").isin(STOP, STOP_AT_GAP), "end": F.col("at_end") < 0, "inside_gap": inside > 0,
        "too_short": F.col("driving") < min_rows, "too_long": F.col("driving") > (2 * min_rows - 1 if most_rows is None else most_rows), "full_stop": F.col("run") >= full_stop,
    }
    rules = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in broken.items())), lambda x: x.isNotNull())
    return agg.select(R.TRIP, "segment_id", F.explode(rules).alias("rule"))


def stop_summary(df: DataFrame) -> DataFrame:
    """Rows, stops, their share, trips with a stop, stops per trip."""
    stop = F.col("stop_flag") == STOP
    out = df.agg(F.count("*").alias("rows"), F.sum(R.flag(stop)).alias("stops"), F.countDistinct(R.TRIP).alias("trips"), F.countDistinct(F.when(stop, F.col(R.TRIP))).alias("trips_with_stop"))
    return out.withColumns({"stop_pct": F.try_divide(100.0 * F.col("stops"), F.col("rows")), "stops_per_trip": F.try_divide(1.0 * F.col("stops"), F.col("trips"))})


def gap_summary(df: DataFrame, gap: str = "is_start_after_gap") -> DataFrame:
    """Of rows with gap labels: how many gaps, trips affected, and the new labels with their shares."""
    f = F.col("stop_flag")
    n = lambda c: F.sum(R.flag(c)).alias
    any_gap = f.isin(GAP, STOP_AT_GAP)
    out = df.agg(
        F.count("*").alias("rows"), F.countDistinct(R.TRIP).alias("trips"), n(F.col(gap) == 1)("gaps"), F.countDistinct(F.when(any_gap, F.col(R.TRIP))).alias("trips_with_gap"),
        n(f == GAP)("gap_only"), n(f == STOP_AT_GAP)("stop_at_gap"), n(f == STOP)("stops_left"), n(f.isin(STOP, STOP_AT_GAP))("stops_before"),
    )
    share = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return out.withColumns({"trips_pct": share("trips_with_gap", "trips"), "gap_only_pct": share("gap_only", "rows"), "stop_at_gap_pct": share("stop_at_gap", "rows")})


def label_summary(labelled: DataFrame) -> DataFrame:
    """How many rows have each kind of label."""
    n = lambda c: F.sum(R.flag(c)).alias
    s = F.col("seg_label")
    return labelled.agg(n(s > 0)("in_segment"), n(s == 0)("unsegmented"), n(s == STOP)("stops"), n(s == GAP)("gaps"), n(s == STOP_AT_GAP)("stops_at_gap"))


def segments_per_trip(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(R.TRIP).agg(F.greatest(F.lit(0), F.max("seg_label")).alias("segments"))


def segment_coverage(labelled: DataFrame) -> DataFrame:
    """Trips with no, at least one, two and three segments."""
    s = F.col("segments")
    n = lambda c: F.sum(c.cast("int"))
    return segments_per_trip(labelled).agg(F.count("*").alias("trips"), n(s == 0).alias("none"), *(n(s >= k).alias(f"at_least_{k}") for k in (1, 2, 3)))


def longest_span(labelled: DataFrame) -> DataFrame:
    """The segment of the longest span; of equals the first by trip and number."""
    s = spans(labelled).select(R.TRIP, "segment_id", (F.col("last_row") - F.col("first_row") + 1).alias("span_rows"))
    return s.orderBy(F.desc("span_rows"), R.TRIP, "segment_id").limit(1)


def at_least_segments(labelled: DataFrame, n: int) -> DataFrame:
    """Rows of trips whose highest label is at least n."""
    return scan.over_trips(labelled, _most=scan.most("seg_label")).where(F.col("_most") >= n).drop("_most")
