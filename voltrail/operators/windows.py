"""Fixed windows of a segment's signals, and pairs of windows for learning driver embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from voltrail.functions import arrays, scalars
from voltrail.operators import rows as R
from voltrail.operators import segments, selection

KEYS = [R.TRIP, "seg_id", "win_id"]
BUCKET = 1_000  # trips that are numbered together, about


def signals(labelled: DataFrame, full_stop: int = segments.FULL_STOP) -> DataFrame:
    """trip_id, seg_id, accel, jerk, slope_rate: arrays of one sample a second over each anchored span."""
    d = segments.span_rows(labelled, full_stop, anchored=True)
    row = F.col("row_no")
    d = d.groupBy(R.TRIP, F.col("segment_id").alias("seg_id")).agg(arrays.in_order(row, F.col("speed_array")).alias("kph"), arrays.in_order(row, F.col("altitude_array")).alias("alt"))
    d = d.withColumn("mps", F.transform("kph", scalars.mps)).withColumn("accel", arrays.led_steps(F.col("mps")))
    d = d.withColumn("jerk", arrays.led_steps(F.col("accel")))
    d = d.withColumn("slope_rate", arrays.led_steps(arrays.resampled(F.col("alt"), F.size("kph"))))
    return d.select(R.TRIP, "seg_id", "accel", "jerk", "slope_rate")


def windows(signals_df: DataFrame, length: int = 30, hop: int = 15) -> DataFrame:
    """A row for each full window of each segment."""
    d = signals_df.select("*", F.posexplode(arrays.window_starts(F.size("accel"), length, hop)).alias("win_id", "start_sample"))
    return d.select(*KEYS, "start_sample", *(F.slice(c, F.col("start_sample") + 1, F.lit(length)).alias(c) for c in ("accel", "jerk", "slope_rate")))


def tensors(windows_df: DataFrame) -> DataFrame:
    """Windows with missing samples as 0, and a mask of the samples to be used."""
    return windows_df.withColumn("mask", arrays.masked(F.col("accel"))).withColumns({c: arrays.filled(F.col(c)) for c in ("accel", "jerk", "slope_rate")})


def pairs(windows_df: DataFrame, same_share: float = 0.2, apart: int = 5, seed: int = 7) -> DataFrame:
    """A partner for each window: its keys and b_ keys, and label 1 (same trip) or 0 (another).

    A hash (md5, the same in every run and engine) of the window says which kind. Of the same trip: a window of another segment
    where there is one, else one at least `apart` windows away. Of another trip: a trip
    and a window of it, both drawn by the window's hash. Each window looks at a few
    places by hash, not at all others; no window without a partner is made up.
    """
    h = lambda *c: selection.drawn(seed, *(F.col(x) if isinstance(x, str) else x for x in c))
    w = windows_df.select(*KEYS).withColumn("_h", h(*KEYS))
    w = w.withColumn("_same", F.pmod("_h", F.lit(1 << 20)) < same_share * (1 << 20))
    trip = Window.partitionBy(R.TRIP)
    # places of a trip's windows by segment: the windows of another segment are those outside one run of places
    by_seg = trip.orderBy("seg_id", "win_id")
    own = Window.partitionBy(R.TRIP, "seg_id")
    w = w.withColumn("_p", F.row_number().over(by_seg)).withColumn("_n", F.count("*").over(trip)).withColumn("_m", F.count("*").over(own)).withColumn("_lo", F.min("_p").over(own))
    others = F.col("_n") - F.col("_m")
    pick = F.pmod(h("_h", F.lit("p")), F.greatest(F.lit(1), others)) + 1
    place = F.when(others > 0, F.when(pick < F.col("_lo"), pick).otherwise(pick + F.col("_m")))
    far_left, far_right = F.greatest(F.lit(0), F.col("_p") - F.lit(apart)), F.greatest(F.lit(0), F.col("_n") - F.col("_p") - F.lit(apart - 1))
    far = F.pmod(h("_h", F.lit("q")), F.greatest(F.lit(1), far_left + far_right)) + 1
    alone = F.when((others == 0) & (far_left + far_right > 0), F.when(far <= far_left, far).otherwise(far - far_left + F.col("_p") + apart - 1))
    w = w.withColumn("_place", F.when(F.col("_same"), F.coalesce(place, alone)))
    partner = w.select(R.TRIP, F.col("_p").alias("_place"), F.col("seg_id").alias("b_seg_id"), F.col("win_id").alias("b_win_id"))
    same = w.where("_same").join(partner, [R.TRIP, "_place"]).select(*KEYS, F.col(R.TRIP).alias("b_trip_id"), "b_seg_id", "b_win_id", F.lit(1).alias("label"))
    # another trip: trips sit in buckets by hash; a window draws a bucket, a seat there, and a window of that trip
    trips = w.groupBy(R.TRIP).agg(F.count("*").alias("_n"))
    me = F.struct(F.col(R.TRIP).alias("t"), F.col("_n").alias("n"))
    by_hash = F.struct(h(R.TRIP).alias("o"), me.alias("x"))
    ends = trips.agg(F.min(by_hash).alias("a"), F.max(by_hash).alias("z"), F.count("*").alias("trips")).first()
    if ends["a"] is None:
        return same
    bucket = lambda c: F.pmod(h(c, F.lit("b")), F.lit(max(1, ends["trips"] // BUCKET)))
    trips = trips.withColumn("_b", bucket(R.TRIP))
    ring = Window.partitionBy("_b").orderBy(h(R.TRIP, F.lit("r")), R.TRIP)
    after = F.coalesce(F.lead(me).over(ring), F.first(me).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    seats = trips.select("_b", (F.row_number().over(ring) - 1).cast("long").alias("_o"), me.alias("_x"), after.alias("_y"))
    sizes = trips.groupBy("_b").agg(F.count("*").alias("_s"))
    drawn = w.where("not _same").select(*KEYS, "_h").withColumn("_b", bucket("_h")).join(sizes, "_b", "left")
    drawn = drawn.withColumn("_o", F.pmod(h("_h", F.lit("o")), F.coalesce("_s", F.lit(1)))).join(seats, ["_b", "_o"], "left")

    def literal(end: Row) -> Column:
        return F.struct(F.lit(end["x"]["t"]).alias("t"), F.lit(end["x"]["n"]).alias("n"))

    # an empty bucket, or one that holds the own trip alone: the trip of the least hash of all, or that one the greatest
    other = lambda c: F.when(F.col(f"{c}.t") != F.col(R.TRIP), F.col(c))
    lone = F.when(F.col(R.TRIP) != F.lit(ends["a"]["x"]["t"]), literal(ends["a"])).otherwise(literal(ends["z"]))
    drawn = drawn.withColumn("_x", F.coalesce(other("_x"), other("_y"), lone)).where(F.col("_x.t") != F.col(R.TRIP))
    drawn = drawn.select(*KEYS, F.col("_x.t").alias("b_trip_id"), (F.pmod(h("_h", F.lit("w")), F.col("_x.n")) + 1).alias("_place"))
    theirs = partner.withColumnRenamed(R.TRIP, "b_trip_id")
    different = drawn.join(theirs, ["b_trip_id", "_place"]).select(*KEYS, "b_trip_id", "b_seg_id", "b_win_id", F.lit(0).alias("label"))
    return same.unionByName(different)
