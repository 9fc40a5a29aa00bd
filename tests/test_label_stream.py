"""Labels over a stream are those of the table: out of order within the delay, after a restart, with rows that come too late."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voltrail.operators import segments, sequences
from voltrail.streaming import labels

START = dt.datetime(2024, 1, 1)
KINDS = "trip_id string, timestamp timestamp, src_row_id long, current_odo double, speed_array array<double>"


def rows_of(seed, trips=4, n=120):
    r, out = random.Random(seed), []
    for t in range(trips):
        at, odo, stop = 0, 10.0, False
        for _ in range(r.choice([3, n])):
            at += r.choice([60] * 14 + [61, 59, 400])
            stop = r.random() < (0.65 if stop else 0.12)
            odo += 0 if stop else 0.7
            out.append((f"t{t}", START + dt.timedelta(seconds=at), len(out), None if r.random() < 0.03 else odo, [0.0] * 4 if stop else None if r.random() < 0.03 else [40.0, 50.0]))
    return out


def batch_labels(spark, rows):
    t = segments.gap_labels(segments.stop_flags(sequences.gap_flags(spark.createDataFrame(rows, KINDS))))
    return sorted((x["trip_id"], x["src_row_id"], x["row_no"], x["seg_label"]) for x in segments.label_segments(t, 4, 3).collect())


def end_of_time():
    """A row of another trip far ahead: the watermark passes all others."""
    return [("zz", START + dt.timedelta(days=9), 10**9, 0.0, [40.0]), ("zz", START + dt.timedelta(days=9, hours=3), 10**9 + 1, 0.0, [40.0])]


def test_machine_is_the_table(spark):
    """Without Spark's stream: rows in order, then the end."""
    rows = rows_of(3, trips=6)
    got = []
    for t in sorted({x[0] for x in rows}):
        m = labels.Trip(4, 3, segments.SEED)
        told = []
        for _, at, tie, odo, speed in sorted((x for x in rows if x[0] == t), key=lambda x: (x[1], x[2])):
            slow = speed is not None and max(speed) < 2
            us = int((at - START).total_seconds() * 1e6)
            told += m.told(us, tie, odo, slow)
        told += m.ended()
        got += [(t, *x) for x in told]
    assert sorted(got) == batch_labels(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_table(spark, tmp_path, seed):
    rows = rows_of(seed)
    r = random.Random(seed)
    # out of order by less than the delay
    order = sorted(rows, key=lambda x: (x[1] + dt.timedelta(seconds=r.uniform(0, 500)), x[2]))
    third = len(order) // 3
    late = [("t0", START, 10**6, 1.0, [40.0])]
    parts = [order[:third], order[third : 2 * third], order[2 * third :], end_of_time()[:1], [*late, *end_of_time()[1:]], []]
    source, sink, checkpoint = (f"{tmp_path}/{k}" for k in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(source)
        q = labels.label_stream(stream, "10 minutes", 4, 3).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
        q.awaitTermination()

    for k, part in enumerate(parts):
        if part:
            spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(source)
        if k != 1:  # a query that stops and goes on
            run()
    got = sorted((x["trip_id"], x["src_row_id"], x["row_no"], x["seg_label"]) for x in spark.read.parquet(sink).where(F.col("trip_id") != "zz").collect())
    assert got == batch_labels(spark, rows)
