"""Segment labels over a stream of telemetry (an extension: the pipeline it follows works on tables).

Each trip has a small state machine. Rows wait until the watermark has passed them, so rows
that come out of order within the delay are put in order; later ones are dropped, as Spark
does. In order, a row's gap and stop flags follow from the row before it. An open block of
drive rows is kept until a full stop, a stop at a gap or a gap ends it, or until the watermark
is further than a gap beyond its last row, when whatever comes next must open another block.
Then its rows leave with the labels that the table's operators give them. The state holds the
rows of one block and those that still wait; it lives in Spark's checkpoint, so a query goes
on after a restart where it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltrail.operators import rows as R
from voltrail.operators import segments

NEAR_S, FAR_S = 59.0, 61.0  # seconds between rows that are no gap
ODO_KM = 0.05


class Trip:
    """The machine of one trip: told rows in order, it tells labels of blocks that are closed."""

    def __init__(self, min_rows: int, full_stop: int, seed: int, known: dict | None = None):
        self.min_rows, self.full_stop, self.seed = min_rows, full_stop, seed
        self.known = known or {"last": None, "odo": None, "row": 0, "segment": 0, "block": [], "run": [], "hard": False}

    def flag(self, us: int, odo: float | None, slow: bool) -> int:
        k = self.known
        s = None if k["last"] is None else (us - k["last"]) / 1e6
        still = k["odo"] is None or odo is None or abs(odo - k["odo"]) < ODO_KM
        gap = s is not None and s > 0 and not NEAR_S <= s <= FAR_S
        k["last"], k["odo"] = us, odo
        stop = slow and still
        return (segments.STOP_AT_GAP if stop else segments.GAP) if gap else segments.STOP if stop else 0

    def told(self, us: int, tie: int, odo: float | None, slow: bool) -> Iterator[tuple[int, int, int]]:
        """(tie, row_no, label) of rows whose labels this row settles."""
        k = self.known
        flag = self.flag(us, odo, slow)
        k["row"] += 1
        row = [tie, k["row"], flag]
        if flag == segments.STOP:
            if k["hard"]:
                yield tuple(row)
                return
            k["run"].append(row)
            if len(k["run"]) >= self.full_stop:
                yield from self.closed()
                yield from map(tuple, k["run"])
                k["run"], k["hard"] = [], True
            return
        k["block"] += k["run"]
        k["run"], k["hard"] = [], False
        if flag != 0:
            yield from self.closed()
        if flag == segments.STOP_AT_GAP:
            yield tuple(row)
        else:
            k["block"].append(row)

    def closed(self) -> Iterator[tuple[int, int, int]]:
        """The open block's labels; short stops in it stay stops."""
        k = self.known
        block, k["block"] = k["block"], []
        drives = [r for r in block if r[2] == 0]
        gap = int(bool(block) and block[0][2] == segments.GAP)
        n = (len(drives) + gap) // self.min_rows if drives else 0
        ends = segments.segment_ends(n, (len(drives) + gap) % self.min_rows, self.min_rows, self.seed) if n else None
        place, j, before = None, gap, None
        for tie, row_no, flag in block:
            label = flag
            if flag == 0 and n:
                j += 1
                place = int(np.searchsorted(ends, j))
                k["segment"] += place != before
                before, label = place, k["segment"]
            yield tie, row_no, label

    def ended(self) -> Iterator[tuple[int, int, int]]:
        """What is open when no row can follow without a gap."""
        k = self.known
        k["block"] += k["run"]
        k["run"] = []
        yield from self.closed()


def _labelling(min_rows: int, full_stop: int, seed: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "trip": None}
        trip, waiting = Trip(min_rows, full_stop, seed, held["trip"]), held["waiting"]
        for f in () if state.hasTimedOut else frames:
            odo = f["current_odo"].astype(object).where(f["current_odo"].notna(), None)
            waiting += [list(x) for x in zip(f["us"].tolist(), f["src_row_id"].tolist(), odo.tolist(), f["slow"].tolist())]
        waiting.sort(key=lambda x: (x[0], x[1]))
        passed = state.getCurrentWatermarkMs() * 1_000
        n = next((i for i, x in enumerate(waiting) if x[0] > passed), len(waiting))
        out = [y for x in waiting[:n] for y in trip.told(*x)]
        waiting = waiting[n:]
        last = trip.known["last"]
        over = None if last is None else last + int(FAR_S * 1e6)
        if over is not None and passed > over:
            out += trip.ended()
        open_ = trip.known["block"] or trip.known["run"]
        state.update((json.dumps({"waiting": waiting, "trip": trip.known}),))
        if waiting or open_:
            due = min([x[0] for x in waiting[:1]] + ([over] if open_ else []))
            state.setTimeoutTimestamp(max(due // 1_000 + 1, passed // 1_000 + 1))
        if out:
            yield pd.DataFrame({R.TRIP: key[0], R.TIE: [x[0] for x in out], "row_no": [x[1] for x in out], "seg_label": [x[2] for x in out]})

    return run


def label_stream(rows: DataFrame, delay: str = "10 minutes", min_rows: int = segments.MIN_ROWS, full_stop: int = segments.FULL_STOP, seed: int = segments.SEED) -> DataFrame:
    """trip_id, src_row_id, row_no, seg_label of a stream's rows, when their block is closed. delay: how late a row may come."""
    trip = dict(rows.dtypes)[R.TRIP]
    time = F.col(R.TIME).cast("timestamp")
    slow = F.coalesce(segments.slow(), F.lit(False))
    told = rows.withWatermark(R.TIME, delay).select(R.TRIP, R.TIME, F.unix_micros(time).alias("us"), F.col(R.TIE).cast("long").alias(R.TIE), F.col("current_odo").cast("double").alias("current_odo"), slow.alias("slow"))
    out = f"{R.TRIP} {trip}, {R.TIE} long, row_no int, seg_label int"
    return told.groupBy(R.TRIP).applyInPandasWithState(_labelling(min_rows, full_stop, seed), out, "known string", "append", GroupStateTimeout.EventTimeTimeout)
