"""Runs of equal keys in batches that arrive sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(*keys: np.ndarray) -> np.ndarray:
    """Indexes at which a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], n_keys: int = 1, limit: int | None = None, at_least: int = 20_000) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of complete runs of the first `n_keys` columns. A run of more than `limit`
    rows comes in pieces, each marked True, so that no run need fit in memory."""
    held: list[pa.RecordBatch] = []
    rows, long_key = 0, None

    def key_of(t: pa.Table, i: int) -> tuple:
        return tuple(t.column(k)[i].as_py() for k in range(n_keys))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < at_least:
            continue
        t = pa.Table.from_batches(held)
        at = starts(*[t.column(k).to_numpy() for k in range(n_keys)])
        if long_key is not None and key_of(t, 0) == long_key:
            end = int(at[1]) if len(at) > 1 else t.num_rows
            yield t.slice(0, end), True
            t, at = t.slice(end), at[1:] - end
        if t.num_rows:
            long_key = None
            cut = int(at[-1])
            if cut:
                yield t.slice(0, cut), False
            t = t.slice(cut)
            if limit is not None and t.num_rows > limit:
                long_key = key_of(t, 0)
                yield t, True
                t = t.slice(t.num_rows)
        held, rows = t.to_batches(), t.num_rows
    if rows:
        t = pa.Table.from_batches(held)
        at = starts(*[t.column(k).to_numpy() for k in range(n_keys)])
        if long_key is not None and key_of(t, 0) == long_key:
            end = int(at[1]) if len(at) > 1 else t.num_rows
            yield t.slice(0, end), True
            t = t.slice(end)
        if t.num_rows:
            yield t, False
