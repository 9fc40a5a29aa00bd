"""Connected components over a table of links: local contraction and alternating stars.

Each round first contracts every partition's own links to stars, in bounded pieces;
a table of few links is one partition, and done. Else it links every vertex's larger
neighbours to its smallest neighbour, then the smaller ones likewise; the number of
rounds grows with the logarithm of a component's diameter. All steps are joins and
partial aggregates over the links, so a vertex with very many links is
pre-aggregated where it is read and its join can be split; nothing is gathered on
the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.workspace import Workspace

PART = 250_000  # links of a partition, about
PIECE = 1_000_000  # links contracted at once, at most about


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex but the smallest of its component, with that."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (root[x], root[y], x, y):
            np.minimum.at(new, side, low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other], ids[root[other]]


def _contracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def piece() -> pa.RecordBatch:
        a, b = contracted(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for x in batches:
        held.append(x)
        rows += x.num_rows
        if rows >= PIECE:
            yield piece()
            held, rows = [], 0
    if rows:
        yield piece()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        smaller = joined.where(F.col("b") < F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = smaller.unionByName(least.where("m < a").select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """vertex, component (its smallest reachable vertex) for every vertex of a link; columns a, b."""
    e = ws.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, last = e.count(), None
    for _ in range(max_rounds):
        parts = max(1, -(-n // PART))
        local = e.coalesce(parts).mapInArrow(_contracting, "a bigint, b bigint")
        if n <= min(PART, PIECE):
            e = ws.table(local)
            break
        e = ws.table(_star(_star(local, large=True), large=False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last, n = now, now[0]
    else:
        raise RuntimeError(f"links not settled after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return ws.table(e.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots))
