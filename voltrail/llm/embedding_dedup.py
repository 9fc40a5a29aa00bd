"""Near-duplicate embeddings by an exact metric range join.

Vectors are compared only inside a (label, dimension). On unit vectors a cosine
of at least `cosine` is a distance of at most r. Pivots cut each large label into
cells: a vector's home is the cell of its nearest pivot. By the triangle
inequality a vector can have a partner in another cell only if its distance to
that cell's border is at most r; in the plane of the two pivots that border is
their bisector, so x visits cell q when (x.p - x.q) / |p - q| <= r. Of two cells
only the later one's vectors visit the earlier, so every pair meets exactly once,
and each cell is then joined on its own.

Equal vectors are contracted before and counted, so a group of copies costs one
row. A cell's residents are dealt into blocks of at most about `block` rows, and
its visitors stream past each block, so memory is bounded whatever a cell holds;
a dense cell of G different vectors costs G^2 / 2 products, in G / block tasks,
and emits only counts and a spanning set of links, never all pairs.

Pivots are a sample of a cell, drawn by hash, each further than 4r from the others,
so that a dense group is never cut; any pivots give the exact result, they only set
the cost. A cell has at most `fan` of them, and so few that its residents visit
`copies` cells at most in the mean; cells that are still large are cut again by
pivots of their own, so the number of pivots grows with the table, and none are
gathered on the driver. In a cut, visitors visit every cell in reach, residents only
earlier ones. A large cell's rows are dealt over several tasks. Every vector is joined.

Vectors that are null, empty, zero or hold null or non-finite parts, and those
with a null label, link with nothing and stay alone. Repeated rows are separate
vectors that link with each other. A null id takes part, but can't name a
component unless it is alone. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.components import components
from voltrail.llm.workspace import Workspace

COSINE = 0.98
CELL = 2_000  # residents of a cell aimed at
FAN = 256  # pivots of a cell, at most
COPIES = 2.0  # cells that a resident visits in the mean, at most, each time its cell is cut
SALT_ROWS = 50_000
ROW = 1 << 30  # the turn of a row; drawn vectors come before
BLOCK = 8_192
STRIP = 1_024
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
CELL_KEY = ["label", "dim", "cell"]
_NAMES = [*CELL_KEY, "home", "rep", "m", "v"]
_ASSIGNED = "label bigint, dim int, cell bigint, home boolean, rep bigint, m bigint, v binary"


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that squares don't overflow."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(x * y for x, y in zip(a.tolist(), b.tolist())) / math.sqrt(math.fsum(x * x for x in a.tolist()) * math.fsum(y * y for y in b.tolist()))


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which of a's rows link with which of b's; products at the very limit are summed again without error."""
    c = a @ b.T
    out = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-12)):
        out[i, j] = _exact(a[i], b[j]) >= cosine
    return out


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        flat = b.column("embedding").flatten().to_numpy()
        end = np.cumsum(dims)
        packed: list[bytes] = [b""] * len(dims)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            v = unit(flat[(end[rows] - dim)[:, None] + np.arange(dim)])
            for i, x in zip(rows.tolist(), v):
                packed[i] = x.tobytes()
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "dim", "rep", "m")), pa.array(packed, pa.binary())], names=["label", "dim", "rep", "m", "v"])


def _separated(drawn: np.ndarray, k: int, apart: float) -> np.ndarray:
    """Places of the first `k` drawn vectors that are further than `apart` from those taken before."""
    taken: list[int] = []
    for i in range(len(drawn)):
        if len(taken) < k and (not taken or (drawn[taken] @ drawn[i]).max() < 1 - apart * apart / 2):
            taken.append(i)
    return np.array(taken, int)


def _reached(v: np.ndarray, p: np.ndarray, radius: float, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivot, and the cells it visits: those within reach, for residents only the ones before their own."""
    near = v @ p.T
    best = near.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * p[best] @ p.T))
    reach = near[np.arange(len(v)), best][:, None] - near <= (radius + 1e-9) * apart
    reach[np.arange(len(v)), best] = True
    return best, reach & (~home[:, None] | (np.arange(len(p)) < best[:, None]))


def _chosen(drawn: np.ndarray, k: int, radius: float, copies: float) -> np.ndarray:
    """At most k pivots, so few that a drawn vector visits `copies` cells at most in the mean; one or none: the cell stays whole."""
    at = _separated(drawn, k, 4 * radius)
    rest = np.delete(drawn, at, 0)
    pivots = drawn[at]
    while len(pivots) > 1 and len(rest):
        if _reached(rest, pivots, radius, np.ones(len(rest), bool))[1].sum() <= copies * len(rest):
            break
        pivots = pivots[: len(pivots) // 2]
    return pivots


def _dealt(b: pa.RecordBatch, p: np.ndarray, radius: float, fan: int) -> Iterator[pa.RecordBatch]:
    """The rows of one cell in the cells of its pivots."""
    if len(p) < 2:
        yield b
        return
    for lo in range(0, b.num_rows, STRIP):
        part = b.slice(lo, STRIP)
        home = part.column("home").to_numpy(zero_copy_only=False)
        best, reach = _reached(_vectors(part.column("v"), p.shape[1]), p, radius, home)
        at = np.flatnonzero(home)
        i, q = np.nonzero(reach)
        rows, cells = np.concatenate([at, i]), np.concatenate([best[at], q])
        resident = np.arange(len(rows)) < len(at)
        for x in range(0, len(rows), 8 * STRIP):
            got = part.take(pa.array(rows[x : x + 8 * STRIP]))
            cell = got.column("cell").to_numpy() * fan + cells[x : x + 8 * STRIP] + 1
            yield pa.RecordBatch.from_arrays([got.column("label"), got.column("dim"), pa.array(cell), pa.array(resident[x : x + 8 * STRIP]), *(got.column(c) for c in ("rep", "m", "v"))], names=_NAMES)


def _splitting(radius: float, copies: float, fan: int) -> Task:
    """Rows come in order of cell and salt, drawn vectors before the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, drawn, pivots = None, [], None
        for b in batches:
            columns = [b.column(c).to_numpy() for c in ("label", "dim", "cell", "salt", "k")]
            row = b.column("turn").to_numpy() == ROW
            change = np.ones(len(row), bool)
            change[1:] = np.any([c[1:] != c[:-1] for c in [*columns, row]], axis=0)
            at = np.flatnonzero(change).tolist()
            for lo, hi in zip(at, [*at[1:], len(row)]):
                now = tuple(int(c[lo]) for c in columns)
                if now != key:
                    key, drawn, pivots = now, [], None
                part = b.slice(lo, hi - lo)
                if not row[lo]:
                    drawn.append(_vectors(part.column("v"), now[1]))
                    continue
                if pivots is None:
                    pivots = _chosen(np.concatenate(drawn), now[4], radius, copies) if drawn else np.zeros((0, now[1]))
                yield from _dealt(part.select(_NAMES), pivots, radius, fan)

    return run


def _cut(cells: DataFrame, large: DataFrame, radius: float, copies: float, fan: int) -> DataFrame:
    """The cells of `large` cut by pivots of their own; the others as they are."""
    rows = cells.join(large, CELL_KEY)
    turn = F.pmod(F.xxhash64("rep", "cell"), F.lit(ROW))
    own = F.pmod(F.xxhash64("rep"), "salts").cast("int")
    rest = ["k", *_NAMES]
    # a cell's rows are dealt over as many tasks as they need; its few drawn vectors go to each
    drawn = rows.where("home").withColumn("turn", turn).where(F.col("turn") < F.col("part") * ROW)
    drawn = drawn.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    both = drawn.select(*rest, "salt", "turn").unionByName(rows.select(*rest, own.alias("salt"), F.lit(ROW).alias("turn")))
    place = [*CELL_KEY, "salt"]
    out = both.repartition(*place).sortWithinPartitions(*place, "turn", "rep").mapInArrow(_splitting(radius, copies, fan), _ASSIGNED)
    return cells.join(large, CELL_KEY, "left_anti").select(*_NAMES).unionByName(out)


def _cells(packed: DataFrame, ws: Workspace, radius: float, cell: int, copies: float, fan: int) -> DataFrame:
    """Residents and visitors of all cells, cut again and again while cells of more than twice `cell` residents can be."""
    cells = packed.select("label", "dim", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "rep", "m", "v")
    least, levels = 0, int(62 / math.log2(fan + 1))
    for _ in range(levels):
        # numbers from `least` on are those of the last level's cells; a cell that stayed whole keeps its number and is not tried again
        sizes = cells.where(F.col("cell") >= least).groupBy(*CELL_KEY).agg(F.count_if("home").alias("n"), F.count("*").alias("total"))
        k = F.least(F.lit(fan), F.ceil(F.col("n") / cell)).cast("int")
        large = sizes.where(F.col("n") > 2 * cell).select(*CELL_KEY, k.alias("k"), ((2 * k + 16) / F.col("n")).alias("part"), F.ceil(F.col("total") / SALT_ROWS).cast("int").alias("salts"))
        large = ws.table(large)
        if large.isEmpty():
            break
        cells = ws.table(_cut(cells, large, radius, copies, fan))
        least = least * fan + 1
    return cells


class _Block:
    """The residents of one block, and the links found so far."""

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, rep: np.ndarray, m: np.ndarray, v: np.ndarray) -> None:
        self.parts.append((rep, m, v))

    def seat(self) -> Iterator[pa.RecordBatch]:
        """All residents are there: compares them with one another."""
        self.rep, self.m, self.v = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        self.n = np.zeros(len(self.rep), np.int64)
        self.ready = True
        for lo in range(0, len(self.rep), STRIP):
            hi = min(lo + STRIP, len(self.rep))
            yield from self.match(self.rep[lo:hi], self.m[lo:hi], self.v[lo:hi], until=hi, own=lo)

    def match(self, rep: np.ndarray, m: np.ndarray, v: np.ndarray, until: int | None = None, own: int | None = None) -> Iterator[pa.RecordBatch]:
        ok = linked(v, self.v[:until], self.cosine)
        if own is not None:  # each pair of residents once
            i = np.arange(len(rep))
            ok &= np.arange(ok.shape[1]) < (own + i)[:, None]
        rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(rows):
            return
        ok = ok[np.ix_(rows, cols)]
        gained = ok @ self.m[cols]
        self.n[cols] += m[rows] @ ok
        a, b = _spanning(ok, rep[rows], self.rep[cols])
        yield _found(np.zeros(len(rows), bool), rep[rows], gained)
        yield _found(np.ones(len(a), bool), a, b)

    def leave(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            yield from self.seat()
        at = np.flatnonzero(self.n)
        yield _found(np.zeros(len(at), bool), self.rep[at], self.n[at])


def _found(is_link: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(is_link), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["is_link", "a", "b"])


def _spanning(ok: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the matrix connects, one for each row and column at most."""
    big = np.iinfo(np.int64).max
    at_row, at_col = rows.copy(), cols.copy()
    while True:
        new_col = np.minimum(at_col, np.where(ok, at_row[:, None], big).min(0))
        new_row = np.minimum(at_row, np.where(ok, new_col, big).min(1))
        if (new_col == at_col).all() and (new_row == at_row).all():
            return np.concatenate([rows, cols]), np.concatenate([at_row, at_col])
        at_row, at_col = new_row, new_col


def _joining(cosine: float) -> Task:
    """Counts and links of each block; rows come in order of block, residents before visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for b in batches:
            columns = [b.column(c).to_numpy() for c in ("label", "dim", "cell", "block")]
            home, rep, m = b.column("home").to_numpy(zero_copy_only=False), b.column("rep").to_numpy(), b.column("m").to_numpy()
            change = np.ones(len(rep), bool)
            change[1:] = np.any([c[1:] != c[:-1] for c in [*columns, home]], axis=0)
            at = np.flatnonzero(change).tolist()
            for lo, hi in zip(at, [*at[1:], len(rep)]):
                now = tuple(int(c[lo]) for c in columns)
                if now != key:
                    if block is not None and block.parts:
                        yield from block.leave()
                    key, block = now, _Block(cosine)
                v = _vectors(b.column("v").slice(lo, hi - lo), now[1])
                if home[lo]:
                    block.add(rep[lo:hi], m[lo:hi], v)
                    continue
                if not block.ready:
                    if not block.parts:
                        continue
                    yield from block.seat()
                for x in range(0, hi - lo, STRIP):
                    s = slice(lo + x, min(lo + x + STRIP, hi))
                    yield from block.match(rep[s], m[s], v[x : x + STRIP])
        if block is not None and block.parts:
            yield from block.leave()

    return run


def dedup(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK, fan: int = FAN, copies: float = COPIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`."""
    ws = Workspace(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    digest = [F.when(F.col("sound"), F.xxhash64(F.lit(s), "label", "embedding")).alias(f"h{s}") for s in (1, 2)]
    hashed = rows.select("*", *digest)
    keys = ws.table(hashed.select("vec_id", "sound", "h1", "h2"))
    classes = hashed.where("sound").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = classes.select("label", F.size("embedding").alias("dim"), "rep", "m", "h1", "h2", "embedding")
    # an id that repeats over different vectors must not merge them, and a class may have none: classes have numbers of their own
    classes = ws.table(classes.withColumn("least", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()))
    packed = ws.table(classes.select("label", "dim", "rep", "m", "embedding").mapInArrow(_packing, "label bigint, dim int, rep bigint, m bigint, v binary"))

    radius = math.sqrt(2 - 2 * cosine)
    assigned = _cells(packed, ws, radius, cell, copies, fan)
    cell_key = CELL_KEY
    blocks = assigned.where("home").groupBy(*cell_key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = assigned.join(blocks, cell_key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("own", F.col("blocks") - 1))))
    dealt = dealt.withColumn("home", F.coalesce(F.col("own") == F.col("block"), F.lit(False)))
    place = [*cell_key, "block"]
    dealt = dealt.select(*place, "home", "rep", "m", "v").repartition(*place).sortWithinPartitions(*place, F.desc("home"))
    found = ws.table(dealt.mapInArrow(_joining(cosine), "is_link boolean, a bigint, b bigint"))

    counts = found.where("not is_link").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("found"))
    linked_classes = components(found.where("is_link").select("a", "b"), ws).withColumnRenamed("vertex", "rep")
    named = classes.select("rep", "h1", "h2", "m", "least").join(counts, "rep", "left").join(linked_classes, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("h1", "h2", (F.col("m") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), "component_id")
    out = keys.join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
