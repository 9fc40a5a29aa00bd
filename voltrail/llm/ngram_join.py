"""N-gram Jaccard join over count vectors.

A document's set of k-word shingles becomes a point of counts: each shingle is
hashed to a group, and coordinate i counts the shingles of group i. The number
of common shingles of two documents is at most the sum over i of the smaller
coordinate, so pairs whose bound is too low need no further look.

The index is an R-tree whose nodes may overlap. In the full space of shingles a
point has few coordinates, and two sets of similarity >= t share one of the first
n - ceil(t n) + 1 coordinates of either, in any order that holds for all. So a
point lies under the node of each of those coordinates, rarest groups first (their
counts over the whole corpus order them), and linked points always share a node.
A node's members are cut where their sizes leave too wide a gap; nodes of equal
members are one. Below that, the members are packed by component and size into
boxes of `BOX` points, each with its coordinates' maxima; a search descends into a
box only while the sum of the smaller of query and maximum reaches the overlap
that its sizes need, and into a point likewise. (Boxes of points without anything
in common prune nothing at the top, in so many dimensions, whence the first level.)

Groups of near copies are never searched pair by pair: members of a node pair with
one leader of their size class, pairs are bounded, verified on the exact shingle
sets and linked documents contracted. Only nodes that still hold documents of
different components are searched, by those outside the node's largest component.
There a pair must also pass a bound on the multisets of 16-bit hashes of all shingles,
which is nearly exact, so that documents which only look alike make no pairs. Documents
that look alike lie in many nodes together, so small nodes with the same member of the least
hash are searched as a group, which holds each document's point and hashes once. First a
group gives pairs that would connect its components as a forest, at most as many as it has
members; groups in which one of them is no link then give all pairs of different components.
Documents with equal sets are contracted before, wherever they lie.

Null or empty texts (and texts without words) have no shingles and link with
nothing; texts of fewer than k words are one shingle. Repeated rows of one id
count as one document (of different texts under one id, the class is that of the
text whose equal documents hold the least id); a null id links with nothing. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.components import components
from voltrail.llm.streams import starts, whole_runs
from voltrail.llm.text import CHUNK_BYTES, NON_SPACE, Words, U, chunks, mix, rolling, sequence_hash
from voltrail.llm.workspace import Workspace

K, PERCENT = 4, 85
GROUPS = 128  # coordinates of the point that is carried for the bound
FULL = 65_535
RARITY = 1 << 16  # groups whose counts over the corpus order a set's coordinates
BLOCK = 1 << 10  # of them in a row
BOX = 32  # points of a box
NODE = 4_096  # members of a node, or of small nodes together, that are one part; larger ones are dealt into parts
SMALL = 512  # members of a node that is searched together with others
HOT = 200_000  # members of a node that one task compares for equal nodes; larger ones stay as they are
BROADCAST_DOCS = 50_000  # rows of about 40 bytes
SALT = 2_000  # pairs of one hub that one group verifies


def shingle_sets(texts: pa.Array, k: int, word_bytes: np.ndarray = NON_SPACE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, word_bytes, lower=True)
    g = rolling(w.hash, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            x = g[a : b - k + 1].copy()
            x.sort()
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        elif b > a:
            out.append(np.array([sequence_hash(w.hash[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def first_coordinates(s: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The coordinates under which a set lies: its n - ceil(percent n / 100) + 1 first, rarest groups first."""
    n = len(s)
    if not n:
        return s
    p = n + (-percent * n // 100) + 1
    rare = rarity[(s >> U(20)).astype(np.int64) & (RARITY - 1)]
    at = np.argpartition(rare, p - 1)[:p] if p < n else np.arange(n)
    edge = rare[at].max()
    sure, even = np.flatnonzero(rare < edge), np.flatnonzero(rare == edge)  # of even ones the least hashes: s is sorted
    return s[np.concatenate([sure, even[: p - len(sure)]])]


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s ^ U(0x1F83D9AB)).sum().astype(np.int64)), int(mix(s + U(0x5BE0CD19)).sum().astype(np.int64))


def counts_of(s: np.ndarray) -> np.ndarray:
    """The set's point: how many shingles each group holds; FULL stands for all beyond."""
    return np.minimum(np.bincount((s >> U(10)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS), FULL).astype(np.uint16)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most shingles that sets with these points can share: the sum of the smaller coordinates."""
    least = np.minimum(x, y)
    return np.where((least == FULL).any(-1), np.iinfo(np.int64).max, least.sum(-1, dtype=np.int64))


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes that links them: 100 i >= percent (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _digesting(k: int) -> Task:
    """A row for each document, and the task's counts of groups in rows of BLOCK (block, point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(RARITY, np.int64)
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                sets = shingle_sets(b.column(1)[lo:hi], k)
                d = [_set_digest(s) for s in sets]
                if sets:
                    count += np.bincount((np.concatenate(sets) >> U(20)).astype(np.int64) & (RARITY - 1), minlength=RARITY)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in d], pa.int64()) for i in (0, 1)), pa.array([counts_of(s).tobytes() for s in sets], pa.binary()), pa.nulls(hi - lo, pa.int32())],
                    names=["doc_id", "n", "sid", "d2", "point", "block"],
                )
        rows = RARITY // BLOCK
        none = pa.nulls(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array([x.tobytes() for x in count.reshape(rows, BLOCK)], pa.binary()), pa.array(np.arange(rows, dtype=np.int32))], names=["doc_id", "n", "sid", "d2", "point", "block"])

    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "point"])


def _rarity(counts: DataFrame) -> np.ndarray:
    """How often each group occurs in the corpus: RARITY numbers, whatever its size."""
    rows = counts.repartition(RARITY // BLOCK // 4, "block").mapInArrow(_summing, "block int, point binary").collect()
    out = np.zeros((RARITY // BLOCK, BLOCK), np.float32)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["point"], np.int64)
    return out.reshape(-1)


def _keying(k: int, percent: int, rarity: np.ndarray) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # equal sets are one point: one of them a task is enough
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                keys, sizes, sids = [], [], []
                for i, s in zip(b.column(0)[lo:hi].to_pylist(), shingle_sets(b.column(1)[lo:hi], k)):
                    if i is None or not len(s) or (d := _set_digest(s)) in seen:
                        continue
                    if len(seen) < 100_000:
                        seen.add(d)
                    sids.append(d[0])
                    sizes.append(len(s))
                    keys.append(first_coordinates(s, rarity, percent).view(np.int64))
                size = np.array([len(x) for x in keys], np.int64)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(sizes, np.int64), size)), pa.array(np.repeat(np.array(sids, np.int64), size))], names=["key", "n", "sid"])

    return run


def _nodes(percent: int, hot: int) -> Task:
    """The nodes' members, from rows in order of (key, n, sid): runs of one key without a gap too wide in sizes.

    A node is named by its members, so that equal nodes fall together; one of over `hot` rows by its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for t, long in whole_runs(batches, limit=hot, at_least=min(20_000, hot)):
            key, n, sid = (t.column(c).to_numpy() for c in ("key", "n", "sid"))
            if long:
                node = mix(key.view(np.uint64) + U(0x3C6EF372)).view(np.int64)
            else:
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (sid[1:] != sid[:-1])
                key, n, sid = key[new], n[new], sid[new]
                cut = np.ones(len(key), bool)
                cut[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])
                at = np.flatnonzero(cut)
                size = np.diff(np.append(at, len(key)))
                name = mix(np.add.reduceat(mix(sid.view(np.uint64) ^ mix(n.astype(np.uint64))), at) + size.astype(np.uint64)).view(np.int64) if len(at) else at
                pick = size > 1
                pick[pick] = [len(seen) >= 1_000_000 or not (x in seen or seen.add(x)) for x in name[pick].tolist()]
                rows = np.repeat(pick, size)
                node, n, sid = np.repeat(name[pick], size[pick]), n[rows], sid[rows]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(sid)], names=["node", "n", "sid"])

    return run


def _bounding(percent: int) -> Task:
    """Which pairs the bound on their overlap allows to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, GROUPS) for c in ("pa", "pb"))
            need = needed(na, nb, percent)
            ok = pa.array((np.minimum(na, nb) >= need) & (overlap_bound(x, y) >= need))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b", "nodes")], names=["a", "b", "nodes"])

    return run


def _compressing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 3)
    for b in batches:
        packed = [None if t is None else codec.compress(t.as_buffer(), asbytes=True) for t in b.column(1)]
        size = [0 if t is None else t.as_buffer().size for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "size", "packed"])


def _verifying(k: int, percent: int) -> Task:
    """Whether each document links with its hub; rows come in order of (hub, salt), the hub's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        held: tuple[int, np.ndarray] | None = None
        for b in batches:
            hub, doc = b.column("hub").to_numpy(), b.column("doc_id").to_numpy()
            size = b.column("size").to_numpy()
            end = np.cumsum(size)
            lo = 0
            ok = np.zeros(len(doc), bool)
            while lo < len(doc):
                hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + CHUNK_BYTES, side="right")))
                texts = pa.array([codec.decompress(b.column("packed")[i].as_buffer(), int(size[i]), asbytes=True) for i in range(lo, hi)], pa.large_binary())
                for i, s in zip(range(lo, hi), shingle_sets(texts.view(pa.large_string()), k)):
                    if held is None or held[0] != hub[i]:
                        held = int(hub[i]), s
                    x = held[1]
                    need = int(needed(len(x), len(s), percent))
                    if min(len(x), len(s)) >= need:
                        both = np.concatenate([x, s])
                        both.sort()
                        ok[i] = np.count_nonzero(both[1:] == both[:-1]) >= need
                lo = hi
            other = hub != doc
            yield pa.RecordBatch.from_arrays([pa.array(hub[other]), pa.array(doc[other]), pa.array(ok[other])], names=["a", "b", "linked"])

    return run


def pack(values: np.ndarray) -> bytes:
    """Sorted 16-bit values as their differences, low bytes first, then high ones, which are mostly zero; compressed after the size in bytes."""
    planes = np.diff(values, prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2).T.tobytes()
    return len(planes).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True) if planes else b""


def unpack(packed: bytes | None) -> bytes | None:
    """The bytes of the values that were packed."""
    if not packed:
        return packed
    planes = pa.Codec("zstd").decompress(packed[4:], int.from_bytes(packed[:4], "little"), asbytes=True)
    return np.cumsum(np.frombuffer(planes, np.uint8).reshape(2, -1).T.copy().view(np.uint16).ravel(), dtype=np.uint16).tobytes()


def _hashing(k: int) -> Task:
    """The sorted 16-bit hashes of each document's shingles, equal ones repeated, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                packed = [pack(np.sort((s >> U(36)).astype(np.uint16))) for s in shingle_sets(b.column(1)[lo:hi], k)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(packed, pa.binary())], names=["rep", "hashes"])

    return run


class Hashes:
    """Multisets of 16-bit hashes of a node's residents, for a bound on overlaps; a missing one bounds nothing."""

    def __init__(self, packed: list[bytes | None]):
        self.value = np.frombuffer(b"".join(x or b"" for x in packed), np.uint16)
        self.end = np.cumsum([len(x or b"") // 2 for x in packed])
        self.size = np.diff(self.end, prepend=0)
        self.known = np.array([x is not None for x in packed], bool)
        at = np.arange(len(self.value)) - np.repeat(self.end - self.size, self.size)  # the how-manieth of its value: places are sorted by value
        new = np.ones(len(at), bool)
        new[1:] = (self.value[1:] != self.value[:-1]) | (at[1:] == 0)
        first = np.flatnonzero(new)
        self.turn = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))

    def overlap(self, query: bytes | None, i: np.ndarray) -> np.ndarray:
        """At least the overlap of the query with each of the residents `i`."""
        out = np.full(len(i), np.iinfo(np.int64).max)
        if query is None:
            return out
        held = np.bincount(np.frombuffer(query, np.uint16), minlength=1 << 16)
        for lo in range(0, len(i), 256):
            part = i[lo : lo + 256]
            size = self.size[part]
            end = np.cumsum(size)
            at = np.repeat(self.end[part] - end, size) + np.arange(end[-1])
            both = np.concatenate([[0], np.cumsum(self.turn[at] < held[self.value[at]])])
            out[lo : lo + 256] = np.where(self.known[part], both[end] - both[end - size], out[lo : lo + 256])
        return out


class Boxes:
    """The lowest levels of the tree: points packed by component and size into boxes with their coordinates' maxima."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, point: np.ndarray, percent: int):
        self.order = np.lexsort((n, comp))
        self.n, self.comp, self.point, self.percent = n[self.order], comp[self.order], point[self.order], percent
        self.at = np.arange(0, len(n), BOX)
        self.most = np.maximum.reduceat(self.point, self.at)
        self.least_n, self.most_n = np.minimum.reduceat(self.n, self.at), np.maximum.reduceat(self.n, self.at)

    def search(self, n: int, comp: int, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order given of the points of other components that may link, and by how much their bound exceeds the need."""
        need = needed(n, self.least_n, self.percent)
        boxes = np.flatnonzero((100 * n >= self.percent * self.least_n) & (100 * self.most_n >= self.percent * n) & (overlap_bound(point, self.most) >= need))
        i = (self.at[boxes][:, None] + np.arange(BOX)).ravel()
        i = i[i < len(self.n)]
        i = i[self.comp[i] != comp]
        need = needed(n, self.n[i], self.percent)
        over = overlap_bound(point, self.point[i]) - need
        ok = (over >= 0) & (np.minimum(n, self.n[i]) >= need)
        return self.order[i[ok]], over[ok]


def _searching(percent: int, every: bool) -> Task:
    """Pairs of the nodes of a group that lie in different components and whose bounds allow a link: all, or each query's
    best of each component that the group's pairs have not connected yet. Those of a group that held pairs back name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(batches, n_keys=2, at_least=2_000):
            group, part, rep, comp, n, resident = (t.column(c).to_numpy() for c in ("group", "part", "rep", "component", "n", "resident"))
            point = np.frombuffer(b"".join(t.column("point").to_pylist()), np.uint16).reshape(len(rep), GROUPS)
            at = starts(group, part)
            out = []
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(rep)]):
                i = np.arange(lo, hi)
                lists = [t.column(c).slice(lo, hi - lo).combine_chunks() for c in ("nodes", "queries")]
                packed = [unpack(x) for x in t.column("hashes").slice(lo, hi - lo).to_pylist()]
                of_row = np.repeat(np.arange(hi - lo), lists[0].value_lengths().to_numpy())
                node, query = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
                pairs, held_back = _pairs_of_group(rep[i], comp[i], n[i], resident[i], point[i], packed, of_row, node, query, percent, every)
                out.append((pairs, group[lo] if held_back else None, part[lo]))
            a, b = (np.concatenate([x[k] for x, _, _ in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            named = [[g] * len(x[0]) for x, g, _ in out]
            parts = [[p] * len(x[0]) for x, _, p in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([g for x in named for g in x], pa.int64()), pa.array([p for x in parts for p in x], pa.int32())], names=["a", "b", "group", "part"])

    return run


def _pairs_of_group(rep: np.ndarray, comp: np.ndarray, n: np.ndarray, resident: np.ndarray, point: np.ndarray, packed: list[bytes | None], of_row: np.ndarray, node: np.ndarray, query: np.ndarray, percent: int, every: bool) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
    """The pairs, and whether some were held back, as others connect their components. `of_row`, `node` and `query`: who lies in which node."""
    by_node = np.argsort(node, kind="stable")
    of_row, node, query = of_row[by_node], node[by_node], query[by_node]
    at = starts(node)
    hashes = Hashes(packed)
    met = np.zeros((len(rep), len(rep)), bool) if len(at) > 1 else None  # pairs that need no second look in another node
    root = np.unique(comp, return_inverse=True)[1]  # the components as this group's pairs connect them
    a, b, held_back = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(node)]):
        own = of_row[lo:hi][resident[of_row[lo:hi]]]
        if not len(own):
            continue
        tree = Boxes(n[own], comp[own], point[own], percent)
        for q in of_row[lo:hi][query[lo:hi]].tolist():
            j = own[tree.search(n[q], comp[q], point[q])[0]]
            if met is not None:
                j = j[~met[q, j]]
            if not every:
                apart = root[j] != root[q]
                held_back |= not apart.all()
                j = j[apart]
            over = hashes.overlap(packed[q], j) - needed(n[q], n[j], percent)
            if met is not None:
                far = j[over < 0]
                met[q, far] = met[far, q] = True
            j, over = j[over >= 0], over[over >= 0]
            if len(j) and not every:
                theirs = root[j]
                order = np.lexsort((-over, theirs))
                best = order[starts(theirs[order])]
                held_back |= len(best) < len(j)
                j = j[best]
                root[np.isin(root, theirs)] = root[q]
            if met is not None:
                met[q, j] = met[j, q] = True
            a.append(np.full(len(j), rep[q]))
            b.append(rep[j])
    return (np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)), bool(held_back)


def _dealt(left: DataFrame) -> DataFrame:
    """Members of nodes (node, rep, component, n, query, and pivot, size and held of the node) as a row for each group, part and document, with its nodes there.

    Small nodes of one pivot, which mostly hold the same documents, are a group, cut into parts where its nodes have
    too many members together; a larger node is a group by itself, and each part holds some of it as residents.
    """
    alone = F.col("size") > min(SMALL, NODE)
    parts = F.when(alone, F.ceil(F.col("size") / NODE)).otherwise(F.ceil(F.col("held") / NODE)).cast("int")
    mine = F.pmod(F.xxhash64(F.when(alone, F.col("rep")).otherwise(F.col("node"))), parts).cast("int")
    left = left.withColumns({"group": F.when(alone, F.col("node")).otherwise(F.col("pivot")), "parts": parts, "mine": mine})
    left = left.withColumn("part", F.explode(F.when(alone & F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))))
    left = left.withColumn("resident", F.col("part") == F.col("mine"))
    rows = left.groupBy("group", "part", "rep", "component", "n", "resident").agg(F.collect_list(F.struct("node", "query")).alias("at"))
    return rows.select("group", "part", "rep", "component", "n", "resident", F.col("at.node").alias("nodes"), F.col("at.query").alias("queries"))


def _verified(rows: DataFrame, pairs: DataFrame, ws: Workspace, k: int, percent: int) -> DataFrame:
    """a, b, linked of pairs, on their exact sets. Each pair moves one text, to its hub a; a hub of many pairs is salted.

    The texts wanted are picked by a broadcast of their ids where those are few, counted before, else by a join.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    hubs = salts.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), F.sequence(F.lit(0), F.col("salts") - 1).alias("salt"))
    members = pairs.join(salts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), F.array(F.pmod(F.xxhash64("b"), "salts").cast("int")).alias("salt"))
    texts = rows.where("doc_id is not null and text is not null")
    wanted = ws.table(hubs.unionByName(members))
    few = wanted.count() <= BROADCAST_DOCS
    if few:
        texts = texts.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id")
    texts = texts.mapInArrow(_compressing, "doc_id bigint, size bigint, packed binary")
    both = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select("hub", F.explode("salt").alias("salt"), "doc_id", "size", "packed")
    dealt = both.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc_id") != F.col("hub"))
    return dealt.mapInArrow(_verifying(k, percent), "a bigint, b bigint, linked boolean")


def _size_class(percent: int) -> F.Column:
    """Classes in which all sizes fit one another."""
    return F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) * 1.0001).cast("int")


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a set is known by its size and sid; its second digest only confirms that
    read = ws.table(rows.mapInArrow(_digesting(k), "doc_id bigint, n bigint, sid bigint, d2 bigint, point binary, block int"))
    sets = read.where("block is null").drop("block")
    rarity = _rarity(read.where("block is not null").select("block", "point"))
    own = sets.where("n > 0 and doc_id is not null")
    reps = ws.table(own.groupBy("n", "sid", "d2").agg(F.min("doc_id").alias("rep")))

    keyed = rows.mapInArrow(_keying(k, percent, rarity), "key bigint, n bigint, sid bigint")
    members = keyed.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(_nodes(percent, HOT), "node bigint, n bigint, sid bigint")
    nodes = ws.table(members.distinct().join(reps.select("n", "sid", "rep"), ["n", "sid"]).select("node", "n", "sid", "rep"))
    inside = nodes.select("n", "sid", "rep").distinct()
    points = own.select("n", "sid", F.col("doc_id").alias("rep"), "point").join(inside, ["n", "sid", "rep"], "left_semi")
    points = ws.table(points.dropDuplicates(["rep"]).select("rep", "n", "point"))

    def bounded(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(points.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}")), x)
        return pairs.select("a", "b", "nodes", "na", "nb", "pa", "pb").mapInArrow(_bounding(percent), "a bigint, b bigint, nodes bigint")

    def hashes_of(wanted: DataFrame) -> DataFrame:
        """rep, hashes of the documents wanted; null for an id of different texts."""
        texts = rows.where("doc_id is not null and text is not null")
        if wanted.count() <= BROADCAST_DOCS:
            texts = texts.join(F.broadcast(wanted.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
        digest = F.xxhash64("hashes")  # the hashes themselves move once
        all_of = texts.mapInArrow(_hashing(k), "rep bigint, hashes binary").groupBy("rep").agg(F.min("hashes").alias("hashes"), F.min(digest).alias("_low"), F.max(digest).alias("_high"))
        return all_of.select("rep", F.when(F.col("_low") == F.col("_high"), F.col("hashes")).alias("hashes"))

    def located(pairs: DataFrame) -> DataFrame:
        """Pairs a, b with their components ca, cb, where those differ."""
        for x in "ab":
            pairs = pairs.join(comp.select(F.col("vertex").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
        return pairs.where("ca <> cb")

    def attempt(pairs: DataFrame) -> bool:
        """Verifies pairs that were not tried yet; False if there are none."""
        nonlocal tried, comp
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = ws.table(pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return False
        got = ws.table(_verified(rows, fresh, ws, k, percent))
        tried = got if tried is None else tried.unionByName(got)
        comp = components(tried.where("linked"), ws)
        return True

    tried = None
    comp = reps.select(F.col("rep").alias("vertex"), F.col("rep").alias("component")).limit(0)
    # each member with the leader of its size class in most nodes, then with the best of each other component
    classes = nodes.withColumn("size", _size_class(percent))
    leaders = classes.groupBy("node", "size").agg(F.min("rep").alias("a"))
    star = classes.join(leaders, ["node", "size"]).groupBy("a", F.col("rep").alias("b")).agg(F.count("*").alias("nodes")).where("a <> b")
    star = ws.table(bounded(star))
    best = lambda pairs, *by: pairs.groupBy("b", *by).agg(F.max_by("a", F.struct("nodes", -F.col("a"))).alias("a"))
    if attempt(best(star)):
        attempt(best(located(star), "ca"))

    for every in (False, True):
        # nodes with documents of different components are searched by those outside the largest
        here = nodes.join(comp.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = here.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.min(F.xxhash64("rep")).alias("pivot")).where("low < high")
        of_pivot = mixed.where(F.col("size") <= min(SMALL, NODE)).groupBy("pivot").agg(F.sum("size").alias("held"))
        mixed = mixed.join(of_pivot, "pivot", "left").select("node", "size", "pivot", "held")
        left = ws.table(here.join(mixed, "node"))
        if left.isEmpty():
            break
        of_component = left.groupBy("node", "component").agg(F.count("*").alias("members"))
        largest = of_component.groupBy("node").agg(F.max_by("component", "members").alias("largest"))
        dealt = ws.table(_dealt(left.join(largest, "node").withColumn("query", F.col("component") != F.col("largest"))))
        full = dealt.join(points.select("rep", "point"), "rep").join(hashes_of(dealt.select("rep").distinct()), "rep", "left")
        found = full.repartition("group", "part").sortWithinPartitions("group", "part", "rep").mapInArrow(_searching(percent, every), "a bigint, b bigint, group bigint, part int")
        if every:
            attempt(found)
            break
        found = ws.table(found)
        attempt(found)
        # pairs that were held back are in one component if all pairs of their group are linked; else the group's nodes are searched again
        failed = found.where("group is not null").join(tried.where("not linked"), ["a", "b"]).select("group", "part").distinct() if tried is not None else found.limit(0)
        again = ws.table(dealt.join(failed.select("group", "part"), ["group", "part"], "left_semi").select(F.explode("nodes").alias("node")).distinct())
        if again.isEmpty():
            break
        nodes = nodes.join(again, "node", "left_semi")

    own_rep = own.select("doc_id", "n", "sid", "d2").join(reps, ["n", "sid", "d2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = sets.select("doc_id", "n").join(own_rep, "doc_id", "left").join(comp.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
