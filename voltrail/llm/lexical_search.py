"""Ranked lexical search: a hierarchical max tree over document ranges for each term.

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A first
pass over the texts keeps, for each document, the items' terms it holds and how often, its
number of terms, and sums what ranking needs: documents with terms, all their terms, and
each term's documents. The counts of a partition are one row, so the sums are small.

A second pass takes the documents in ranges. For each of the items' terms a range has a
tree: the term's impact in every document, and above them the largest impact of each
run of `FAN` children, level by level to the root. An item's bound at a node is the sum
of its terms' weights times the node's maxima, so no document below can score more. The
search is best first: it opens the node of the highest bound, and ends when no bound
reaches the `k`-th score so far. Nodes whose bound equals that score are opened too,
since equal scores are ranked by id. The k best of a task go on from range to range and
bound the next trees; the tasks' best are then ranked together.

Scores are 64-bit integers; only the weights' logarithm is taken in doubles. A word is
found by its hash and compared by its bytes, so other words can't stand for a term.

Items are read in blocks of at most `block_terms` different terms, which bounds what is
broadcast; one longer item is a block of its own. Each row of the items is an item,
also where ids repeat or are null; equal rows give equal lists. Null, empty and wordless
items have no result, nor have null, empty and wordless documents, which don't count.
Documents of equal score are ranked by id, null ids last; repeated documents are ranked
each. A document of any length is one entry of its range. Empty tables give no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrail.llm.text import ALNUM, HashSet, Words, chunks
from voltrail.llm.workspace import Workspace, column

K, FAN = 50, 16
#: Documents of a range, and their entries (a term in a document), at most; a longer document is a range of its own.
RANGE_DOCS, RANGE_ENTRIES = 16_384, 2_000_000
BLOCK_TERMS = 20_000
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_FOUND = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>, docs bigint"
_BEST = "item int, doc_id bigint, score bigint"


class Terms:
    """The different terms of a block of items, found by hash and compared by bytes."""

    def __init__(self, texts: list[str]):
        w = Words(pa.array(texts, pa.large_string()), ALNUM, lower=True)
        raw = w.bytes.tobytes().translate(_LOWER)
        number: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []
        for k in range(len(texts)):
            words = [raw[w.start[j] : w.end[j]] for j in range(int(w.first[k]), int(w.first[k + 1]))]
            self.items.append(np.array(sorted({number.setdefault(x, len(number)) for x in words}), np.int64))
        self.words = list(number)
        told = Words(pa.array([x.decode() for x in self.words], pa.large_string()), ALNUM, lower=True)
        self.known = HashSet(told.hash)
        if len(self.known.values) < len(self.words):
            raise ValueError("two terms of one hash")
        self.of_hash = np.argsort(told.hash)
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of words that are terms, and their terms."""
        at, k = self.known.find(w.hash)
        term = self.of_hash[k]
        same = self.size[term] == w.end[at] - w.start[at]
        at, term = at[same], term[same]
        n = self.size[term]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        here, there = w.bytes[np.repeat(w.start[at], n) + step], self.bytes[np.repeat(self.at[term], n) + step]
        here = np.where((here >= 0x41) & (here <= 0x5A), here + 0x20, here)
        wrong = np.unique(np.repeat(np.arange(len(at)), n)[here != there])
        return np.delete(at, wrong), np.delete(term, wrong)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _finding(sent: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with their terms; at the end one row of the partition's sums, which alone has `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = sent.value
        holders = np.zeros(len(terms.words), np.int64)
        docs = words = 0
        names = ["doc_id", "n", "terms", "counts", "docs"]
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                w = Words(b.column(1)[lo:hi], ALNUM, lower=True)
                n = w.counts()
                docs, words = docs + int((n > 0).sum()), words + int(n.sum())
                at, term = terms.find(w)
                key, count = np.unique(w.doc_of(at) * len(terms.words) + term, return_counts=True)
                doc, term = key // max(1, len(terms.words)), key % max(1, len(terms.words))
                holders += np.bincount(term, minlength=len(holders))
                held = np.unique(doc)
                offsets = np.append(np.searchsorted(doc, held), len(doc))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi].take(pa.array(held)), pa.array(n[held], pa.int64()), _lists(term, offsets, pa.int32()), _lists(count, offsets, pa.int64()), pa.nulls(len(held), pa.int64())], names=names
                )
        some = np.flatnonzero(holders)
        one = np.array([0, len(some)])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([words], pa.int64()), _lists(some, one, pa.int32()), _lists(holders[some], one, pa.int64()), pa.array([docs], pa.int64())], names=names)

    return run


class Tree:
    """A range of documents: each term's impacts, and their maxima in runs of children up to the root."""

    def __init__(self, doc_id: np.ndarray, no_id: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int, fan: int):
        self.doc_id, self.no_id, self.first, self.term, self.impact, self.fan = doc_id, no_id, first, term, impact, fan
        self.levels: list[np.ndarray] = []  # of terms by nodes, lowest first
        nodes = -(-len(doc_id) // fan)
        low = np.zeros((n_terms, nodes), np.int32)
        np.maximum.at(low.reshape(-1), term * nodes + np.repeat(np.arange(len(doc_id)), np.diff(first)) // fan, impact.astype(np.int32))
        self.levels.append(low)
        while (nodes := self.levels[-1].shape[1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, nodes, fan), axis=1))

    def bounds(self, level: int, lo: int, hi: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return weights @ self.levels[level][terms, lo:hi].astype(np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, k: int, best: list[tuple[int, int, int]]) -> None:
        """Puts documents into `best`, a heap of (score, -has no id, -id), the worst of at most `k` first. dense: weights of all terms."""
        top = len(self.levels) - 1
        heap = [(-int(x), top, i) for i, x in enumerate(self.bounds(top, 0, self.levels[top].shape[1], terms, weights)) if x > 0]
        heapq.heapify(heap)
        while heap:
            bound, level, node = heapq.heappop(heap)
            if len(best) == k and -bound < best[0][0]:
                return
            lo = node * self.fan
            if level:
                hi = min(lo + self.fan, self.levels[level - 1].shape[1])
                least = best[0][0] if len(best) == k else 1
                children = self.bounds(level - 1, lo, hi, terms, weights)
                for i in np.flatnonzero(children >= max(1, least)).tolist():
                    heapq.heappush(heap, (-int(children[i]), level - 1, lo + i))
                continue
            hi = min(lo + self.fan, len(self.doc_id))
            a, z = self.first[lo], self.first[hi]
            score = np.add.reduceat(dense[self.term[a:z]] * self.impact[a:z], self.first[lo:hi] - a)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(score >= max(1, least)).tolist():
                entry = int(score[i]), -int(self.no_id[lo + i]), -int(self.doc_id[lo + i])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents in ranges of bounded size."""
    held: list[pa.RecordBatch] = []
    docs = entries = 0
    for b in batches:
        offsets = b.column("terms").offsets.to_numpy()
        lo = 0
        while lo < b.num_rows:
            room = int(np.searchsorted(offsets, offsets[lo] + RANGE_ENTRIES - entries, side="right")) - 1
            hi = min(b.num_rows, lo + RANGE_DOCS - docs, room)
            if hi <= lo and not docs:
                hi = lo + 1
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
                docs, entries = docs + hi - lo, entries + int(offsets[hi] - offsets[lo])
            if hi < b.num_rows:
                yield pa.Table.from_batches(held)
                held, docs, entries = [], 0, 0
            lo = max(lo, hi)
    if held:
        yield pa.Table.from_batches(held)


def _searching(sent: object, k: int, fan: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, total_docs, total_words = sent.value
        best: list[list] = [[] for _ in items]
        dense = np.zeros(len(weights), np.int64)
        for t in _ranges(batches):
            terms, counts = (t.column(c).combine_chunks() for c in ("terms", "counts"))
            first = terms.offsets.to_numpy().astype(np.int64)
            term, tf = (x.values.to_numpy()[first[0] : first[-1]].astype(np.int64) for x in (terms, counts))
            first = first - first[0]
            m = 50 + 50 * t.column("n").to_numpy() * total_docs // total_words
            impact = 1_000_000_000 * tf // (1_000 * tf + 20 * np.repeat(m, np.diff(first)))
            ids = t.column("doc_id").combine_chunks()
            tree = Tree(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), first, term, impact, len(weights), fan)
            for own, heap in zip(items, best):
                dense[own] = weights[own]
                tree.best(own, weights[own], dense, k, heap)
                dense[own] = 0
        rows = [(i, None if x[1] else -x[2], x[0]) for i, heap in enumerate(best) for x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items with text, in blocks of at most `limit` words (or one item), read a partition at a time."""
    block, held = [], 0
    for item, text in items.select(column(item_col).cast("string"), column(text_col)).where(column(text_col).isNotNull()).toLocalIterator():
        size = int(Words(pa.array([text], pa.large_string()), ALNUM, lower=True).counts()[0])
        if block and held + size > limit:
            yield block
            block, held = [], 0
        if size:
            block.append((item, text))
            held += size
    if block:
        yield block


def _weights(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Each term's weight, the documents with terms, all their terms."""
    sums = found.where("docs is not null")
    docs, words = sums.agg(F.sum("docs"), F.sum("n")).first()
    holders = np.zeros(n_terms, np.int64)
    per = sums.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    for term, n in per.collect():
        holders[term] = n
    docs = docs or 0
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in holders.tolist()], np.int64), docs, words or 0


def _ranked(docs: DataFrame, block: list[tuple[str | None, str]], ws: Workspace, k: int, fan: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    terms = Terms([t for _, t in block])
    sent = sc.broadcast(terms)
    found = ws.table(docs.mapInArrow(_finding(sent), _FOUND))
    sent.destroy()
    weights, n_docs, n_words = _weights(found, len(terms.words))
    sent = sc.broadcast((terms.items, weights, n_docs, n_words))
    best = ws.table(found.where("docs is null").select("doc_id", "n", "terms", "counts").mapInArrow(_searching(sent, k, fan), _BEST))
    sent.destroy()
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    named = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id string")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, fan: int = FAN, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the `k` highest-scoring documents of each item, of scores above 0."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    ws = Workspace(docs.sparkSession)
    parts = [_ranked(rows, block, ws, k, fan) for block in _blocks(items, item_col, "text", block_terms)]
    kind = items.select(column(item_col)).dtypes[0][1]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts).withColumn("item_id", F.col("item_id").cast(kind))
