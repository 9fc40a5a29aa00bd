"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Benchmark items are cut to windows of `n` consecutive words (an item of fewer
words is one window). Training texts are read as batches of word hashes; every
window hash of theirs is looked up in the set, and each hit's words are compared
with the window's own words, so that a hash collision can't mark a word.

The set is broadcast in blocks of at most `block_windows` words (and WORD_BYTES times
that of text), a bound on its bytes whatever the benchmark's size; longer items are
cut, each window whole in a piece. With several blocks the documents are written once
with a number for each row, and scanned once a block, one block after the other; hit
spans are merged by these numbers, so every row stays a row whatever its id.

Nulls and empty texts have no words: null or empty documents are clean, null or
empty items have no windows. An item of null id marks words, but is not among
`items`; repeated item ids count once there. Repeated documents, and those of
null id, are scanned each. Empty tables give empty or clean results; extra columns
are kept by `remove`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import ALNUM, HashSet, Words, chunks, fits, rolling
from voltrail.llm.workspace import Workspace, column, free_name

N = 10
BLOCK_WINDOWS = 1_000_000
WORD_BYTES = 32
PIECE = 200_000  # words or windows whose bytes are handled at once
SCANNED = "doc_id bigint, n_words bigint, spans array<struct<a:int,b:int>>, items array<string>"
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_LOWER_BYTES = np.frombuffer(bytes(range(256)).translate(_LOWER), np.uint8)


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a and from b are equal, for each of some places."""
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wrong = raw[np.repeat(a, n) + step] != raw[np.repeat(b, n) + step]
    return np.bincount(np.repeat(np.arange(len(n)), n)[wrong], minlength=len(n)) == 0


class _OfSize:
    """Windows of one number of words, as arrays: different hashes, and of each its different texts (one, but for
    collisions) as places in the block's text, and of each text its items."""

    def __init__(self, raw: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, begin - end, hashes))
        h, a, z, item = hashes[order], begin[order], end[order], item[order]
        # a text is new if the hash or the length is, or its bytes differ from those of the one before
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (z[1:] - a[1:] != z[:-1] - a[:-1])
        like = np.flatnonzero(~new)
        for lo in range(0, len(like), PIECE):
            at = like[lo : lo + PIECE]
            new[at] = ~_same_bytes(raw, a[at], a[at - 1], z[at] - a[at])
        text = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        own = np.ones(len(h), bool)
        own[1:] = new[1:] | (item[1:] != item[:-1])
        self.begin, self.end = a[first], z[first]
        self.items = item[own]
        self.items_at = np.append(np.searchsorted(text[own], np.arange(len(first))), int(own.sum())).astype(np.int64)
        self.known = HashSet(h)
        self.texts_at = np.append(np.searchsorted(h[first], self.known.values), len(first))


class Windows:
    """The windows of benchmark items: hashes, and places in one text of all items' words joined by blanks."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.n = n
        self.ids = [i for i, _ in items]
        w = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
        size = w.end - w.start
        at = np.cumsum(size + 1) - (size + 1)
        raw = np.full(int((size + 1).sum()), 0x20, np.uint8)
        for lo in range(0, len(size), PIECE):
            s, k = slice(lo, lo + PIECE), size[lo : lo + PIECE]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            raw[np.repeat(at[s], k) + step] = _LOWER_BYTES[w.bytes[np.repeat(w.start[s], k) + step]]
        self.text = raw.tobytes()
        counts = w.counts()
        self.sizes: dict[int, _OfSize] = {}
        for k in sorted({min(n, c) for c in counts.tolist() if c}):
            starts = np.flatnonzero(fits(w.first, len(w.hash), k)) if k == n else w.first[:-1][counts == k]
            self.sizes[k] = _OfSize(raw, rolling(w.hash, k)[starts], at[starts], at[starts + k - 1] + size[starts + k - 1], w.doc_of(starts))

    def scan(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(word index, length, items) of each verified occurrence."""
        raw, told = None, {}
        for size, of in self.sizes.items():
            at, which = of.known.find(rolling(w.hash, size))
            ok = fits(w.first, len(w.hash), size)[at]
            for i, k in zip(at[ok].tolist(), which[ok].tolist()):
                if raw is None:
                    raw = w.bytes.tobytes().translate(_LOWER)
                here = b" ".join(raw[w.start[j] : w.end[j]] for j in range(i, i + size))
                for t in range(of.texts_at[k], of.texts_at[k + 1]):
                    if self.text[of.begin[t] : of.end[t]] == here:
                        if (size, t) not in told:
                            told[size, t] = [self.ids[j] for j in of.items[of.items_at[t] : of.items_at[t + 1]].tolist() if self.ids[j] is not None]
                        yield i, size, told[size, t]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scanning(windows: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Windows = windows.value
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                w = Words(b.column(1)[lo:hi], ALNUM, lower=True)
                spans: list[list] = [[] for _ in range(hi - lo)]
                items: list[set] = [set() for _ in range(hi - lo)]
                for i, size, holders in known.scan(w):
                    d = int(w.doc_of(i))
                    a = i - int(w.first[d])
                    spans[d].append((a, a + size))
                    items[d].update(holders)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[lo:hi], pa.array(w.counts(), pa.int64()),
                        pa.array([[{"a": x, "b": y} for x, y in _merged(s)] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "spans", "items"],
                )

    return run


def _pieces(text: str, n: int, limit: int) -> Iterator[tuple[int, str]]:
    """The size of a text in words, and the text; one of more than `limit` is cut, so that each window is whole in a piece."""
    found = _WORD.finditer(text)
    held = list(islice(found, max(n, limit)))
    while held:
        more = list(islice(found, max(1, limit - n + 1)))
        part = text[held[0].start() : held[-1].end()]
        yield max(len(held), len(part.encode()) // WORD_BYTES), part
        held = held[len(held) - n + 1 :] + more if more else []


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks that hold at most `limit` words, read one partition at a time; at least one block."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    block, held = [], 0
    for item, text in rows.toLocalIterator():
        for size, part in _pieces(text, n, limit):
            if block and held + size > limit:
                yield block
                block, held = [], 0
            block.append((item, part))
            held += size
    yield block


def _each_block(rows: DataFrame, first: list[tuple[str, str]], others: Iterator[list[tuple[str, str]]], n: int, ws: Workspace, row: str, text_col: str) -> Iterator[DataFrame]:
    """row, n_words, spans, items of `rows` for each block, written before the next one is made; of the first all rows, then those with hits."""
    sc = rows.sparkSession.sparkContext
    for k, items in enumerate(chain([first], others)):
        known = sc.broadcast(Windows(items, n))
        found = rows.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scanning(known), SCANNED)
        yield ws.table(found.where("size(spans) > 0") if k else found).withColumnRenamed("doc_id", row)
        known.destroy()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, spans (word ranges that benchmark windows cover), items (their ids, sorted) for every row of `docs`."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, item_col, "text", n, block_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return rows.mapInArrow(_scanning(sc.broadcast(Windows(first, n))), SCANNED)
    ws = Workspace(docs.sparkSession)
    rows = ws.table(rows.withColumn("row", F.monotonically_increasing_id()))
    every = reduce(DataFrame.unionByName, _each_block(rows, first, chain([second], blocks), n, ws, "row", "text"))
    merged = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # overlapping spans of different blocks become one
    joined = F.aggregate(
        "spans", F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda got, s: F.when((F.size(got) > 0) & (s["a"] <= F.try_element_at(got, F.lit(-1))["b"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.try_element_at(got, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(got, F.lit(-1))["b"], s["b"]).alias("b"))))).otherwise(F.concat(got, F.array(s))),
    )
    return rows.select("row", "doc_id").join(merged.withColumn("spans", joined), "row").select("doc_id", "n_words", "spans", "items")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return scanned.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _removing(windows: object, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Windows = windows.value
        for b in batches:
            for lo, hi in chunks(b.column(text_at)):
                part = b.slice(lo, hi - lo)
                w = Words(part.column(text_at), ALNUM, lower=True)
                hit = np.zeros(len(part), bool)
                for i, _, _ in known.scan(w):
                    hit[int(w.doc_of(i))] = True
                yield part.filter(pa.array(~hit))

    return run


def remove(docs: DataFrame, benchmark: DataFrame, n: int = N, block_windows: int = BLOCK_WINDOWS, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """`docs` without the documents in which a benchmark window occurs; all columns unchanged."""
    blocks = _blocks(benchmark, item_col, "text", n, block_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        known = docs.sparkSession.sparkContext.broadcast(Windows(first, n))
        return docs.mapInArrow(_removing(known, docs.columns.index(text_col)), docs.schema)
    ws, row = Workspace(docs.sparkSession), free_name("row", docs.columns)
    rows = ws.table(docs.withColumn(row, F.monotonically_increasing_id()))
    every = reduce(DataFrame.unionByName, _each_block(rows, first, chain([second], blocks), n, ws, row, text_col))
    return rows.join(every.where("size(spans) > 0").select(row).distinct(), row, "left_anti").select(*map(column, docs.columns))
