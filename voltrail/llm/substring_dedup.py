"""Substring dedup by super-k-mer partitioning.

Each window of 50 consecutive words has a minimiser: the least hash among its
6-word grams. Consecutive windows with one minimiser are one super-k-mer (of at
most `LONGEST` windows; a longer one is several).

First only (minimiser, digest of the super-k-mer's words, document, place) travels.
Equal super-k-mers are contracted, within a task before the shuffle and then in the
minimiser's bucket: all documents but the smallest that holds one lose its whole
span. What is left of a minimiser with different super-k-mers travels as packed
strings (the text between first and last word), one for each different string, to
its bucket, where a sort of their windows finds, for every window, the smallest
document that holds it.

A minimiser of more than `hot` different strings has no bucket: its windows are
counted by a partial aggregate on their hashes and joined back, with the same
result, so that no task has to take all contexts of a passage that very many
documents share.

Super-k-mers and windows are compared by 128 bits of hash over their word sequences.

Nulls have no words; documents under 50 words lose none. Windows are judged on
the input. Rows that share one id are one document in the order of ids, so none
loses a window for another of them; each has its own removals. A null id keeps all
its words. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.streams import starts, whole_runs
from voltrail.llm.text import NON_SPACE, U, Words, chunks, fits, mix, span_hash, window_hash
from voltrail.llm.workspace import Workspace

WINDOW, GRAM = 50, 6
HOT = 20_000  # different strings of a minimiser that one task sorts
LONGEST = 256  # windows of a super-k-mer, so that a string is short whatever the text
SEEN = 500_000  # super-k-mers that a task remembers to contract equal ones
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def window_minima(g: np.ndarray, n: int) -> np.ndarray:
    """Least of n consecutive entries, at their first; by doubling."""
    out, have = g, 1
    while have < n:
        step = min(have, n - have)
        shifted = np.append(out[step:], np.full(min(step, len(out)), np.iinfo(np.uint64).max, np.uint64))
        out, have = np.minimum(out, shifted), have + step
    return out


def super_kmers(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word and number of windows of each super-k-mer."""
    ok = fits(w.first, len(w.hash), window)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    least = window_minima(window_hash(w.hash, gram), window - gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    new |= np.isin(at, w.first[:-1])
    new |= (np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))) % LONGEST == 0
    begin = np.flatnonzero(new)
    return least[begin], at[begin], np.diff(np.append(begin, len(at)))


def _two_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h, mix(h ^ U(0xA5A5A5A5))


def _placing(window: int, gram: int) -> Task:
    """Places of super-k-mers (kind 1), or, where the task has seen a smaller document with an equal one, spans that go (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                ids, texts = (b.column(c)[lo:hi].to_numpy(zero_copy_only=False) for c in (0, 2))
                w = Words(b.column(1)[lo:hi], NON_SPACE, lower=False)
                key, at, n = super_kmers(w, window, gram)
                d = w.doc_of(at)
                doc = ids[d].astype(np.int64)
                s1, s2 = (span_hash(h, at, at + n + window - 1).view(np.int64) for h in _two_hashes(w.hash))
                kind = np.ones(len(at), np.int32)
                for i, (x, own) in enumerate(zip(zip(s1.tolist(), s2.tolist()), doc.tolist())):
                    least = seen.get(x)
                    if least is None:
                        if len(seen) < SEEN:
                            seen[x] = own
                    elif own > least:
                        kind[i] = 0
                    elif own < least:
                        seen[x] = own
                yield _batch(kind=kind, key=np.where(kind == 0, mix(doc.view(np.uint64)), key).view(np.int64), s1=s1, s2=s2, doc_id=doc, start=(at - w.first[d]).astype(np.int32), n=n.astype(np.int32), of_text=texts[d].astype(np.int64))

    return run


def _sharing(hot: int) -> Task:
    """From places in order of (kind, key, s1, s2, doc_id): spans that go since a smaller document holds them (0), and the
    places whose strings go to the bucket (1) or, of minimisers with more than `hot` different ones, are taken window by window (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int, int] | None = None  # the last string of a long run's piece and its least document
        for t, long in whole_runs(batches, n_keys=2, limit=10 * hot, at_least=min(20_000, 10 * hot)):
            kind, key, s1, s2, doc, start, n, text = (t.column(c).to_numpy() for c in ("kind", "key", "s1", "s2", "doc_id", "start", "n", "of_text"))
            run_at, at = starts(kind, key), starts(kind, key, s1, s2)
            lead = np.repeat(doc[at], np.diff(np.append(at, len(key))))
            if held and held[:3] == (key[0], s1[0], s2[0]) and kind[0] == 1:
                lead[: at[1] if len(at) > 1 else len(key)] = held[3]
            held = (key[-1], s1[-1], s2[-1], lead[-1])
            texts = np.repeat(np.add.reduceat(np.isin(np.arange(len(key)), at).astype(np.int64), run_at), np.diff(np.append(run_at, len(key))))
            gone = (kind == 0) | (doc != lead)
            keep = gone | long | (texts > 1)
            out = np.where(gone, 0, np.where(long | (texts > hot), 2, 1)).astype(np.int32)
            yield _batch(doc_id=doc[keep], kind=out[keep], key=key[keep], start=start[keep], n=n[keep], of_text=text[keep])

    return run


def _packing(hot: bool, window: int) -> Task:
    """Packed super-k-mers of ordinary minimisers, or the windows of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                w = Words(b.column(1)[lo:hi], NON_SPACE, lower=False)
                ids, texts = (b.column(c)[lo:hi].to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 3))
                places = b.column(2)[lo:hi]
                size = np.diff(places.offsets.to_numpy())
                flat = places.flatten()
                doc = np.repeat(np.arange(hi - lo), size)
                kind, key, start, n = (flat.field(c).to_numpy() for c in ("kind", "key", "start", "n"))
                pick = kind == (2 if hot else 1)
                doc, key, start, n = doc[pick], key[pick], start[pick].astype(np.int64), n[pick].astype(np.int64)
                at, idn, text = w.first[doc] + start, ids[doc], texts[doc]
                if hot:
                    one = np.repeat(at, n) + _ramp(n)
                    h = [window_hash(x, window) for x in _two_hashes(w.hash)]
                    yield _batch(w1=h[0][one].view(np.int64), w2=h[1][one].view(np.int64), doc_id=np.repeat(idn, n), start=(np.repeat(start, n) + _ramp(n)).astype(np.int32), of_text=np.repeat(text, n))
                else:
                    a, z = w.start[at], w.end[at + n + window - 2]
                    raw = w.bytes.tobytes()
                    yield _batch(key=key, doc_id=idn, start=start.astype(np.int32), packed=pa.array([raw[i:j] for i, j in zip(a.tolist(), z.tolist())], pa.binary()), of_text=text)

    return run


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _counting(window: int) -> Task:
    """In each bucket, the windows that a smaller document holds too, as word spans of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_runs(batches, at_least=2_000):
            doc, start, text = (t.column(c).to_numpy() for c in ("doc_id", "start", "of_text"))
            w = Words(t.column("packed").combine_chunks().cast(pa.large_binary()).view(pa.large_string()), NON_SPACE, lower=False)
            one = np.flatnonzero(fits(w.first, len(w.hash), window))
            row = w.doc_of(one)
            h1, h2 = (window_hash(x, window)[one] for x in _two_hashes(w.hash))
            order = np.lexsort((doc[row], h2, h1))
            new = starts(h1[order], h2[order])
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(doc[row][order][new], np.diff(np.append(new, len(order))))
            gone = np.flatnonzero(least < doc[row])
            first = start[row[gone]] + one[gone] - w.first[row[gone]]
            # windows next to one another are one span
            begin = np.ones(len(gone), bool)
            begin[1:] = (row[gone][1:] != row[gone][:-1]) | (first[1:] != first[:-1] + 1)
            i = np.flatnonzero(begin)
            last = np.append(i[1:], len(gone)) - 1
            if not len(i):
                continue
            of = row[gone[i]]
            yield _batch(doc_id=doc[of], of_text=text[of], a=first[i].astype(np.int32), b=(first[last] + window).astype(np.int32))

    return run


def _removing(with_text: bool) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                w = Words(b.column(1)[lo:hi], NON_SPACE, lower=False)
                raw = w.bytes.tobytes()
                count = w.counts()
                removed, texts = [], []
                for d, spans in enumerate(b.column(2)[lo:hi]):
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    keep = np.ones(z - a, bool)
                    for s in spans.as_py() or ():
                        keep[s["a"] : s["b"]] = False
                    left = np.flatnonzero(keep) + a
                    removed.append(z - a - len(left))
                    texts.append(b" ".join(raw[i:j] for i, j in zip(w.start[left].tolist(), w.end[left].tolist())))
                out = {"doc_id": b.column(0)[lo:hi], "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                yield _batch(**out, kept=pa.array(texts, pa.binary()).view(pa.string())) if with_text else _batch(**out, kept_sha256=pa.array([sha256(x).hexdigest() for x in texts]))

    return run


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (or, with_text, the kept text) for every row of `docs`."""
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("of_text", F.xxhash64("text"))
    known = rows.where("doc_id is not null")
    # an id may stand for several texts: places belong to an id and a text's hash, once for rows that are equal
    key = ["doc_id", "of_text"]
    places = known.select("doc_id", "text", "of_text").mapInArrow(_placing(window, gram), "kind int, key bigint, s1 bigint, s2 bigint, doc_id bigint, start int, n int, of_text bigint")
    shared = ws.table(places.repartition("kind", "key").sortWithinPartitions("kind", "key", "s1", "s2", "doc_id").mapInArrow(_sharing(hot), "doc_id bigint, kind int, key bigint, start int, n int, of_text bigint"))

    def placed(which: str) -> DataFrame:
        by_doc = shared.where(which).groupBy(*key).agg(F.collect_set(F.struct("kind", "key", "start", "n")).alias("places"))
        return known.join(by_doc, key).select("doc_id", "text", "places", "of_text")

    packed = placed("kind > 0").mapInArrow(_packing(False, window), "key bigint, doc_id bigint, start int, packed binary, of_text bigint")
    spans = packed.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_counting(window), "doc_id bigint, of_text bigint, a int, b int")
    wins = placed("kind = 2").mapInArrow(_packing(True, window), "w1 bigint, w2 bigint, doc_id bigint, start int, of_text bigint")
    least = wins.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    again = wins.join(least.drop("most"), ["w1", "w2"]).where("doc_id > least").select(*key, F.col("start").alias("a"), (F.col("start") + window).alias("b"))
    copies = shared.where("kind = 0").select(*key, F.col("start").alias("a"), (F.col("start") + F.col("n") + (window - 1)).alias("b"))
    gone = ws.table(spans.unionByName(again).unionByName(copies))
    by_doc = gone.groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    both = rows.join(by_doc, key, "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_removing(with_text), "doc_id bigint, n_words bigint, n_removed bigint, " + ("kept string" if with_text else "kept_sha256 string"))
