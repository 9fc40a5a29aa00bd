"""Lexical search, fingerprints and the Merkle manifest against plain versions: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import brute
import pytest
import xxhash
from pyspark.sql import functions as F

from voltrail.llm import fingerprint, lexical_search, merkle, queries
from voltrail.llm.workspace import Workspace

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VOCABULARY = [a + b for a in ("ba", "Ko", "ri9", "me", "tú") for b in ("na", "lo", "x", "")]


def text(r, n):
    return "".join(r.choice(VOCABULARY) + r.choice([" ", ", ", "\n", "_"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, lang): null and repeated ids, whole copies, one very long text, texts without words."""
    r = random.Random(5)
    rows = [(k, text(r, r.choice([1, 4, 9, 40, 200])), r.choice(["en", "fr", "fr", "fr", None, "é"])) for k in range(300)]
    rows += [(k + 1000, rows[7][1], "en") for k in range(30)] + [(5, "other words", "en"), (5, "other words", "en"), (None, text(r, 30), "fr"), (None, text(r, 30), None), (None, None, None)]
    rows += [(2000, None, "en"), (2001, "", "fr"), (2002, " \t\n", "de"), (2003, "... --", "de"), (2004, text(r, 20_000), "fr"), (-7, "bana", "en"), (2005, "\U0001f600bana é", "en")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "web"))
    return df.withColumns({c: F.lit("x") for c in ("TERMS", "b", "s", "g", "idx", "leaf", "hash", "path", "part", "a`b")}).withColumn("n_chars", F.length("text").cast("long")).repartition(5)


# --- lexical search


def searched(rows, items, k):
    """Sorted (item_id, rank, doc_id, score) by the definition; of whole copies any may come first."""
    held = [(i, Counter(TERM.findall((t or "").translate(brute.LOWER)))) for i, t, *_ in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, words = len(held), sum(n for *_, n in held)
    holders = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, t in items:
        terms = set(TERM.findall((t or "").translate(brute.LOWER)))
        scores = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[x] + 1))) * ((1_000_000_000 * c[x]) // (1_000 * c[x] + 20 * m)) for x in terms if c[x])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def items_of(corpus):
    r = random.Random(8)
    return [("a", "Bana KONA, ri9x"), ("a", "Bana KONA, ri9x"), ("b", corpus[3][1]), (None, "tú melo"), ("c", None), ("d", ""), ("e", "nowhere"), ("f", "?!"), ("g", text(r, 60)), ("h", "words"), ("i", "é bana bana")]


@pytest.mark.parametrize("k, fan, terms", [(50, 16, 20_000), (3, 2, 20_000), (1, 4, 10), (1000, 3, 20_000)])
def test_search_is_brute_force(spark, docs, corpus, k, fan, terms):
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit("x"))
    out = lexical_search.search(docs, bench, k=k, fan=fan, block_terms=terms)
    assert out.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect()), key=repr) == searched(corpus, items, k)


def test_search_in_small_ranges(spark, docs, corpus, monkeypatch):
    """Ranges are made where the tasks run, so they are made here."""
    items = items_of(corpus)
    terms = lexical_search.Terms([t for _, t in items if t and TERM.search(t)])
    sent = type("Sent", (), {"value": terms})
    batches = [b for b in docs.select("doc_id", "text").coalesce(1).toArrow().to_batches()]
    found = [b for b in lexical_search._finding(sent)(iter(batches))]
    monkeypatch.setattr(lexical_search, "RANGE_DOCS", 7)
    monkeypatch.setattr(lexical_search, "RANGE_ENTRIES", 30)
    sizes = [(t.num_rows, len(t.column("terms").combine_chunks().flatten())) for t in lexical_search._ranges(iter(found))]
    assert all(n <= 7 and (e <= 30 or n == 1) for n, e in sizes)
    assert sum(n for n, _ in sizes) == sum(b.num_rows for b in found)


def test_search_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([("a", "bana")], "item_id string, text string")
    assert lexical_search.search(docs.limit(0), bench).collect() == lexical_search.search(docs, bench.limit(0)).collect() == []
    assert lexical_search.search(docs.where("text is null"), bench).collect() == []


def test_tree_opens_little(spark):
    """Where few documents can reach the best score, most nodes stay closed."""
    import numpy as np

    n = 4096
    first, term, impact = np.arange(n + 1), np.zeros(n, np.int64), np.arange(n, dtype=np.int64) + 1
    tree = lexical_search.Tree(np.arange(n), np.zeros(n, bool), first, term, impact, 1, 16)
    opened = []
    bounds = tree.bounds
    tree.bounds = lambda *a: opened.append(a) or bounds(*a)
    best: list = []
    tree.best(np.array([0]), np.array([7]), np.array([7]), 5, best)
    assert sorted(best) == [(7 * (n - k), 0, -(n - 1 - k)) for k in range(4, -1, -1)]
    assert len(opened) <= 4


# --- fingerprints


def h64(values):
    """Spark's hash of strings, ints and longs, one after the other."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def printed(t):
    w = brute.SPACED.findall((t or "").translate(brute.LOWER))
    if not w:
        return ""
    bins = {}
    for k in range(max(1, len(w) - 4)):
        h = h64(w[k : k + 5])
        bins[(h >> 56) + 128] = min(bins.get((h >> 56) + 128, 1 << 63), h)
    low = {k: h & 15 for k, h in bins.items()}
    out = []
    for i in range(256):
        probes = (h64([j, i]) % 256 for j in range(16))
        first = i if i in low else next((p for p in probes if p in low), None)
        if first is None:
            first = min(low, key=lambda b: h64([i, b]) >> 4)
        out.append(low[first])
    return "".join(f"{x:X}" for x in out)


def alike(a, b):
    if not a or not b:
        return float(a == b)
    f = sum(x == y for x, y in zip(a, b)) / 256
    return max(0.0, min(1.0, (f - 1 / 16) / (15 / 16)))


def neighbours(rows):
    """The expected row of each document whose id is its own."""
    tie = lambda t: h64([t or ""])
    rows = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), tie(x[1])))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        out.append((i, len(t), brute.sha(e), printed(t), printed(e), round(alike(printed(t), printed(e)), 9), round(alike(printed(t), printed(u)), 9)))
    return sorted(out, key=repr)


def prints(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, df.collect())), key=repr)


def test_fingerprints_are_brute_force(docs, corpus):
    assert prints(fingerprint.digest(docs)) == neighbours(corpus)


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_blocks_of_neighbours_make_no_difference(spark, docs, corpus, block):
    some = [r for r in corpus if r[0] is None or r[0] % 3 == 0]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string")
    assert prints(fingerprint.digest(df, block=block)) == neighbours(some)


@pytest.mark.parametrize("rows", [[], [(4, "one two three four five six")], [(4, None)], [(None, "a"), (None, "b")], [(-(1 << 63), "a b"), ((1 << 63) - 1, "a c"), (0, None)]])
def test_fingerprints_of_few_rows(spark, rows):
    assert prints(fingerprint.digest(spark.createDataFrame(rows, "doc_id long, text string"))) == neighbours(rows)


def test_next_keys_in_blocks(spark):
    r = random.Random(3)
    keys = sorted({(r.choice([r.randrange(-50, 50), r.randrange(-(10**9), 10**9)]), r.randrange(3)) for _ in range(900)})
    df = spark.createDataFrame(keys, "b long, s long")
    want = sorted((*a, *b) for a, b in zip(keys, [*keys[1:], (None, None)]))
    for few in (10_000, 20):
        got = fingerprint.next_keys(df, Workspace(spark), few=few, block=10)
        assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == want


def test_likeness_is_jaccard(spark):
    """The estimate lies near the true share of common shingles, over many pairs."""
    r = random.Random(9)
    rows = []
    for share in [0.0, 0.2, 0.5, 0.8, 0.9, 1.0] * 20:
        a = [f"w{r.randrange(10**6)}" for _ in range(r.choice([40, 300, 2000]))]
        cut = int(len(a) * share)
        b = a[:cut] + [f"w{r.randrange(10**6)}" for _ in range(len(a) - cut)]
        s, t = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        rows.append((" ".join(a), " ".join(b), len(s & t) / len(s | t)))
    df = spark.createDataFrame(rows, "a string, b string, j double")
    d = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb").withColumn("got", fingerprint.likeness(F.col("fa"), F.col("fb")))
    off = [r["got"] - r["j"] for r in d.select("got", "j").collect()]
    assert max(map(abs, off)) < 0.15
    assert abs(sum(off) / len(off)) < 0.02
    assert math.sqrt(sum(x * x for x in off) / len(off)) < 0.045


def test_fingerprints_run_no_python(docs):
    plan = fingerprint.digest(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n, t):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))


def tree(nodes, fan=8):
    """The top, and of each node its siblings before and after it from below."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = level[at[k] // fan * fan : at[k] // fan * fan + fan]
            p.append((run[: at[k] % fan], run[at[k] % fan + 1 :]))
            at[k] //= fan
        level = [H(*level[j : j + fan]) for j in range(0, len(level), fan)]
    return (level or [None])[0], paths


def manifested(rows, fan=8):
    groups: dict = {}
    for i, t, lang in rows:
        source, n = ("web" if i is not None and math.fmod(i, 3) > 0 else None), None if t is None else len(t)
        low = None if t is None else t.translate(brute.LOWER)
        told = leaf_of(i, source, lang, n, low) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else None
        groups.setdefault(lang, []).append((i, leaf_of(i, source, lang, n, t), told))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {x: tree([leaf for _, leaf, _ in groups[x]], fan) for x in langs}
    root, above = tree([trees[x][0] for x in langs], fan)
    out = []
    for k, x in enumerate(langs):
        for (i, leaf, told), path in zip(groups[x], trees[x][1]):
            path = path + above[k]
            h = told or leaf
            for before, after in path:
                h = H(*before, h, *after)
            out.append((i, leaf, trees[x][0], root, H(*(s for step in path for side in step for s in side)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan", [8, 2, 3])
def test_manifest_is_brute_force(docs, corpus, fan):
    got = sorted(map(tuple, merkle.audit(docs, fan=fan).collect()), key=repr)
    assert got == manifested(corpus, fan)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(3, "Text", "en")], [(3, "Text", None), (12, "A", "en")], [(k, "T", "en") for k in range(9)], [(k, "T", f"l{k}") for k in range(20)]])
def test_manifest_of_few_rows(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.when(F.col("doc_id") % 3 > 0, "web"), "n_chars": F.length("text")})
    assert sorted(map(tuple, merkle.audit(df).collect()), key=repr) == manifested(rows)
    monkeypatch.setattr(merkle, "BROADCAST_COUNTS", 0)
    assert sorted(map(tuple, merkle.audit(df).collect()), key=repr) == manifested(rows)


def test_manifest_keeps_preimages(docs, corpus):
    """Parents hold their children's hashes, and every leaf's path folds to the root."""
    known = merkle.manifest(merkle.tampered_leaves(docs))
    assert known.leaves.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    for level in [*known.levels, *known.top_levels]:
        assert level.where((F.sha2("preimage", 256) != F.col("hash")) | (F.length("preimage") % 64 != 0) | (F.length("preimage") > 512)).count() == 0
    assert known.leaves.count() == len(corpus)


def test_later_queries_have_sql():
    assert {"op11_lexical_search", "op13_merkle_manifest"} <= set(queries.oracle_sql())
