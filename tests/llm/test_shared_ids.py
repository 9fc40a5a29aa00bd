"""Ids that repeat over different texts or vectors, and vectors without an id."""

import random

import brute
import pytest

from voltrail.llm import embedding_dedup, substring_dedup


def removed(rows, n=50):
    """Per row, in their order: words, removed words, digest of the rest."""
    words = [(i, brute.SPACED.findall(t or "")) for i, t in rows]
    least: dict = {}
    for i, w in words:
        for j in range(len(w) - n + 1 if i is not None else 0):
            x = tuple(w[j : j + n])
            least[x] = min(i, least.get(x, i))
    out = []
    for i, w in words:
        gone = {k for j in range(len(w) - n + 1 if i is not None else 0) if least[tuple(w[j : j + n])] < i for k in range(j, j + n)}
        out.append((i, len(w), len(gone), brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def passages(seed):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for n in (400, 320, 200, 600, 60)]


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
@pytest.mark.parametrize("order", range(4))
def test_texts_of_one_id_have_their_own_removals(spark, hot, order):
    a, b, c, d, e = passages(7)
    rows = [(1, a), (2, a[: len(a) // 2] + " " + b), (2, "short text of few words"), (2, d), (3, c + " " + b), (3, d), (3, d), (2, c), (4, None), (None, a), (3, e + " " + a), (5, e + " " + b + " " + e)]
    rows = random.Random(order).sample(rows, len(rows))
    df = spark.createDataFrame(list(rows), "doc_id long, text string").coalesce(1 if order % 2 else 4)
    got = substring_dedup.dedup(df, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == removed(rows)


def test_buckets_without_shared_windows(spark):
    """Super-k-mers that differ but share a minimiser meet in a bucket in which no window repeats."""
    r = random.Random(3)
    gram = " ".join(f"m{k}" for k in range(6))
    rows = [(k, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(40)), gram, *(f"w{r.randrange(10**6)}" for _ in range(40))])) for k in range(60)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == removed(rows)


def test_vectors_without_id_are_linked(spark):
    near = lambda x: [1.0, x]
    rows = [(1, near(0.0), 5), (None, near(0.01), 5), (None, near(5.0), 5), (None, near(5.01), 5), (None, near(5.01), 5), (2, near(-3.0), 5), (3, near(0.01), 6), (7, near(9.0), 5), (None, None, 5), (None, near(0.0), None)]
    out = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(3)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr)
    # cosines: 0.0 and 0.01 link, 5.0 and 5.01 and 9.0 link; label 6 and no label link with nothing here
    near5 = [(None, 3, 7)] * 3 + [(7, 3, 7)]
    assert got == sorted([(1, 1, 1), (None, 1, 1), *near5, (2, 0, 2), (3, 0, 3), (None, 0, None), (None, 0, None)], key=repr)


def test_classes_without_any_id(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (4, [0.0, 1.0], 1)]
    out = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr) == sorted([(None, 1, None), (None, 1, None), (4, 0, 4)], key=repr)
