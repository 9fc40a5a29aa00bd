"""The pipeline's near copies against 5-word shingles at 0.8 or more."""

import random
import uuid

import brute
import numpy as np
import pytest

import corpus_pipeline
from voltrail.llm import ngram_join
from voltrail.llm.workspace import read


def sets(rows, k):
    out = {}
    for i, text in rows:
        w = brute.SPACED.findall((text or "").translate(brute.LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def kept(rows, k=5, percent=80):
    s = sets(rows, k)
    ids = sorted(s)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return {i for i, root in brute.roots(ids, links).items() if i == root}


def edited(w, at):
    return [f"edit{j}" if j in at else x for j, x in enumerate(w)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = []
    for n in (20, 60, 230, 230, 600):
        w = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(w))
        texts += [" ".join(edited(w, set(r.sample(range(n), max(1, round(n * share)))))) for share in (0.01, 0.02, 0.0217, 0.025, 0.03, 0.05)]
    return list(enumerate([None, "", "one", *texts]))


def test_five_edits_in_230_words_are_a_near_copy(spark):
    w = [f"w{j}" for j in range(230)]
    rows = [(1, " ".join(w)), (2, " ".join(edited(w, {20, 60, 100, 140, 180})))]
    five, four = (jaccard(*sets(rows, k).values()) for k in (5, 4))
    assert five >= 0.8 and four < 0.85
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [x["doc_id"] for x in out.collect()] == [1]


def test_stage_near_the_limit(spark, rows):
    assert kept(rows) != kept(rows, 4, 85)
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x["doc_id"] for x in out.collect()} == kept(rows)


def test_stage_on_documents(spark, small_dir):
    docs = read(spark, small_dir, "documents")
    want = kept([(x["doc_id"], x["text"]) for x in docs.collect()])
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, small_dir).collect()} == want


def test_linked_sets_share_a_first_coordinate():
    import numpy as np

    r = np.random.default_rng(0)
    rarity = r.integers(0, 9, ngram_join.RARITY).astype(np.float32)
    for percent in (80, 85):
        for n in (1, 2, 5, 20, 120, 900):
            for _ in range(40):
                x = r.integers(0, 1 << 63, n).astype(np.uint64)
                gone = r.integers(0, n * (100 - percent) // 100 + 1)
                more = r.integers(0, n * (100 - percent) // 100 + 1 - gone)
                y = np.concatenate([x[gone:], r.integers(0, 1 << 63, more).astype(np.uint64)])
                assert 100 * (n - gone) >= percent * (n + more)
                a, b = (ngram_join.first_coordinates(np.sort(s), rarity, percent) for s in (x, y))
                assert len(np.intersect1d(a, b))


def test_documents_that_only_look_alike_make_no_pairs(spark, monkeypatch):
    """Long documents of passages of one pool, of which any two share seven tenths: few pairs are verified, and the near copies among them are found."""
    r = random.Random(8)
    pool = [[f"w{b}x{j}" for j in range(30)] for b in range(400)]
    texts = [" ".join(w for b in sorted(r.sample(range(400), 280)) for w in pool[b]) for _ in range(30)]
    texts += [x + " " + " ".join(f"end{k}x{j}" for j in range(400)) for k, x in enumerate(texts[:4])]
    rows = [(k, x) for k, x in enumerate(texts)]
    tried, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda rows, pairs, *a: tried.append(pairs.count()) or verified(rows, pairs, *a))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 30 for k, _ in rows}
    assert sum(tried[2:]) <= len(rows)  # the first two rounds pair members of nodes with their leaders


def test_documents_that_look_alike_are_searched_in_few_rows(spark, monkeypatch, tmp_path):
    """Documents of one pool lie in some hundred nodes together; each goes to few groups, once, and the last near copy is found."""
    r = random.Random(8)
    pool = [[f"w{b}x{j}" for j in range(30)] for b in range(60)]
    texts = [" ".join(w for b in sorted(r.sample(range(60), 42)) for w in pool[b]) for _ in range(30)]
    texts += [" ".join(edited(x.split(), {3 * k})) for k, x in enumerate(texts[:4])]
    rows = [(k, x) for k, x in enumerate(texts)]
    searching = ngram_join._searching

    def counted(*how):
        def run(batches):
            def told():
                for b in batches:
                    (tmp_path / uuid.uuid4().hex).write_text(str(b.num_rows))
                    yield b

            return searching(*how)(told())

        return run

    monkeypatch.setattr(ngram_join, "_searching", counted)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert 0 < sum(int(p.read_text()) for p in tmp_path.iterdir()) <= 10 * len(rows)


def test_a_group_is_searched_again_if_a_pair_of_it_is_no_link(spark, monkeypatch):
    """Bounds that let every pair of the first search pass: it connects what is not linked, and the links held back are found."""
    searching = ngram_join._searching

    def loose(percent, every):
        def run(batches):
            bound, ngram_join.overlap_bound = ngram_join.overlap_bound, lambda x, y: np.full(np.broadcast_shapes(x.shape, y.shape)[:-1], 1 << 40)
            exact, ngram_join.Hashes.overlap = ngram_join.Hashes.overlap, lambda self, query, i: np.full(len(i), 1 << 40)
            try:
                yield from searching(percent, every)(batches)
            finally:
                ngram_join.overlap_bound, ngram_join.Hashes.overlap = bound, exact

        return searching(percent, every) if every else run

    monkeypatch.setattr(ngram_join, "_searching", loose)
    r = random.Random(4)
    rows = []
    for k in range(12):
        base = [f"c{k}x{j}" for j in range(100)]
        rows += [(len(rows) + m, " ".join(edited(base, set(r.sample(range(100), r.choice([1, 2, 3, 4])))))) for m in range(8)]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def brute_components(rows, k=4, percent=85):
    s = sets(rows, k)
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return brute.roots(sorted(s), links)


def test_packed_values_come_back_in_fewer_bytes():
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 600, 6_000):
        values = np.sort(r.integers(0, 1 << 16, n).astype(np.uint16))
        packed = ngram_join.pack(values)
        assert ngram_join.unpack(packed) == values.tobytes()
        assert n < 600 or len(packed) < 0.7 * values.nbytes
    assert ngram_join.unpack(None) is None


def test_hashes_bound_overlaps():
    r = np.random.default_rng(5)
    some = [np.sort(r.integers(0, 50, n).astype(np.uint16)) for n in (0, 1, 30, 200, 500)]
    h = ngram_join.Hashes([*(x.tobytes() for x in some), None])
    for q in some:
        want = [int(np.minimum(np.bincount(q, minlength=50), np.bincount(x, minlength=50)).sum()) for x in some]
        assert h.overlap(q.tobytes(), np.arange(5)).tolist() == want
        assert h.overlap(q.tobytes(), np.array([5, 2])).tolist() == [np.iinfo(np.int64).max, want[2]]
    assert h.overlap(None, np.arange(6)).min() == np.iinfo(np.int64).max
