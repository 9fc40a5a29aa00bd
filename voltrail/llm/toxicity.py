"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Terms (whole words and word prefixes of several lengths) that labelled toxic
documents hold more often than others make the lexicons and patterns. Dealt into
lists, each list is a voter: it votes toxic on a document with one of its terms,
and abstains otherwise. Further voters judge how many and how dense the terms
are, and vote clean where there are none. With `annotators`, their labels, where a
row may be learned from, are one more voter.

The label model gives each voter, the annotators too, its chances of each vote on
toxic and on clean documents. It is fitted by expectation and maximisation over
counts of vote patterns from all documents; the correlations of votes left between
voters inside each class discount the weights of those that say the same. Its
posteriors, not the labels, are the targets of a logistic regression over the
terms, trained on labelled and on unlabelled rows, which scores every
document on its whole text.

Bounds, all parameters: terms are mined from at most about `max_labelled` labelled
rows, drawn by hash, the classifier is trained on those and at most about
`max_unlabelled` others outside the held-out fold; the lexicon has the `max_terms`
terms of the sample that tell most (all its terms are counted in both classes).
Votes and label model cover every document.

Nulls and empty texts have no terms and get the score of such a text. Repeated
rows are scored each; of repeated labels of one id the largest holds. Without
usable labels of both classes the score is the share of toxic ones among those
seen (0 without any). A null id is scored but never learned from. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.streams import starts
from voltrail.llm.text import ALNUM, CHUNK_BYTES, HashSet, U, Words, chunks, mix, rolling
from voltrail.llm.workspace import Workspace

LENGTHS = (0, 3, 4, 5, 6, 8)  # bytes of a prefix; 0: the whole word
MAX_LABELLED = 12_000
MAX_UNLABELLED = 6_000
MAX_TERMS = 600
LEAST_TOXIC = 3
LEAST_GAIN = 12.0
PURE = 40.0  # times as frequent in toxic documents as in others
LISTS = 3  # voters of each length
ANNOTATOR = 0.95  # where the annotators' reliability starts; it is estimated
ROUNDS = 12
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _terms(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words' terms of each length, and the words that have one."""
    size = w.end - w.start
    for k in LENGTHS:
        at = np.flatnonzero(size >= k) if k else np.arange(len(size))
        h = w.span_hash(w.start[at], w.start[at] + k) if k else w.hash
        yield mix(h + U(k)), at


@dataclass
class Lexicon:
    """The terms in use, as hashes, with their lengths' places and whether hardly a clean document held one."""

    hashes: np.ndarray
    kinds: np.ndarray
    pure: np.ndarray
    set: HashSet = field(init=False)

    def __post_init__(self) -> None:
        self.set = HashSet(self.hashes)
        order = np.argsort(self.hashes)
        self.hashes, self.kinds, self.pure = self.hashes[order], self.kinds[order], self.pure[order]
        # lists of one length: dealt by hash
        self.voter = self.kinds * LISTS + (self.hashes % U(LISTS)).astype(np.int64)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, count), in order of document and term."""
        found = []
        for h, at in _terms(w):
            i, term = self.set.find(h)
            found.append((w.doc_of(at[i]) if len(i) else i, term))
        doc, term = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        pairs, n = np.unique(doc * (len(self.hashes) + 1) + term, return_counts=True)
        return pairs // (len(self.hashes) + 1), pairs % (len(self.hashes) + 1), n


#: Voters: LISTS for each length, then five on the terms as a whole, then the annotators.
N_LISTS = len(LENGTHS) * LISTS
N_VOTERS = N_LISTS + 6
ABSTAIN, TOXIC, CLEAN = 0, 1, 2


def votes_of(lexicon: Lexicon, doc: np.ndarray, term: np.ndarray, n: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Votes of all voters but the annotators on each document."""
    rows = len(n_words)
    votes = np.zeros((rows, N_VOTERS - 1), np.int8)
    votes[doc, lexicon.voter[term]] = TOXIC
    kinds = np.bincount(doc, minlength=rows)
    pure = np.bincount(doc, weights=lexicon.pure[term], minlength=rows)
    dense = np.bincount(doc, weights=n, minlength=rows) / np.maximum(n_words, 1)
    many = votes[:, :N_LISTS].sum(1)
    for k, (toxic, clean) in enumerate(((pure > 0, pure == 0), (pure > 3, kinds == 0), (kinds > 5, kinds < 2), (dense > 0.05, dense < 0.005), (many > 2, many == 0))):
        votes[:, N_LISTS + k] = np.where(toxic, TOXIC, np.where(clean, CLEAN, ABSTAIN))
    return votes


def dense_features(lexicon: Lexicon, doc: np.ndarray, term: np.ndarray, n: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The classifier's inputs: a bias, four sums, and each term's presence."""
    rows = len(n_words)
    x = np.zeros((rows, 5 + len(lexicon.hashes)), np.float32)
    x[doc, 5 + term] = 0.5 + 0.5 * np.log(n)
    pure = np.bincount(doc, weights=lexicon.pure[term], minlength=rows)
    kinds = np.bincount(doc, minlength=rows)
    dense = np.bincount(doc, weights=n, minlength=rows) / np.maximum(n_words, 1)
    x[:, 0] = 1
    x[:, 1] = 2 * (pure > 0)
    x[:, 2] = np.log1p(pure)
    x[:, 3] = np.log1p(kinds)
    x[:, 4] = 4 * np.sqrt(dense)
    return x


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, place of the length, toxic texts, clean texts) that hold it, of some texts at a time."""
    for b in batches:
        for lo, hi in chunks(b.column("text")):
            w = Words(b.column("text")[lo:hi], ALNUM, lower=True)
            toxic = b.column("toxic")[lo:hi].to_numpy(zero_copy_only=False).astype(np.int64) == 1
            for k, (h, at) in enumerate(_terms(w)):
                doc = w.doc_of(at)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                one = starts(h, doc)
                h, doc = h[one], doc[one]
                new = starts(h)
                n = np.diff(np.append(new, len(h)))
                t = np.add.reduceat(toxic[doc].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(np.full(len(new), k, np.int32)), pa.array(t), pa.array(n - t)], names=["term", "kind", "t", "c"])


def _signing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's least shingle hash: near copies mostly have the same."""
    for b in batches:
        for lo, hi in chunks(b.column("text")):
            w = Words(b.column("text")[lo:hi], ALNUM, lower=True)
            h = np.append(rolling(w.hash, 3), U(0))
            first, last = w.first[:-1], w.first[1:]
            least = [int(h[a : max(a + 1, z - 2)].min().astype(np.int64)) if z > a else 0 for a, z in zip(first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in ("doc_id", "toxic", "text")), pa.array(least, pa.int64())], names=["doc_id", "toxic", "text", "signature"])


def mine(labelled: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon | None:
    """The terms that tell most of toxic documents, from rows of (toxic, text); None without documents of both classes."""
    size = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return None
    counted = labelled.select("toxic", "text").mapInArrow(_class_counts, "term bigint, kind int, t bigint, c bigint")
    counted = counted.groupBy("term", "kind").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= LEAST_TOXIC)
    # how much better than one common rate two rates explain the counts (a likelihood-ratio statistic)
    t, c, share = F.col("t"), F.col("c"), size[1] / (size[0] + size[1])
    gain = 2 * (t * F.log(t / (t + c) / share) + c * F.log(F.greatest(c.cast("double"), F.lit(1e-9)) / (t + c) / (1 - share)))
    told = counted.where(t * size[0] > c * size[1]).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    rows = told.orderBy(F.desc("gain"), "term").limit(max_terms).collect()
    if not rows:
        return None
    h = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    kind, toxic, clean = (np.array([r[k] for r in rows], np.int64) for k in ("kind", "t", "c"))
    return Lexicon(h, kind, toxic * size[0] >= PURE * (clean + 0.5) * size[1])


def _feature_batches(lexicon: Lexicon) -> Task:
    """Votes, packed four to a byte, and hits of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column("text")):
                w = Words(b.column("text")[lo:hi], ALNUM, lower=True)
                doc, term, n = lexicon.hits(w)
                votes = votes_of(lexicon, doc, term, n, w.counts())
                offsets = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[lo:hi], pa.array(w.counts(), pa.int64()), pa.array([v.tobytes() for v in votes], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
                    ],
                    names=["doc_id", "n_words", "votes", "terms", "counts"],
                )

    return run


_FEATURES = "doc_id bigint, n_words bigint, votes binary, terms array<int>, counts array<int>"


class LabelModel:
    """Chances of each vote given the class, and weights that allow for correlated voters."""

    def __init__(self, prior: float):
        self.prior = prior
        self.chance = np.zeros((2, N_VOTERS, 3))  # class (clean, toxic), voter, vote
        self.chance[0] = 0.60, 0.01, 0.39
        self.chance[1] = 0.60, 0.35, 0.05
        self.chance[0, -1] = 0.6, 0.4 * (1 - ANNOTATOR), 0.4 * ANNOTATOR
        self.chance[1, -1] = 0.6, 0.4 * ANNOTATOR, 0.4 * (1 - ANNOTATOR)
        self.share = np.ones(N_VOTERS)  # of a voter's weight that is its own

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        weight = np.log(self.chance[1]) - np.log(self.chance[0])
        # an annotator who did not look says nothing
        weight[-1, ABSTAIN] = 0
        score = np.log(self.prior / (1 - self.prior)) + (weight[np.arange(N_VOTERS), votes] * self.share).sum(1)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def statistics(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each class: its size, each voter's votes, and the pairs of voters that vote toxic together."""
        p = self.posterior(votes)
        said = (votes == TOXIC).astype(float)
        out = []
        for q in ((1 - p) * n, p * n):
            out += [[q.sum()], *(((votes == v) * q[:, None]).sum(0) for v in range(3)), ((said * q[:, None]).T @ said).ravel()]
        return np.concatenate(out)

    def learn(self, total: np.ndarray) -> None:
        alike = np.zeros((N_VOTERS, N_VOTERS))
        for y, part in enumerate(np.split(total, 2)):
            size, votes, pairs = part[0], part[1 : 1 + 3 * N_VOTERS].reshape(3, -1), part[1 + 3 * N_VOTERS :].reshape(N_VOTERS, -1)
            self.chance[y] = (votes.T + [0.5, 0.05, 0.05]) / (size + 0.6)
            rate = votes[TOXIC] / max(size, 1e-9)
            spread = np.sqrt(rate * (1 - rate)) + 1e-6
            alike = np.maximum(alike, (pairs / max(size, 1e-9) - np.outer(rate, rate)) / np.outer(spread, spread))
        np.fill_diagonal(alike, 0)
        self.share = 1 / (1 + np.clip(alike, 0, 1).sum(1))
        self.share[-1] = 1


def _unpacked(votes: pa.Array, label: np.ndarray) -> np.ndarray:
    own = np.frombuffer(b"".join(votes.to_pylist()), np.int8).reshape(-1, N_VOTERS - 1)
    return np.column_stack([own, label])


def _summing(model: LabelModel) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = model.statistics(_unpacked(b.column("votes"), b.column("label").to_numpy()), b.column("n").to_numpy().astype(float))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "x"])

    return run


def fit_label_model(patterns: DataFrame, prior: float, rounds: int = ROUNDS) -> LabelModel:
    """From a table of votes, label (the annotators' vote) and n: documents with that pattern."""
    model = LabelModel(prior)
    for _ in range(rounds):
        sums = patterns.mapInArrow(_summing(model), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not sums:
            break
        total = np.zeros(len(sums))
        for r in sums:
            total[r["i"]] = r["x"]
        before = model.chance.copy()
        model.learn(total)
        if np.abs(model.chance - before).max() < 1e-3:
            break
    return model


def fit_classifier(x: np.ndarray, target: np.ndarray, penalty: float = 2e-4, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft targets, by accelerated gradient steps; in x's precision, so that no step copies it."""
    w, m, v = (np.zeros(x.shape[1], x.dtype) for _ in range(3))
    target = target.astype(x.dtype)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) / len(x) + penalty * w * (np.arange(len(w)) > 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w.astype(np.float64)


def _scoring(lexicon: Lexicon, weights: np.ndarray) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2_000):
                part = b.slice(lo, 2_000)
                x = dense_features(lexicon, *_hits(part), part.column("n_words").to_numpy())
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def _hits(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms = b.column("terms")
    doc = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
    return doc, terms.flatten().to_numpy().astype(np.int64), b.column("counts").flatten().to_numpy().astype(np.int64)


def _learned(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) != 0


@dataclass
class Model:
    """What scoring needs: terms and weights, or one score for all."""

    lexicon: Lexicon | None
    weights: np.ndarray | None
    share: float
    features: DataFrame | None = None


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, max_terms: int = MAX_TERMS, annotators: bool = True, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the rows of `labels` outside the held-out fold; `docs` may be other documents than the ones to score."""
    ws = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic")).where(_learned())
    known = ws.table(known)
    total = known.agg(F.count("*").alias("n"), F.avg("toxic").alias("share")).first()
    share = total["share"] or 0.0
    part = min(1.0, max_labelled / max(1, total["n"]))
    # about max_labelled small rows, so that they can be broadcast whatever the corpus
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) < F.lit(part) * (1 << 30))
    labelled = rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_signing, "doc_id bigint, toxic int, text string, signature bigint")
    # of near copies the first is enough: else the words of a much copied document look toxic
    labelled = labelled.groupBy("toxic", "signature").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("toxic", "x.text")
    lexicon = mine(ws.table(labelled), max_terms)
    if lexicon is None:
        return Model(None, None, share)

    features = ws.table(rows.mapInArrow(_feature_batches(lexicon), _FEATURES))
    said = F.when(F.col("toxic") == 1, TOXIC).when(F.col("toxic") == 0, CLEAN).otherwise(ABSTAIN) if annotators else F.lit(ABSTAIN)
    patterns = features.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes", said.cast("int").alias("label")).agg(F.count("*").alias("n"))
    model = fit_label_model(ws.table(patterns), min(max(share, 0.005), 0.5))

    # labelled rows and others of the learning folds, both of bounded number, with the label model's posteriors as targets
    others = features.where(_learned()).join(known, "doc_id", "left_anti")
    part = min(1.0, max_unlabelled / max(1, others.count()))
    others = others.where(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30)) < F.lit(part) * (1 << 30))
    taught = features.join(F.broadcast(drawn), "doc_id").withColumn("label", said.cast("int")).drop("toxic").unionByName(others.withColumn("label", F.lit(ABSTAIN)))
    taught = taught.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    x, target = np.empty((taught.num_rows, 5 + len(lexicon.hashes)), np.float32), np.empty(taught.num_rows)
    lo = 0
    for b in taught.to_batches(max_chunksize=1_000):
        hi = lo + b.num_rows
        x[lo:hi] = dense_features(lexicon, *_hits(b), b.column("n_words").to_numpy())
        target[lo:hi] = model.posterior(_unpacked(b.column("votes"), b.column("label").to_numpy()))
        lo = hi
    return Model(lexicon, fit_classifier(x, target), share, features)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row of `docs`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model.lexicon is None:
        return rows.select("doc_id", F.lit(float(model.share)).alias("score"))
    features = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_feature_batches(model.lexicon), _FEATURES)
    return features.mapInArrow(_scoring(model.lexicon, model.weights), "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, learned from the labelled ones among them."""
    model = fit(docs, labels, **options)
    if model.features is not None:  # of the same documents: no second pass over the texts
        scored = model.features.mapInArrow(_scoring(model.lexicon, model.weights), "doc_id bigint, score double")
    else:
        names = {k: options[k] for k in ("id_col", "text_col") if k in options}
        scored = score(docs, model, **names)
    return scored.select("doc_id", F.coalesce(~_learned(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _dropping(lexicon: Lexicon, weights: np.ndarray, text_at: int) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(text_at), CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                w = Words(part.column(text_at), ALNUM, lower=True)
                keep = dense_features(lexicon, *lexicon.hits(w), w.counts()) @ weights < 0
                yield part.filter(pa.array(keep))

    return run


def remove(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without those that score 0.5 or more; all columns unchanged."""
    if model.lexicon is None:
        return docs if model.share < 0.5 else docs.limit(0)
    return docs.mapInArrow(_dropping(model.lexicon, model.weights, docs.columns.index(text_col)), docs.schema)
