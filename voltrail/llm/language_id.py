"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded;
bytes are mapped to classes (lower-cased letters, one class of digits, one of white
space, the rest as they are). Filters of several widths run over a window, each
filter keeps its maximum, and a softmax over the maxima gives the window's
languages. A text's are the means of its windows' log-probabilities, by the
letters they hold, so whole texts count whatever their length.

A filter's answer is a sum of one weight for each byte and place, so a filter
bank of width 2 is a table over pairs of classes, and wider ones are sums of
those: scoring is a few table look-ups for each byte.

The network is fitted on about `max_train` labelled rows, dealt evenly over all
languages (LEAST_ROWS of each at least, where it has them) and drawn by hash, with
at most `windows` windows from all over each text; every text is scored whole.

A null text, or one without a letter, gets `und` with score 0. Null languages
are never learned from; without any labelled row every text is `und`. A null id
is scored but not learned from. Repeated rows are scored each; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import CHUNK_BYTES, chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
MAX_TRAIN = 4_000
WINDOWS_PER_TEXT = 3
LEAST_ROWS = 20  # learned of each language, however many languages there are
EPOCHS = 6
UNKNOWN = "und"
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _classes() -> np.ndarray:
    """The class of each byte: 0 pads, 1 white space and controls, 2 digits, 3 other signs, then letters and high bytes."""
    c = np.full(256, 3, np.uint8)
    c[:0x21] = 1
    c[0x30:0x3A] = 2
    for k in range(26):
        c[[0x41 + k, 0x61 + k]] = 4 + k
    # continuation bytes by their six bits; leading bytes of the first blocks apart, later ones together
    c[0x80:0xC0] = 30 + np.arange(64)
    c[0xC0:0xE0] = 94 + np.arange(32) % 24
    c[0xE0:] = 118 + np.arange(32) % 10
    return c


CLASS = _classes()
N_CLASSES = 128
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True


def windows_of(data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a text's windows, padded, and the letters each holds."""
    n = max(1, -(-len(data) // window))
    out, letters = np.zeros(n * window, np.uint8), np.zeros(n * window, bool)
    out[: len(data)], letters[: len(data)] = CLASS[data], LETTER[data]
    return out.reshape(n, window), letters.reshape(n, window).sum(1)


@dataclass
class Network:
    """Filters by width: weights (width, classes, filters) and biases; then the softmax layer."""

    languages: list[str]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls(
            languages, [r.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, *self.biases, self.out, self.out_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's maximum over a window, and where it lies."""
        best, where = [], []
        for w, b in zip(self.filters, self.biases):
            size = x.shape[1] - len(w) + 1
            answer = w[0][x[:, :size]]
            for k in range(1, len(w)):
                answer += w[k][x[:, k : k + size]]
            at = answer.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(answer, at[:, None], 1)[:, 0] + b)
        return np.concatenate(best, 1), where

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, look-up tables over pairs of classes (and a single one for an odd last byte)."""
        out = []
        for w in self.filters:
            parts = [(w[k][:, None] + w[k + 1][None]).reshape(-1, FILTERS) for k in range(0, len(w) - 1, 2)]
            out.append([*parts, *([w[-1]] if len(w) % 2 else [])])
        return out

    def log_probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * N_CLASSES + x[:, 1:]
        best = []
        for w, b, parts in zip(self.filters, self.biases, tables):
            size = x.shape[1] - len(w) + 1
            answer = np.take(parts[0], pair[:, :size], 0)
            for k, t in enumerate(parts[1:], 1):
                answer += np.take(t, (pair if len(t) > N_CLASSES else x)[:, 2 * k : 2 * k + size], 0)
            best.append(answer.max(1) + b)
        z = np.maximum(np.concatenate(best, 1), 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Fits the network to windows x of languages y (indexes) by Adam on the cross-entropy."""
    net = Network.new(languages, seed)
    params = net.parameters()
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    r = np.random.default_rng(seed)
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            xb = x[at]
            z, where = net.pooled(xb)
            h = np.maximum(z, 0)
            s = h @ net.out + net.out_bias
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            s[np.arange(len(at)), y[at]] -= 1
            s /= len(at)
            dz = (s @ net.out.T) * (z > 0)
            grads: list[np.ndarray] = []
            for k, w in enumerate(net.filters):
                own = dz[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(w)
                for place in range(len(w)):
                    seen = np.take_along_axis(xb, where[k] + place, 1)
                    np.add.at(g[place], (seen, np.arange(FILTERS)[None].repeat(len(at), 0)), own)
                grads.append(g)
            grads += [dz[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [h.T @ s, s.sum(0)]
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate / (1 + step / 400)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def _sampling(windows: int) -> Task:
    """Windows of each text: the first, and others spread over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, packed = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                x, letters = windows_of(np.frombuffer(text.as_buffer(), np.uint8))
                full = np.flatnonzero(letters > 0)
                if len(full):
                    for i in sorted({int(full[k * (len(full) - 1) // max(1, windows - 1)]) for k in range(windows)}):
                        langs.append(lang)
                        packed.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(packed, pa.binary())], names=["lang", "x"])

    return run


def _learned(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, windows: int = WINDOWS_PER_TEXT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Learns from rows outside the held-out fold; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & _learned(id_col))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    # about as many rows of each language, so that a rare one is learned too
    each = max(LEAST_ROWS, max_train / len(sizes))
    part = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in sorted(sizes.items())], "lang string, part double")
    drawn = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit("lang")), F.lit(1 << 30)).alias("o"))
    drawn = drawn.join(F.broadcast(part), "lang").where(F.col("o") < F.col("part") * (1 << 30))  # a row for each language
    got = drawn.select("lang", "text").mapInArrow(_sampling(windows), "lang string, x binary").orderBy("lang", "x").toArrow()
    if not got.num_rows:
        return None
    languages = sorted(set(got.column("lang").to_pylist()))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.uint8).reshape(-1, WINDOW)
    place = {v: k for k, v in enumerate(languages)}
    y = np.array([place[v] for v in got.column("lang").to_pylist()])
    return train(x, y, languages)


def _scoring(net: Network | None) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for b in batches:
            for lo, hi in chunks(b.column("text"), CHUNK_BYTES):
                texts = b.column("text")[lo:hi]
                pred, score = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                xs, weights, owner = [], [], []
                for i, t in enumerate(texts):
                    if net is None or not t.is_valid or not (raw := t.as_buffer()).size:
                        continue
                    data = np.frombuffer(raw, np.uint8)
                    # only other scripts need their letters looked up
                    if not LETTER[data].any() or (data.max() >= 0x80 and not (LETTER[data] & (data < 0x80)).any() and not any(map(str.isalpha, t.as_py()))):
                        continue
                    x, letters = windows_of(data)
                    xs.append(x)
                    weights.append(letters + 0.01)
                    owner.append(np.full(len(x), i))
                if xs:
                    x, weight, own = (np.concatenate(a) for a in (xs, weights, owner))
                    logs = np.concatenate([net.log_probabilities(x[k : k + 128], tables) for k in range(0, len(x), 128)])
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    mean = np.add.reduceat(logs * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    score[own[first]] = p.max(1)
                    for i, k in zip(own[first].tolist(), best.tolist()):
                        pred[i] = net.languages[k]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row of `docs`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scoring(net), "doc_id bigint, lang_pred string, score double")


def classify(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`, learned from the labelled ones among them."""
    net = fit(docs, **options)
    names = {k: options[k] for k in ("id_col", "text_col") if k in options}
    scored = predict(docs, net, **names)
    return scored.select("doc_id", F.coalesce(~_learned("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
