"""Token counts by the whole-token shortcut.

Once, before the job, the vocabulary is checked: a string is "whole" when the
library encodes it, alone, to exactly one token. The whole strings (no more than
the vocabulary holds) are broadcast. A document is cut into
pre-tokens; a whole pre-token counts one without any merging, and only the rest
goes through the library's merges. Texts are taken in batches: pieces between
single spaces are the same many times over, so each batch counts its different
pieces once, and a bounded memo keeps them for the next.

Nulls count as empty text: 0 bytes, 0 tokens. Empty tables give empty results;
extra columns are not read; null and repeated ids are counted row by row. A very
long text is counted whole, alone in its batch. No shuffle: one pass over the texts.

The pattern that cuts pre-tokens is that of byte-level BPE without a normaliser;
`sound` reads the vocabulary file and refuses any other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import CHUNK_BYTES, chunks

#: The vocabulary's own pre-token pattern (public byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000  # pieces kept by a worker; then the memo starts again
#: Texts in which a cut before a single space could part what the pattern keeps together: white
#: space other than space and line feed, two spaces, a space after a line feed or at an end.
UNEVEN = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|  |\\n | \\n?$"
OUT = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sound(path: str) -> None:
    """Refuses a file whose texts are not cut by PATTERN and merged as they are."""
    try:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
    except ValueError as e:
        raise ValueError(f"{path} is not a tokenizers .json file") from e
    cut, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = not told.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not (plain and merges) or any(t.get(k) for t in told.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} is not plain byte-level BPE")


def _library(path: str) -> object:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def prove(path: str) -> frozenset[str]:
    """Strings that encode alone as one token, over the whole vocabulary."""
    sound(path)
    library = _library(path)
    texts = [library.decode([i], skip_special_tokens=False) for i in range(library.get_vocab_size())]
    codes = library.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, c in zip(texts, codes) if t and "\ufffd" not in t and len(c.ids) == 1)


class Counter:
    """Counts tokens of texts as `Tokenizer.encode(text, add_special_tokens=False)` does."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex

        self.library = _library(path)
        self.cut = regex.compile(PATTERN).findall
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(map(regex.escape, self.specials))).split if self.specials else None
        self.whole = whole
        self.memo: dict[str, int] = {}

    def merged(self, texts: list[str]) -> list[int]:
        """Tokens of texts without special strings: whole pre-tokens count one, others are merged."""
        n, rest, owner = [], [], []
        for i, text in enumerate(texts):
            tokens = self.cut(text)
            odd = [t for t in tokens if t not in self.whole]
            n.append(len(tokens) - len(odd))
            rest += odd
            owner += [i] * len(odd)
        for i, c in zip(owner, self.library.encode_batch(rest, add_special_tokens=False) if rest else ()):
            n[i] += len(c.ids)
        return n

    def known(self, pieces: list[str]) -> list[int]:
        """Tokens of different pieces, through the memo."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = [p for p in pieces if p not in memo]
        memo.update(zip(new, self.merged(new)))
        out = [memo[p] for p in pieces]
        for p in new:
            if len(p) > 64:
                del memo[p]
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; there are no nulls."""
        odd = pc.match_substring_regex(texts, UNEVEN)
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            parts = self.split(text) if self.split else [text]
            out[i] = len(parts) - 1 + sum(self.merged(parts))
        even = np.flatnonzero(~odd)
        if len(even):
            words = pc.split_pattern(texts.take(pa.array(even)), " ")
            first = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
            coded = words.flatten().dictionary_encode()
            code, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            spaced = np.array(self.known([" " + p for p in pieces]), np.int64)[code]
            begin, where = np.unique(code[first], return_inverse=True)
            bare = np.array(self.known([pieces[k] for k in begin.tolist()]), np.int64)[where]
            out[even] = np.add.reduceat(spaced, first) - spaced[first] + bare
        return out


@lru_cache(maxsize=2)
def counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def _counting(path: str, whole: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, whole.value)
        for b in batches:
            for lo, hi in chunks(b.column(1), 8 * CHUNK_BYTES):
                texts = b.column(1)[lo:hi].fill_null("")
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi].cast(pa.int64()), size, pa.array(c.count(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of `docs`."""
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))
    out = rows.mapInArrow(_counting(path, whole), OUT)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
