"""License scans: MinHash bands over overlapping text windows, exact shingle containment.

Templates are grouped by length. For a group of at most n words, a text is cut into
blocks of n words, and a window is two neighbouring blocks, so that any passage as
long as a template lies whole in a window. Each of some hash functions (bands) gives a
window its least shingle hash (from the blocks' minima); a template with the same one
is a candidate. A window holds at most 2n shingles, so one that holds c of a template's
s shingles, c at least `least` s, has a similarity of j >= c / (2n + s - c), and all of b
bands miss it with chance (1 - j)^b. Each group has as many bands as bring that to `miss`
or less for the worst of its templates. Templates that would need more than MOST_BANDS
(few shingles in a long window) are looked up by s - c + 1 of their shingles instead, of
which such a window holds one: these are never missed. Each candidate is verified: at
least `least` of the template's shingles (five words, letters A-Z lower-cased) are in the
window.

Templates are a table of bounded size, read behind a check; one of fewer than five words
has no shingle, so it is refused. Null and empty texts hold none; texts of fewer than five
words neither; an empty table of templates is found nowhere. Repeated rows are scanned each; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.llm.text import ALNUM, HashSet, U, Words, chunks, fits, mix, rolling

K, LEAST, MISS, RATIO = 5, 0.8, 1e-6, 1.5
MOST_BANDS = 64
MOST_TEMPLATES = 20_000
#: Notices of common public licences, and whole texts of short ones.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-3-clause-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense-text",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)
_MAX = np.iinfo(np.uint64).max
_FACTORS = mix(np.arange(1, 257, dtype=np.uint64)) | U(1)


def fewest(s: int, least: float) -> int:
    """Shingles of a template of s that a window holds at least, if it holds the template."""
    return max(1, math.ceil(least * s - 1e-9))


def bands_for(s: int, n: int, least: float, miss: float) -> float:
    """Bands that miss a template of s shingles with chance `miss` at most, in a window of 2n."""
    c = fewest(s, least)
    j = c / (2 * n + s - c)
    return math.ceil(math.log(miss) / math.log1p(-j)) if j < 1 else 1


class Index:
    """Templates by group of lengths: their shingles, and which have a given least hash in each band, or a given shingle."""

    def __init__(self, templates: list[tuple[str, str]], k: int = K, least: float = LEAST, miss: float = MISS):
        self.k, self.least = k, least
        w = Words(pa.array([t for _, t in templates], pa.large_string()), ALNUM, lower=True)
        g = rolling(w.hash, k)
        groups: dict[int, list[tuple[str, np.ndarray]]] = {}
        for i, (name, _) in enumerate(templates):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a < k:
                raise ValueError(f"template {name} has fewer than {k} words")
            n = k
            while n < b - a:
                n = int(n * RATIO) + 1
            groups.setdefault(n, []).append((name, np.unique(g[a : b - k + 1])))
        self.groups = []
        for n, own in sorted(groups.items()):
            need = [bands_for(len(s), n, least, miss) for _, s in own]
            hashed = [j for j, x in enumerate(need) if x <= MOST_BANDS]
            tables = []
            for f in _FACTORS[: max((need[j] for j in hashed), default=0)]:
                by: dict[int, list[int]] = {}
                for j in hashed:
                    by.setdefault(int((own[j][1] * f).min()), []).append(j)
                tables.append((HashSet(np.array(list(by), np.uint64)), by))
            single: dict[int, list[int]] = {}
            held = Counter(x for _, s in own for x in s.tolist())
            for j in sorted(set(range(len(own))) - set(hashed)):
                s = sorted(own[j][1].tolist(), key=lambda x: (held[x], x))  # the rarest
                for x in s[: len(s) - fewest(len(s), least) + 1]:
                    single.setdefault(x, []).append(j)
            self.groups.append((n, own, tables, (HashSet(np.array(list(single), np.uint64)), single)))

    def scan(self, w: Words) -> Iterator[tuple[int, str, float]]:
        """(document, template, share of its shingles) of each window that holds one."""
        g = np.where(fits(w.first, len(w.hash), self.k), rolling(w.hash, self.k), U(0))
        valid = fits(w.first, len(w.hash), self.k)
        count = w.counts()
        for n, own, tables, (singles, single) in self.groups:
            blocks = -(-count // n)
            total = int(blocks.sum())
            if not total:
                continue
            doc = np.repeat(np.arange(len(count)), blocks)
            before = np.cumsum(blocks) - blocks
            place = np.arange(total) - np.repeat(before, blocks)
            start = w.first[doc] + place * n
            paired = np.append(doc[1:] == doc[:-1], False)
            seen: set[tuple[int, int]] = set()

            def verified(i: int, near: list[int]) -> Iterator[tuple[int, str, float]]:
                for j in near:
                    if (i, j) in seen:
                        continue
                    seen.add((i, j))
                    lo, hi = int(start[i]), min(int(start[i]) + 2 * n, int(w.first[doc[i] + 1]))
                    share = float(np.isin(own[j][1], g[lo:hi][valid[lo:hi]]).mean())
                    if share >= self.least:
                        yield int(doc[i]), own[j][0], share

            for f, (known, by) in zip(_FACTORS, tables):
                low = np.minimum.reduceat(np.where(valid, g * f, _MAX), start)
                window = np.where(paired, np.minimum(low, np.append(low[1:], U(_MAX))), low)
                at, which = known.find(window)
                for i, v in zip(at.tolist(), known.values[which].tolist()):
                    yield from verified(i, by[v])
            at, which = singles.find(g)
            at, which = at[valid[at]], which[valid[at]]
            d = w.doc_of(at)
            block = before[d] + (at - w.first[d]) // n
            for i, v in zip(block.tolist(), singles.values[which].tolist()):
                if i and doc[i - 1] == doc[i]:
                    yield from verified(i - 1, single[v])
                yield from verified(i, single[v])


def _scanning(index: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(1)):
                found: list[dict[str, float]] = [{} for _ in range(hi - lo)]
                for d, name, share in index.value.scan(Words(b.column(1)[lo:hi], ALNUM, lower=True)):
                    found[d][name] = max(share, found[d].get(name, 0.0))
                names = [sorted(x) for x in found]
                best = pa.array([max(x.values(), default=0.0) for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), best], names=["doc_id", "n_licenses", "licenses", "containment"])

    return run


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table(dict(zip(("name", "text"), zip(*TEMPLATES)))))


def scan(docs: DataFrame, known: DataFrame | None = None, least: float = LEAST, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted), containment (the best share) for every row of `docs`."""
    spark = docs.sparkSession
    rows = (known if known is not None else templates(spark)).where("name is not null and text is not null").select("name", "text").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    index = spark.sparkContext.broadcast(Index([(r["name"], r["text"]) for r in rows], least=least, miss=miss))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_scanning(index), "doc_id bigint, n_licenses bigint, licenses array<string>, containment double")
