"""Occurrences of templates of every short length, whole and at a containment of 0.8: none may be missed."""

import random

import pyarrow as pa
import pytest

from voltrail.llm import license_scan
from voltrail.llm.text import ALNUM, Words


def occurrences(n_words, r, share):
    """A template and texts that hold it; with `share` under 1 some shingles go, from the end on."""
    own = [f"t{j}" for j in range(n_words)]
    s = n_words - license_scan.K + 1
    keep = n_words - (s - license_scan.fewest(s, share))
    out = []
    for _ in range(1_500):
        w = [f"w{r.randrange(10**9)}" for _ in range(120)]
        at = r.randrange(121)
        out.append(" ".join(w[:at] + own[:keep] + w[at:]))
    return " ".join(own), out


@pytest.mark.parametrize("share", [1.0, 0.8])
@pytest.mark.parametrize("n_words", [5, 6, 7, 8, 9, 12, 14, 21, 32])
def test_no_occurrence_is_missed(n_words, share):
    template, texts = occurrences(n_words, random.Random(n_words), share)
    index = license_scan.Index([("t", template)])
    found = {d for d, _, _ in index.scan(Words(pa.array(texts, pa.large_string()), ALNUM, lower=True))}
    # two windows of 2n, n apart: an occurrence over a block's edge lies whole in one of them, any other in one or two
    assert found == set(range(len(texts)))


def test_bands_hold_the_stated_chance():
    for n, own, tables, _ in license_scan.Index(list(license_scan.TEMPLATES)).groups:
        for _, s in own:
            need = license_scan.bands_for(len(s), n, license_scan.LEAST, license_scan.MISS)
            assert need > license_scan.MOST_BANDS or len(tables) >= need
