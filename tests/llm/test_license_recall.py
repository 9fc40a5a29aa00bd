"""Licences in edited texts against containment in the whole text, without windows or bands."""

import random
import re

import pytest

from voltrail.llm import license_scan

WORD = re.compile(r"[a-z0-9]+")


def grams(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def edited(r, text, rate):
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < rate else w for w in text.split())


@pytest.fixture(scope="module")
def outcome(spark):
    r = random.Random(4)
    filler = lambda: " ".join(f"w{r.randrange(5_000)}" for _ in range(r.randrange(400)))
    rows, rates = [], (0.0, 0.01, 0.02, 0.03, 0.04)
    for rate in rates:
        for _ in range(25):
            for _, t in license_scan.TEMPLATES:
                rows.append((len(rows), rate, f"{filler()} {edited(r, t, rate)} {filler()}"))
    rows += [(len(rows) + k, 0.0, filler()) for k in range(100)]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    found = {x["doc_id"]: set(x["licenses"]) for x in license_scan.scan(df).collect()}
    own = {name: grams(t) for name, t in license_scan.TEMPLATES}
    out = {}
    for i, rate, t in rows:
        have = grams(t)
        want = {name for name, s in own.items() if len(s & have) >= 0.8 * len(s)}
        n = out.setdefault(rate, [0, 0, 0])
        n[0] += len(want)
        n[1] += len(want & found[i])
        n[2] += len(found[i] - want)
    return out


def test_recall_at_each_rate_of_edits(outcome):
    print({k: (w, round(h / w, 4)) for k, (w, h, _) in outcome.items()})
    assert all(w > 50 and h >= 0.99 * w for w, h, _ in outcome.values())


def test_nothing_else_is_found(outcome):
    assert all(extra == 0 for _, _, extra in outcome.values())


def test_templates_without_a_shingle_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    known = spark.createDataFrame([("short", "a b c")], "name string, text string")
    with pytest.raises(ValueError, match="fewer than 5 words"):
        license_scan.scan(docs, known)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, None), (1, "")], "doc_id long, text string")
    known = spark.createDataFrame([], "name string, text string")
    assert sorted(x["n_licenses"] for x in license_scan.scan(docs, known).collect()) == [0, 0, 0]
    assert license_scan.scan(docs.limit(0)).collect() == []
