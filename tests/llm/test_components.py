"""Components against a plain union of sets, with one partition and with many."""

import random

import brute
import pytest

from voltrail.llm import components as C
from voltrail.llm.workspace import Workspace


@pytest.mark.parametrize("part", [250_000, 20])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(C, "PART", part)
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    got = C.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark)).collect()
    want = brute.roots(sorted({i for x in links if x[0] != x[1] for i in x}), links)
    assert {x["vertex"]: x["component"] for x in got} == want
    assert len(got) == len(want)


def test_no_links(spark):
    assert C.components(spark.createDataFrame([], "a long, b long"), Workspace(spark)).count() == 0
