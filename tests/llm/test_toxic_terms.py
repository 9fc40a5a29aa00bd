"""The lexicon holds the terms that tell most, however many commoner ones there are."""

import math
import random

import numpy as np
import pyarrow as pa

from voltrail.llm import toxicity
from voltrail.llm.text import ALNUM, Words


def labelled(n, seed=1):
    """Toxic texts share many common words with clean ones, and each holds one of a few telling words."""
    r = random.Random(seed)
    common, telling = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k}x" for k in range(400)], [f"zz{chr(98 + k)}ug" for k in range(12)]
    rows = []
    for k in range(n):
        words = r.sample(common, 60)
        rows.append((int(k % 10 == 0), " ".join([*words, r.choice(telling)] if k % 10 == 0 else words)))
    return rows, telling


def hashes(words):
    w = Words(pa.array([" ".join(words)], pa.large_string()), ALNUM, lower=True)
    return {int(h) for h in next(toxicity._terms(w))[0]}


def test_rare_telling_terms_are_mined(spark):
    for n in (1_000, 5_000):
        rows, telling = labelled(n)
        lexicon = toxicity.mine(spark.createDataFrame(rows, "toxic int, text string").repartition(4), max_terms=80)
        assert hashes(telling) <= {int(h) for h in lexicon.hashes}


def test_gains_are_those_of_plain_counts(spark):
    rows, _ = labelled(600, 4)
    lexicon = toxicity.mine(spark.createDataFrame(rows, "toxic int, text string").repartition(3), max_terms=10**6)
    size, held = [sum(t == y for t, _ in rows) for y in (0, 1)], {}
    for y, text in rows:
        for kind, (h, _) in enumerate(toxicity._terms(Words(pa.array([text], pa.large_string()), ALNUM, lower=True))):
            for x in set(h.tolist()):
                held.setdefault((x, kind), [0, 0])[y] += 1
    want = set()
    share = size[1] / sum(size)
    for (x, _), (c, t) in held.items():
        gain = 2 * (t * math.log(t / (t + c) / share) + (c * math.log(c / (t + c) / (1 - share)) if c else 0)) if t else 0
        if t >= toxicity.LEAST_TOXIC and t * size[0] > c * size[1] and gain >= toxicity.LEAST_GAIN:
            want.add(x)
    assert {int(h) for h in np.unique(lexicon.hashes)} == want


def test_one_class_has_no_terms(spark):
    assert toxicity.mine(spark.createDataFrame([(1, "a b")], "toxic int, text string")) is None
    assert toxicity.mine(spark.createDataFrame([(1, "a b"), (0, "a b"), (0, None), (1, "")], "toxic int, text string")) is None


def test_label_model_finds_planted_reliabilities():
    """Voters of known reliability, two of them copies of one: chances come out, and copies share one weight."""
    r = np.random.default_rng(0)
    n, voters = 20_000, toxicity.N_VOTERS
    truth = r.random(n) < 0.3
    votes = np.zeros((n, voters), np.int8)
    right = np.linspace(0.7, 0.95, voters)
    for k in range(voters):
        said = np.where(r.random(n) < right[k], truth, ~truth)
        votes[:, k] = np.where(r.random(n) < 0.3, toxicity.ABSTAIN, np.where(said, toxicity.TOXIC, toxicity.CLEAN))
    votes[:, 3] = votes[:, 4]
    model = toxicity.LabelModel(0.3)
    for _ in range(toxicity.ROUNDS):
        model.learn(model.statistics(votes, np.ones(n)))
    for k in (0, 10, voters - 1):
        toxic, clean = model.chance[1, k], model.chance[0, k]
        assert abs(toxic[toxicity.TOXIC] - 0.7 * right[k]) < 0.02 and abs(clean[toxicity.CLEAN] - 0.7 * right[k]) < 0.02
    assert max(model.share[3], model.share[4]) < 0.65 * np.median(np.delete(model.share, [3, 4]))
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97
