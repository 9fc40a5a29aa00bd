"""Vocabulary files that the whole-token shortcut can't count are refused."""

import json

import pytest

from voltrail.llm import token_count


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_kinds_are_refused(name):
    with pytest.raises(ValueError):
        token_count.prove(token_count.vocabulary_path(name))


def test_a_normaliser_is_refused(tmp_path):
    with open(token_count.vocabulary_path(), encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "v.json").write_text(json.dumps(told), encoding="utf-8")
    with pytest.raises(ValueError, match="byte-level"):
        token_count.prove(str(tmp_path / "v.json"))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, "")], "doc_id long, text string")
    out = sorted((tuple(r) for r in token_count.count_tokens(df).collect()), key=str)
    assert out == [(3, 0, 0, False), (3, 0, 0, False), (None, 3, 2, False), (None, 3, 2, False)]
