"""Decontamination gives the same rows whatever the size of its blocks."""

import pytest

from voltrail.llm import decontamination


def words(name, n):
    return " ".join(f"{name}{j}" for j in range(n))


ITEMS = [("a", words("a", 30)), ("b", words("b", 12).replace(" ", "\n")), ("c", words("c", 25).replace(" ", "-")), ("d", "short item"), ("e", "")]
DOCS = [
    (None, "x " + words("a", 30)), (None, "y " + words("b", 12)), (None, "clean"), (None, None), (1, words("c", 14)), (1, words("c", 14)), (1, "other text"),
    (2, words("a", 15) + " " + words("c", 25) + " a short item"), (3, ""), (4, words("a", 9)),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in DOCS], "doc_id long, text string, row string").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id string, text string").coalesce(1)


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("limit", [1, 12, 20])
def test_rows_stay_rows_with_several_blocks(tables, limit):
    docs, bench = tables
    want = plain(decontamination.scan(docs, bench))
    assert len(want) == len(DOCS)
    assert plain(decontamination.scan(docs, bench, block_windows=limit)) == want
    kept = decontamination.remove(docs, bench, block_windows=limit)
    assert kept.columns == docs.columns
    assert plain(kept) == plain(decontamination.remove(docs, bench))


def test_blocks_hold_no_more_words_than_told(tables):
    for limit in (12, 20):
        blocks = list(decontamination._blocks(tables[1], "item_id", "text", 10, limit))
        assert len(blocks) > 1
        assert all(sum(len(decontamination._WORD.findall(t)) for _, t in b) <= limit for b in blocks)
