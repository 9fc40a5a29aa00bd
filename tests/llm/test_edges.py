"""Null and repeated ids, repeated rows, empty tables and odd column names: defined results, no crash."""

import brute
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from voltrail.llm import decontamination, language_id, license_scan, mixing, ngram_join, queries, secret_scan, substring_dedup, token_count, toxicity
from voltrail.llm.workspace import read

LONG = " ".join(f"w{j}" for j in range(60))
ROWS = [(None, LONG), (None, LONG), (1, LONG), (1, LONG), (2, "token=0123456789abcdef0123456789abcdef"), (2, "other words"), (3, None), (None, None), (4, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).repartition(3)


@pytest.mark.parametrize("f", [ngram_join.join, token_count.count_tokens, mixing.mix, substring_dedup.dedup, license_scan.scan, language_id.classify])
def test_rows_stay_rows(odd, f):
    out = f(odd)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, _ in ROWS)
    assert f(odd.limit(0)).collect() == []


def test_rows_stay_rows_in_scans(spark, odd):
    table = [-1.0] * secret_scan.N_CHARACTERS**2
    bench = spark.createDataFrame([("a", LONG)], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    for out in (secret_scan.scan(odd, table), decontamination.scan(odd, bench), toxicity.classify(odd, labels)):
        assert out.count() == len(ROWS)
    assert {r["n_hit"] for r in decontamination.digest(decontamination.scan(odd, bench)).where("doc_id is null and n_words > 0").collect()} == {60}
    assert decontamination.scan(odd.limit(0), bench).collect() == secret_scan.scan(odd.limit(0), table).collect() == []


def test_null_and_repeated_keys_draw_on_their_own(spark):
    rows = [(None if k % 2 else 7, f"a b {k}", "x" if k % 4 < 2 else "y") for k in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["target"]: r["taken"] for r in out.groupBy("target").agg(F.sum("taken").alias("taken")).collect()}
    assert len(got) == 2
    assert all(taken == pytest.approx(target, rel=0.05) for target, taken in got.items())


def test_mixing_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a b c", f"s{k % 5}" if k % 7 else None) for k in range(200)], "doc_id long, text string, source string")
    want = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(docs).collect())) == want
    assert mixing.emit(docs).count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_items_without_id_mark_words(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "clean")], "doc_id long, text string")
    items = [(None, LONG), ("b", " ".join(LONG.split()[:12]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for limit in (decontamination.BLOCK_WINDOWS, 12):
        out = decontamination.digest(decontamination.scan(docs, bench, block_windows=limit))
        assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == brute.op5([(1, LONG), (2, "clean")], items)


@pytest.mark.parametrize("names", [("SECRETS", "a`b"), ("Secrets_", "a.b"), ("ROW", "copy")])
def test_odd_column_names_stay(spark, names):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(n, T.StringType()) for n in names)])
    docs = spark.createDataFrame([(1, 'token="0123456789abcdef0123456789abcdef"', "s", "p", "q"), (2, LONG, "s", "r", "t")], schema)
    masked = secret_scan.mask(docs, [-1.0] * secret_scan.N_CHARACTERS**2)
    bench = spark.createDataFrame([("a", "x y z"), ("b", "u v w")], "item_id string, text string")
    for out in (masked, mixing.emit(docs), decontamination.remove(docs, bench, block_windows=1)):
        assert out.columns == docs.columns
        assert {tuple(r)[3:] for r in out.collect()} == {("p", "q"), ("r", "t")}
    assert "[SECRET]" in masked.where("doc_id = 1").first()["text"]


def test_every_language_is_learned(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k % 230 // 26)} " * 30, f"l{k % 230}") for k in range(1150)]
    learned = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages
    assert len(learned) == 230


def test_pipeline_with_odd_rows(spark, small_dir, tmp_path):
    docs = read(spark, small_dir, "documents")
    more = spark.createDataFrame([(None, None), (None, ""), (None, LONG), (900_001, LONG), (900_002, LONG), (900_001, LONG), (900_003, "w " * 200_000)], "doc_id long, text string")
    more = more.withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")}).select(docs.columns)
    docs.unionByName(more).withColumn("SECRETS", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        read(spark, small_dir, t).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["SECRETS"] for r in out.select("SECRETS").distinct().collect()} == {"x"}
    assert out.where("doc_id = 900002").isEmpty()


def test_queries_have_distinct_operators():
    assert len(queries.queries()) >= 10
