"""The corpus pipeline: five stages over documents, each written as Parquet and reread.

Toxic documents go; of each group of near copies the one of the smallest id stays;
documents that hold a benchmark passage go; secrets are masked in the texts; the
rest is mixed to the sources' target weights, so documents may go or come several
times. A null id has no copies and stays as it is; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.llm import decontamination, mixing, ngram_join, secret_scan, toxicity
from voltrail.llm.workspace import Workspace, read

#: Ids up to which the join that takes copies out is a broadcast; beyond, it shuffles.
BROADCAST_IDS = 200_000
#: Near copies: sets of 5-word shingles of Jaccard similarity 0.8 or more (op1's query has limits of its own).
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = ngram_join.join(docs, k=SHINGLE, percent=PERCENT)
    copies = Workspace(spark).table(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct())
    few = copies.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(copies) if few else copies, docs["doc_id"] == copies["copy_id"], "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask(docs, secret_scan.train(secret_scan.samples(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
]
#: A trained classifier and a network of character chances have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ws = Workspace(spark)
    for _, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir))
    return docs
