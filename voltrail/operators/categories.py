"""Categories by ordered target statistics.

A training row's category becomes the mean target of the rows of that category that
come before it in a fixed random order (by a hash of their keys), drawn towards the mean
of all rows before it. A row's own target never enters its value, so a model can't read the target
out of it. Rows that are scored take the mean over all training rows of their category.

A category may hold most rows: its rows are dealt to buckets of the order; sums of
the buckets are partial aggregates, their running sums are as many rows as a category has
buckets, and inside a bucket a window runs over few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, TargetEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.operators import selection

#: Rows that the mean of all rows counts for in a category's mean.
WEIGHT = 1.0
#: Rows of a bucket, about, and buckets at most of a category.
BUCKET_ROWS, MOST_BUCKETS = 10_000, 65_536


def named(text: str) -> str:
    return f"_{text}_target"


def encoders(texts: Sequence[str], target: str, weight: float = WEIGHT) -> list:
    """Pipeline stages that give each category its smoothed mean target; unknown ones get the mean of all rows."""
    indexed = [f"_{c}_i" for c in texts]
    index = StringIndexer(inputCols=list(texts), outputCols=indexed, handleInvalid="keep")
    return [index, TargetEncoder(inputCols=indexed, outputCols=[named(c) for c in texts], labelCol=target, targetType="continuous", smoothing=weight, handleInvalid="keep")]


def _before(rows: DataFrame, key: Column, y: Column, keys: Sequence[str], name: str) -> DataFrame:
    """`rows` with {name}_s and {name}_n: sum and number of the targets of `key` that come before a row."""
    out = rows.withColumn("_key", key)
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", *keys).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    per = out.groupBy(F.col("_key").alias("_c"), F.col("_bucket").alias("_b")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    per = per.select("_c", "_b", none(F.sum("s").over(earlier)).alias("_s"), none(F.sum("n").over(earlier)).alias("_n"))
    own = out.withColumns({"_sum": none(F.sum(y).over(inside)), "_count": F.count(y).over(inside)})
    joined = own.join(per, F.col("_key").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumns({f"{name}_s": F.col("_sum") + F.col("_s"), f"{name}_n": F.col("_count") + F.col("_n")}).drop("_key", "_c", "_b", "_s", "_n", "_sum", "_count")


def ordered(rows: DataFrame, texts: Sequence[str], target: str, keys: Sequence[str], weight: float = WEIGHT, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` (all with a target) with each text's statistic of the rows before; keys: what tells rows apart. The first row of all has 0."""
    buckets = max(1, min(MOST_BUCKETS, -(-rows.count() // bucket_rows)))
    width = -(-(1 << selection.BITS) // buckets)
    y = F.col(target).cast("double")
    out = rows.withColumn("_order", selection.hashed(keys, seed)).withColumn("_bucket", F.floor(F.col("_order") / width).cast("int"))
    out = _before(out, F.lit(0), y, keys, "_all")
    mean = F.coalesce(F.try_divide(F.col("_all_s"), F.col("_all_n")), F.lit(0.0))
    for c in texts:
        out = _before(out, F.col(c), y, keys, "_own")
        out = out.withColumn(named(c), (F.col("_own_s") + weight * mean) / (F.col("_own_n") + weight)).drop("_own_s", "_own_n")
    return out.drop("_order", "_bucket", "_all_s", "_all_n")
