"""Mixing sources to target weights.

Sizes are summed per source; each source's target share is its weight's, stopped
at `cap` times its own size, the excess going to the others by weight until none
is above. That fixed point has a closed form: with sources in order of
cap*size/weight, a source is stopped exactly when its ratio is at most the level
that the sources from it onwards would share. A source's rate is target / size;
each document is emitted floor(rate) times plus one copy when a hash of its id and
text, read as a number in [0, 1), is below the fraction.

Texts are read once for the sizes and draws, which are written; rates and results
come from that table.

Nulls: a null text has size 0; a null source is a source of its own, the last; null
ids draw by their texts. Sources of size 0 get target 0. Rows of one id with different
texts draw on their own; rows equal in both are separate documents that draw alike.
Empty tables give empty results. Extra columns stay, whatever their names, where
`emit` returns rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrail.llm.workspace import Workspace, column

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Sources up to which the rates are broadcast; more of them are joined by shuffle.
BROADCAST_SOURCES = 50_000


def size_column(text: F.Column) -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    cut = F.split(text, r"[\x20\x09-\x0D]+", -1)
    empty = F.when(F.get(cut, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(cut) - empty).cast("long")


def rates(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size): one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("w", F.get(cycle, (F.row_number().over(in_order) - 1) % len(weights)))
    per = per.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = total - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("w").over(onwards))
    per = per.withColumn("stopped", F.col("ratio") <= F.col("level"))
    rank = F.struct("ratio", F.col("source").isNull().alias("unnamed"), "source", "level")
    level = F.min(F.when(~F.col("stopped"), rank)).over(Window.partitionBy())["level"]
    target = F.when(F.col("stopped"), F.lit(cap) * F.col("source_size")).otherwise(F.col("w") * level)
    per = per.withColumn("target", target.cast("double"))
    return per.select("source", "source_size", "target", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("rate"))


def draw(key: F.Column, text: F.Column, seed: str = "mix") -> F.Column:
    """A number in [0, 1) from the key (null: none) and the text (null: empty)."""
    told = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: F.Column, u: F.Column) -> F.Column:
    """floor(rate) copies and one more with probability of the fraction, decided by u."""
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("long")


def _rated(rows: DataFrame, rate: DataFrame, source: str, of: str) -> DataFrame:
    """`rows` with their source's rate."""
    rate = rate.withColumnRenamed("source", of)
    few = rate.count() <= BROADCAST_SOURCES
    # beyond the bound the join shuffles by source, and adaptive execution splits a hot source
    return rows.join(F.broadcast(rate) if few else rate, rows[source].eqNullSafe(rate[of]))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken."""
    ws, text = Workspace(docs.sparkSession), column(text_col)
    rows = ws.table(docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), size_column(text).alias("size"), draw(column(id_col), text).alias("u")))
    both = _rated(rows, ws.table(rates(rows.select("source", "size"), weights, cap)), "source", "of")
    out = both.withColumn("copies", copies(F.col("rate"), F.col("u"))).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken")


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every document as many times as its source's rate says, columns unchanged."""
    ws, text = Workspace(docs.sparkSession), column(text_col)
    per = docs.select(column(source_col).alias("source"), size_column(text).alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    rate = ws.table(rates(per, weights, cap).select("source", "rate"))
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(source_col).alias("source"), draw(column(id_col), text).alias("u"))
    n = copies(F.col("rate"), F.col("u"))
    times = _rated(rows, rate, "source", "of").where(n > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy"))
    return times.select("row.*")
