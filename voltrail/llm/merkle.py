"""Merkle dataset manifest: parents keep the concatenated hashes of their children.

A row's leaf is the sha256 (lowercase hex) of its columns, each `-` if null, else its
UTF-8 byte count, `:` and its value. Leaves are numbered in order within their group
by a sort over range partitions and running counts of these, so no group meets in one
task. Level by level, every `fan` consecutive nodes of a group (the last run may be
shorter) make a parent: its preimage is their hashes in order, its hash the preimage's.
The groups' tops, in order of the groups, make a tree in the same way; its top is the root.

A leaf's path is the list of its ancestors' preimages, each with the slot that the
path enters it by. Cutting the own 64 characters out of each preimage leaves the
siblings, the proof; splicing another hash into the slot and hashing, level by level,
folds a changed leaf to the root it would give. Paths come from above: each level
joins its parents' paths, so the joins shrink by `fan` from level to level.

Null columns are `-`; null groups are a group of their own, the first; null ids come
first in their group. Rows of equal group and id are ordered by their leaves; whole
copies are leaves of their own, and which of them is which makes no difference. Empty
texts are `0:`. An empty table has no rows; a single row is its own root, with an empty
proof. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.llm.workspace import Workspace, column

FAN, HEX = 8, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of counts per partition and group up to which they are broadcast; beyond, the join shuffles.
BROADCAST_COUNTS = 100_000
_STEP = "array<struct<preimage:string,slot:int>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """The sha256 of the values with their byte counts, `-` for nulls."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, ws: Workspace, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with idx, each row's place (from 0) in its group, and n, the group's rows; written."""
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = ws.table(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    per = placed.groupBy("part", group).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    parts = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = ws.table(per.select("part", group, (before - F.col("first")).alias("shift"), F.sum("rows").over(parts).alias("n")))
    per = F.broadcast(per) if per.count() <= BROADCAST_COUNTS else per
    return placed.join(per, ["part", group]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _parents(nodes: DataFrame, fan: int) -> DataFrame:
    """The level above: g, n, idx, preimage, hash; groups of one node are done."""
    run = F.floor(F.col("idx") / fan).cast("long")
    above = nodes.where("n > 1").groupBy("g", "n", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("children"))
    preimage = F.array_join(F.transform("children", lambda c: c["hash"]), "")
    above = above.select("g", F.ceil(F.col("n") / fan).cast("long").alias("n"), F.col("run").alias("idx"), preimage.alias("preimage"))
    return above.withColumn("hash", F.sha2("preimage", 256))


def _grown(leaves: DataFrame, ws: Workspace, fan: int) -> list[DataFrame]:
    """The levels above leaves of g, n, idx, hash, lowest first, each written."""
    levels, nodes = [], leaves.select("g", "n", "idx", "hash")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = ws.table(_parents(nodes, fan))
        levels.append(nodes)
        most = -(-most // fan)
    return levels


def _tops(leaves: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """g, hash of each group's last node."""
    out = leaves.where("n = 1").select("g", "hash")
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("g", "hash"))
    return out


def _pathed(leaves: DataFrame, levels: Sequence[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """`leaves` with the columns of `above` (g, path and more, a row for each group) and the path from each leaf upwards."""
    carried = [c for c in above.columns if c not in ("g", "path")]
    known: DataFrame | None = None
    for nodes in [*reversed(levels), leaves]:
        own = [c for c in nodes.columns if c not in ("g", "path", *carried)]
        out = nodes.where("n = 1").join(above, "g").select("g", *own, "path", *carried)
        if known is not None:
            parent = known.select("g", F.col("idx").alias("_run"), F.col("preimage").alias("_above"), F.col("path").alias("_path"), *carried)
            slot = (F.col("idx") % fan).cast("int")
            step = F.array(F.struct(F.col("_above").alias("preimage"), slot.alias("slot")))
            inner = nodes.where("n > 1").withColumn("_run", F.floor(F.col("idx") / fan).cast("long")).join(parent, ["g", "_run"])
            out = out.unionByName(inner.select("g", *own, F.concat(step, F.col("_path")).alias("path"), *carried))
        known = out
    return known


@dataclass
class Manifest:
    """The written levels (g, n, idx, preimage, hash), of the groups and of their tops, and every leaf with its path."""

    levels: list[DataFrame]
    top_levels: list[DataFrame]
    leaves: DataFrame


def manifest(leaves: DataFrame, order: Sequence[str] = ("doc_id",), group: str = "lang", fan: int = FAN) -> Manifest:
    """From rows with a `leaf`: these with subroot, root and path, an array of (preimage, slot) from below to the root."""
    ws = Workspace(leaves.sparkSession)
    # the empty key is the null group's, which is the first; strings compare by their bytes
    rows = leaves.withColumns({"g": F.coalesce(F.concat(F.lit("+"), column(group).cast("string")), F.lit("")), "hash": F.col("leaf")})
    rows = ws.table(numbered(rows, ws, "g", [*order, "leaf"]))
    levels = _grown(rows, ws, fan)
    tops = _tops(rows, levels).select(F.lit("").alias("g"), F.col("g").alias("of"), "hash")
    tops = ws.table(numbered(tops, ws, "g", ["of"]))
    top_levels = _grown(tops, ws, fan)
    root = _tops(tops, top_levels).select("g", F.col("hash").alias("root"), F.expr(f"cast(array() as {_STEP})").alias("path"))
    above = _pathed(tops, top_levels, root, fan).select(F.col("of").alias("g"), F.col("hash").alias("subroot"), "root", "path")
    return Manifest(levels, top_levels, _pathed(rows, levels, ws.table(above), fan).drop("g", "n", "idx", "hash"))


def siblings(path: Column) -> Column:
    """The proof: each step's other hashes, left to right, as one string a step."""
    return F.transform(path, lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), F.substr(s["preimage"], s["slot"] * HEX + HEX + 1)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives along a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), h, F.substr(s["preimage"], s["slot"] * HEX + HEX + 1)), 256))


def tampered_leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", every: int = 3) -> DataFrame:
    """id, group, leaf and tampered: the leaf with the text's A-Z lower-cased, where `every` divides the id's crc32 and a letter changes, else null."""
    values = {c: column(c) for c in columns}
    changed = lowered(values[text_col])
    picked = (F.crc32(column(id_col).cast("string")) % every == 0) & (changed != values[text_col])
    return docs.select(
        column(id_col).alias("doc_id"), column(group_col).alias("lang"), leaf_hash(list(values.values())).alias("leaf"),
        F.when(picked, leaf_hash([changed if c == text_col else v for c, v in values.items()])).alias("tampered"),
    )


def audit(docs: DataFrame, fan: int = FAN, **names: object) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs`."""
    known = manifest(tampered_leaves(docs, **names), fan=fan).leaves
    told = known.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return told.select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join(siblings(F.col("path")), ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
