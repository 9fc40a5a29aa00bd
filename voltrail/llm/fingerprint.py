"""Document fingerprints: one-permutation MinHash in SQL functions only.

A text's shingles (`words` consecutive words; a shorter text is one shingle) are hashed
once to 64 bits. The upper bits choose one of `BINS` bins, whose smallest hash stays.
Optimal densification fills an empty bin with the value of a bin that its own sequence
of hashed probes comes to first: the same sequence in every text, whatever the text's
other bins, so bins of two texts are equal as often as their sets are alike. After
`PROBES` steps the sequence goes on over the full bins in the order of their hashes with
the empty one, so it always ends. Of each bin the `BITS` low-order bits are stored, packed
in 64-bit words. Chance makes 1 in 2**BITS different bins equal; `likeness` takes that out.

Bins come from one sort: a mark for each bin, above all hashes of its bin, is added to
the hashes; the first entry of each bin is its smallest hash, or the mark if it has none.

Words are runs of characters other than \\x20 and \\x09-\\x0D, A-Z lower-cased. Null and
empty texts and texts of blanks have no shingles: their fingerprint is empty, alike (1)
among themselves and unlike (0) all others. Texts of any length are one row each.

Neighbours are found in blocks of ids: windows over many small groups instead of one over
the table, then the blocks' last rows are joined with the next blocks' first ones. Rows
of equal id are ordered by their texts' hash; null ids come last, in blocks of that hash.
Whole copies are rows of their own. In a table of one row it is its own neighbour; an
empty table has no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.llm.workspace import Workspace, column

BINS, BITS, PROBES, WORDS = 256, 4, 16, 5
PER_WORD = 64 // BITS
#: Rows of a block of neighbours, about.
BLOCK = 256
#: Keys of blocks that one window orders; more are ordered in blocks of their own.
FEW_KEYS = 10_000
_FREE = 64 - (BINS - 1).bit_length()  # bits of a hash below its bin


def _added(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """`df` with the packed fingerprint of the column `text`: an array of longs, empty for a text without words."""
    blanks = " \t\n\x0b\f\r"
    clean = F.translate(F.btrim(F.col(text), F.lit(blanks)), string.ascii_uppercase, string.ascii_lowercase)
    d = _added(df, _words=F.when(F.length(clean) > 0, F.split(clean, r"[\x20\x09-\x0D]+")))
    n = F.size("_words")
    # in a text of fewer words the missing ones are null, which the hash passes over
    shingle = lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(words)))
    marks = F.array(*(F.lit(((k - BINS // 2) << _FREE) | ((1 << _FREE) - 1)) for k in range(BINS)))
    d = _added(d, _hashes=F.when(n > 0, F.sort_array(F.concat(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - words)), shingle), marks))))
    bin_of = lambda h: F.shiftright(h, _FREE)
    d = _added(d, _least=F.filter("_hashes", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("_hashes", i - 1)))))
    empty = (1 << _FREE) - 1
    low = (1 << BITS) - 1
    d = _added(d, _bins=F.transform("_least", lambda h: F.when(h.bitwiseAND(F.lit(empty)) != empty, h.bitwiseAND(F.lit(low)).cast("int"))))
    full = F.filter(F.transform("_bins", lambda v, i: F.when(v.isNotNull(), i * (low + 1) + v)), lambda v: v.isNotNull())
    d = _added(d, _full=full)

    def last(i: Column) -> Column:
        """The value of the full bin whose hash with bin i is smallest."""
        ranked = F.array_min(F.transform("_full", lambda v: F.xxhash64(i, F.shiftright(v, BITS)).bitwiseAND(F.lit(~low)).bitwiseOR(v.bitwiseAND(F.lit(low)).cast("long"))))
        return ranked.bitwiseAND(F.lit(low)).cast("int")

    probe = lambda i, j: F.get("_bins", F.pmod(F.xxhash64(F.lit(j), i), F.lit(BINS)).cast("int"))
    d = _added(d, _dense=F.transform("_bins", lambda v, i: F.coalesce(v, *(probe(i, j) for j in range(PROBES)), last(i))))
    word = lambda j: F.aggregate(F.slice("_dense", j * PER_WORD + 1, F.lit(PER_WORD)), F.lit(0).cast("long"), lambda s, v: F.shiftleft(s, BITS).bitwiseOR(v.cast("long")))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), word)
    return _added(d, **{name: F.coalesce(F.when(F.col("_dense").isNotNull(), packed), F.expr("cast(array() as array<bigint>)"))}).drop("_words", "_hashes", "_least", "_bins", "_full", "_dense")


def shown(fingerprint: Column) -> Column:
    """A fingerprint as a hexadecimal string, a digit for each bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles (Jaccard) of two fingerprints, 0 to 1, without the matches of chance."""
    ones = sum(1 << k for k in range(0, 64, BITS))
    ones -= (ones >> 63) << 64

    def differing(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        some = reduce(lambda s, k: s.bitwiseOR(F.shiftrightunsigned(bits, k)), range(1, BITS), bits)
        return F.bit_count(some.bitwiseAND(F.lit(ones).cast("long")))

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    estimate = (1 - unlike / F.lit(float(BINS)) - chance) / (1 - chance)
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either, (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def next_keys(keys: DataFrame, ws: Workspace, few: int = FEW_KEYS, block: int = BLOCK) -> DataFrame:
    """Of different keys (b, s), longs: each with the next one (b2, s2) in ascending order; null after the last."""
    order = ("b", "s")
    following = lambda w: [F.lead(c).over(w).alias(f"{c}2") for c in order]
    n = keys.count()
    if n <= few:
        return keys.select(*order, *following(Window.orderBy(*order)))
    # the same by blocks: a block's last key takes the first one of the next block
    grouped = keys.withColumn("g", _coarser(keys, n, block))
    inside = ws.table(grouped.select("g", *order, *following(Window.partitionBy("g").orderBy(*order))))
    firsts = inside.groupBy("g").agg(F.min(F.struct(*order)).alias("first"))
    after = next_keys(firsts.select(F.col("g").alias("b"), F.lit(0).cast("long").alias("s")), ws, few, block).select(F.col("b").alias("g"), F.col("b2").alias("g2"))
    joined = after.join(firsts.withColumnRenamed("g", "g2"), "g2", "left").select("g", "first")
    last = inside.where("b2 is null").join(joined, "g", "left").select(*order, F.col("first.b").alias("b2"), F.col("first.s").alias("s2"))
    return inside.where("b2 is not null").select(*order, "b2", "s2").unionByName(last)


def _width(low: int | None, high: int | None, n: int, block: int) -> int:
    """Ids to a block, for about `block` rows of n in [low, high]."""
    return min(1 << 62, max(1, -(-(high - low + 1) * block // n))) if n and low is not None else 1


def _coarser(keys: DataFrame, n: int, block: int) -> Column:
    low, high = keys.agg(F.min("b"), F.max("b")).first()
    return F.floor(F.col("b") / _width(low, high, n, block)).cast("long")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, packed and text2, packed2, those of the next row by descending id (after the last: the first), in two tables:
    rows whose neighbour is in their block of ids, and the blocks' last rows. Written, without the texts of the first table."""
    ws = Workspace(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    tie = F.xxhash64("text")
    # ascending keys are descending ids; the last key is that of null ids, in parts by their texts' hash
    of_id = -F.floor(F.col("doc_id") / _width(low, high, n, block)).cast("long")
    rows = rows.withColumns({"tie": tie, "b": F.coalesce(of_id, F.lit((1 << 63) - 1)), "s": F.when(F.col("doc_id").isNull(), F.shiftright(tie, 48)).otherwise(F.lit(0)).cast("long")})
    placed = with_fingerprint(rows, "text", "packed")
    inside = Window.partitionBy("b", "s").orderBy(F.desc_nulls_last("doc_id"), "tie", "text")
    placed = placed.withColumns({"text2": F.lead("text").over(inside), "packed2": F.lead("packed").over(inside), "first": F.lag(F.lit(True)).over(inside).isNull()})
    done = _compared(placed.withColumn("last", F.col("text2").isNull()))
    edge = F.col("first") | F.col("last")
    done = ws.table(done.withColumn("text", F.when(edge, F.col("text"))))
    keys = done.where("first").select("b", "s")
    found = next_keys(ws.table(keys), ws)
    start = keys.agg(F.min(F.struct("b", "s"))).first()[0] or (0, 0)
    found = found.select("b", "s", F.coalesce("b2", F.lit(start[0])).cast("long").alias("b2"), F.coalesce("s2", F.lit(start[1])).cast("long").alias("s2"))
    firsts = done.where("first").select(F.col("b").alias("b2"), F.col("s").alias("s2"), F.col("text").alias("text2"), F.col("packed").alias("packed2"))
    edges = done.where("last").select("doc_id", "text", "packed", "b", "s").join(found, ["b", "s"]).join(firsts, ["b2", "s2"])
    return done.where("not last"), _compared(edges)


def _compared(rows: DataFrame) -> DataFrame:
    """With n_chars, edited_sha256, packed_edited, near_edited, near_next."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = rows.withColumn("_edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("text2", F.lit(1), half)))
    d = with_fingerprint(d, "_edited", "packed_edited")
    d = d.withColumns(
        {"n_chars": n.cast("long"), "edited_sha256": F.sha2("_edited", 256), "near_edited": likeness(F.col("packed"), F.col("packed_edited")), "near_next": likeness(F.col("packed"), F.col("packed2"))}
    )
    return d.drop("_edited", "text2", "packed2")


def digest(docs: DataFrame, **names: object) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs`."""
    out = ["doc_id", "n_chars", "edited_sha256", shown(F.col("packed")).alias("fingerprint"), shown(F.col("packed_edited")).alias("edited_fingerprint"), "near_edited", "near_next"]
    inner, edges = beside_next(docs, **names)
    return inner.select(*out).unionByName(edges.select(*out))
