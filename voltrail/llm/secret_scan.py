"""Secret scans by character Markov models, in SQL functions only.

Three base patterns find assignments, access keys and long hex strings. Besides,
every run of at least `min_run` key characters that no base span covers is a
candidate: two first-order Markov models over its characters, one of random
strings and one of ordinary identifiers, give a log-likelihood ratio, and runs
that are likelier random by `margin` nats are secrets of the kind `markov`.

The models are trained from labelled samples (text, is_random, n times). `samples`
makes them from a whole corpus: the values of base matches and digests of numbers
are random; words, alone and joined with themselves as identifiers are, are
ordinary. Words are counted first, so only different ones are spelled out. The
counts of character pairs fit one small table whatever the corpus.

Places come from lengths: the pieces between matches (split) and the matches
(regexp_extract_all) alternate, so running sums of their lengths are the spans,
in code points. A text of n matches takes n^1.5 additions and a fixed number of
passes over it; texts are searched for a pattern only where a cheaper test allows it.

Null texts count as empty and have no spans. Repeated rows are scanned each.
Empty tables give empty results; without any sample no run is a secret of the
kind `markov`. `mask` keeps extra columns; names of its own never clash, as it
replaces only the text and the column that holds its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.workspace import Workspace, column, free_name

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns. Runs are greedy, so a least length in the pattern finds the same spans.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
LEAST_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N_CHARACTERS = len(CHARACTERS)
_KINDS_OF = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in CHARACTERS]
BACK_OFF, LEAST_BACK_OFF = 50, 0.1
_ANY_RUN = r"[A-Za-z0-9+/_=-]{%d}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
MIN_RUN = 20
PIECE = 4_096  # code points of the pieces that a text is masked in
MARGIN = 12.0
SAMPLE_DIGESTS = 4_000
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; lambdas would compute it anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima... of an array of int from 0 on, in blocks of about its length's root: no step copies what came before."""
    whole = lambda a: F.aggregate(a, F.lit(0), step)

    def run(v: Column) -> Column:
        n = F.size(v)
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), block), lambda lo: F.slice(v, lo + 1, block))
        return _let(parts, lambda p: _let(F.transform(p, whole), lambda sums: F.flatten(F.transform(p, lambda part, k: _after(part, whole(F.slice(sums, F.lit(1), k)))))))

    def _after(part: Column, before: Column) -> Column:
        return _let(before, lambda x: F.transform(part, lambda _, i: F.aggregate(F.slice(part, F.lit(1), i + 1), x, step)))

    return _let(values, run)


def _sum(s: Column, x: Column) -> Column:
    return s + x


def _matches(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<start, end, g<k>...>> of a pattern's matches; null where there are none."""
    kept = [0, *groups]
    gap = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = F.struct(gap.alias("gap"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in kept))

    def spans(f: Column) -> Column:
        lengths = F.zip_with(F.slice(f["gap"], F.lit(1), F.size(f["g0"])), f["g0"], lambda g, m: g + F.char_length(m))
        zipped = F.arrays_zip(_running(lengths, _sum).alias("end"), *(f[f"g{k}"].alias(f"g{k}") for k in kept))
        return F.transform(zipped, lambda s: F.struct((s["end"] - F.char_length(s["g0"])).alias("start"), s["end"].alias("end"), *(s[f"g{k}"].alias(f"g{k}") for k in kept)))

    return F.when(text.rlike(pattern), _let(found, spans))


def _named(matches: Column, kind: int) -> Column:
    spans = F.transform(matches, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.coalesce(spans, F.array()).cast(_SPANS)


def _index(a: Column, b: Column) -> Column:
    """The place of a pair of characters in the table; -1 where one has none."""
    return F.when((a > 0) & (b > 0), (a - 1) * N_CHARACTERS + b - 1).otherwise(-1)


def _pairs(text: Column) -> Column:
    """The character pairs of a run as indexes into the table; -1 where a character has no place in it."""
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(CHARACTERS), c))
    return _let(places, lambda at: F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at)), _index))


def _may_assign(text: Column) -> Column:
    """Cheap, and true of every text that holds an assignment."""
    return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text, is_random, n: labelled samples from all documents of a corpus and from digests."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = spark.range(SAMPLE_DIGESTS).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    coded = F.base64(F.unhex("d"))
    made = digest.select(F.explode(F.array("d", coded, F.translate(coded, "+/=", "-_"), F.regexp_replace(coded, "[+/=]", ""), F.upper(F.substring(F.regexp_replace(coded, "[+/=]", ""), 1, 20)))).alias("text"))
    values = texts.where(_may_assign(F.col("text"))).select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("text")).where(F.char_length("text") >= 16)
    numbers = spark.range(SAMPLE_DIGESTS).select(F.explode(F.array(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), F.concat(F.lit("v"), F.col("id").cast("string")), F.repeat(F.lit("-"), 12), F.repeat(F.lit("="), 12), F.repeat(F.lit("_"), 12))).alias("text"))
    once = lambda df, is_random: df.select("text", F.lit(is_random).alias("is_random"), F.lit(1).cast("long").alias("n"))
    return once(made.unionByName(values), True).unionByName(_identifiers(texts)).unionByName(once(numbers, False))


def _identifiers(texts: DataFrame) -> DataFrame:
    """text, is_random, n: each different word of all documents, and the character pairs of identifiers that join it with itself."""
    text = F.col("text")
    some = _may_assign(text) | F.contains(text, F.lit("AKIA")) | text.rlike(HEX)
    plain = F.when(some, F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " ")).otherwise(text)
    words = F.array_remove(F.split(plain, "[^A-Za-z]+"), "")
    # read twice below, so written once
    counts = Workspace(texts.sparkSession).table(texts.select(F.explode(words).alias("text")).groupBy("text").agg(F.count("*").alias("n")))
    return counts.unionByName(_joined(counts)).select("text", F.lit(False).alias("is_random"), "n")


def _joined(counts: DataFrame) -> DataFrame:
    """text (two characters), n: the pairs of `w_w-lower/CapitalCapital=UPPER_UPPER` of each word w, from few counts of its own pairs and ends."""
    w, size = F.col("text"), F.char_length("text")
    told = lambda kind, two: F.struct(kind.alias("kind"), two.alias("two"))
    places = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    inner = F.transform(places, lambda i: told(F.when(i == 1, "first").otherwise("later"), w.substr(i, F.lit(2))))
    ends = told(F.when(size == 1, "letter").otherwise("ends"), F.concat(F.substring(w, 1, 1), F.substring(w, -1, 1)))
    few = counts.select("n", F.explode(F.concat(inner, F.array(ends))).alias("x")).groupBy("x.kind", "x.two").agg(F.sum("n").alias("n"))
    two, kind = F.col("two"), F.col("kind")
    a, z = F.substring(two, 1, 1), F.substring(two, 2, 1)
    capital_end = F.when(kind == "letter", F.upper(z)).otherwise(z)
    times = lambda *of: F.array(*(F.struct(t.alias("text"), F.lit(k).alias("times")) for t, k in of))
    cased = ((F.lower(two), 1), (F.upper(two), 2))
    lit = F.lit
    seams = [(z, lit("_")), (lit("_"), a), (z, lit("-")), (lit("-"), F.lower(a)), (F.lower(z), lit("/")), (lit("/"), F.upper(a)), (capital_end, F.upper(a)), (capital_end, lit("=")), (lit("="), F.upper(a)), (F.upper(z), lit("_")), (lit("_"), F.upper(a))]
    of_kind = F.when(kind == "later", times((two, 4), *cased)).when(kind == "first", times((two, 2), (F.concat(F.upper(a), z), 2), *cased))
    of_kind = of_kind.otherwise(times(*((F.concat(x, y), 1) for x, y in seams)))
    return few.select("n", F.explode(of_kind).alias("x")).select("x.text", (F.col("n") * F.col("x.times")).alias("n"))


def train(labelled: DataFrame) -> list[float]:
    """The table of log P(random) - log P(ordinary) of each character pair."""
    text = F.col("text")
    two = F.transform(F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: text.substr(i, F.lit(2)))
    pairs = labelled.where(F.char_length(text) > 1).select("is_random", "n", F.explode(two).alias("two")).groupBy("is_random", "two").agg(F.sum("n").alias("n"))
    place = lambda k: F.instr(F.lit(CHARACTERS), F.substring("two", k, 1))
    pairs = pairs.select("is_random", "n", _index(place(1), place(2)).alias("pair")).where("pair >= 0")
    counts = {True: [0] * N_CHARACTERS**2, False: [0] * N_CHARACTERS**2}
    for r in pairs.collect():  # at most two for each pair of characters in the table
        counts[r["is_random"]][r["pair"]] = r["n"]
    if not any(counts[True]) or not any(counts[False]):
        return [-1.0] * N_CHARACTERS**2

    size = {k: sum(c == k for c in _KINDS_OF) for k in set(_KINDS_OF)}

    def logs(n: list[int]) -> list[float]:
        # a pair never seen falls back on how often its kinds of characters follow each other
        kinds = {(a, b): 0.5 for a in size for b in size}
        for i, x in enumerate(n):
            kinds[_KINDS_OF[i // N_CHARACTERS], _KINDS_OF[i % N_CHARACTERS]] += x
        out = []
        for a in range(N_CHARACTERS):
            row = n[a * N_CHARACTERS : (a + 1) * N_CHARACTERS]
            of_kind = sum(kinds[_KINDS_OF[a], k] for k in size)
            own = sum(row) / (sum(row) + BACK_OFF)
            for b, x in enumerate(row):
                back = kinds[_KINDS_OF[a], _KINDS_OF[b]] / of_kind / size[_KINDS_OF[b]]
                out.append(math.log((1 - LEAST_BACK_OFF) * own * x / max(1, sum(row)) + (1 - (1 - LEAST_BACK_OFF) * own) * back))
        return out

    return [round(r - o, 6) for r, o in zip(logs(counts[True]), logs(counts[False]))]


def ratio(text: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a run."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    return F.aggregate(_pairs(text), F.lit(0.0), lambda s, p: s + F.coalesce(F.get(values, p), F.lit(0.0)))


def scan(docs: DataFrame, table: list[float], min_run: int = MIN_RUN, margin: float = MARGIN, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """`docs` with a column of spans (start, kind, end), in order; kind is an index into KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = free_name("long", [*docs.columns, spans_col])
    # a long hex string lies in a run of key characters
    docs = docs.withColumn(long, text.rlike(_ANY_RUN % min(min_run, 32)))
    assign = F.when(_may_assign(text), _matches(text, ASSIGN, 2))
    base = F.concat(
        _named(F.filter(assign, lambda s: F.char_length(s["g2"]) >= LEAST_VALUE), 0),
        _named(_matches(text, ACCESS), 1),
        _named(F.when(F.col(long), _matches(text, HEX)), 2),
    )
    with_base = docs.withColumn(spans_col, F.array_sort(base))
    own = F.col(spans_col)
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own))).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(own) - 1), block), lambda lo: F.slice(own, lo + 1, block))
    hulls = F.transform(parts, lambda p: F.struct(F.array_min(p["start"]).alias("start"), F.array_max(p["end"]).alias("end"), p.alias("spans")))
    meets = lambda s: lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    runs = F.when(F.col(long), _matches(text, RUN % min_run))
    free = _let(hulls, lambda h: F.filter(runs, lambda s: ~F.exists(h, lambda x: meets(s)(x) & F.exists(x["spans"], meets(s))) & (ratio(s["g0"], table) >= margin)))
    return with_base.withColumn(spans_col, F.array_sort(F.concat(own, _named(free, 3)))).drop(long)


def digest(scanned: DataFrame, id_col: str = "doc_id", spans_col: str = "secrets") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    names = F.array(*map(F.lit, KINDS))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(spans_col, lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col(id_col).alias("doc_id"), *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(told(F.filter(spans_col, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), told(F.col(spans_col)).alias("spans"),
    )


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """A part of a text, which comes in pieces of PIECE code points, so that no cut reads the text from its begin."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    return F.when(end > start, F.array_join(F.slice(pieces, first + 1, last - first + 1), "").substr(start % PIECE + 1, end - start)).otherwise("")


def mask(docs: DataFrame, table: list[float], by: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every span of a secret replaced; other columns as they were."""
    spans_col = free_name("secrets", docs.columns)
    found = scan(docs, table, text_col=text_col, spans_col=spans_col)
    text, spans = F.col(text_col), F.col(spans_col)
    # spans of different kinds may overlap: one that starts before an earlier one's end adds nothing of its own
    at, ends = F.transform(spans, lambda x: x["end"]), lambda a: F.concat(F.array(F.lit(0)), _running(a, lambda s, x: F.greatest(s, x)))

    def whole(b: Column) -> Column:
        def piece(x: Column, before: Column) -> Column:
            return F.when(x["start"] >= before, F.concat(_cut(b, before, x["start"]), F.lit(by))).otherwise("")

        told = lambda e: F.concat(F.array_join(F.transform(spans, lambda x, i: piece(x, F.get(e, i))), ""), _cut(b, F.element_at(e, -1), F.char_length(text)))
        return _let(ends(at), told)

    whole = _let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), whole)
    masked = F.when(F.size(spans) > 0, whole).otherwise(text)
    out = found.withColumn(text_col, masked)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.size(spans_col) > 0, F.char_length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*map(column, docs.columns))
