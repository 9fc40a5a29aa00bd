"""The queries opN_<name> over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.llm import decontamination, embedding_dedup, fingerprint, language_id, lexical_search, license_scan, merkle, mixing, ngram_join, secret_scan, substring_dedup, token_count, toxicity
from voltrail.llm.workspace import read

_WS = r"[^\x20\x09-\x0D]+"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"), "containment")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    table = secret_scan.train(secret_scan.samples(docs))
    return secret_scan.digest(secret_scan.scan(docs, table))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WS}')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per
), ratios AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios
), shared AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN 3.0::DOUBLE * source_size
    ELSE w * first_value(level) OVER (ORDER BY (ratio <= level), ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate FROM shared
), drawn AS (
  SELECT doc_id, size, source_size, target, rate, u
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
)
SELECT doc_id, size, source_size, target, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM drawn
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDY = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WS}'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
), c AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORDY}'), []) AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({_LOWER}, '{_WORDY}'), []) AS w FROM benchmark
), ip AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS x FROM ip
), dp AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n
), found AS (
  SELECT doc_id, p, n, item FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM dp) JOIN iw USING (n, x)
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM found) GROUP BY 1
), items AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id
), c AS (
  SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{_WS}'), []) AS w FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY x) AS least FROM win) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM again
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI JOIN gone USING (doc_id, k) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11_SQL = rf"""
WITH t AS (
  SELECT row, doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), c AS (
  SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM c
), q AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), f AS (
  SELECT row, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY term, docs
), x AS (
  SELECT row, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)) AS impact FROM f JOIN c USING (row), s
), r AS (
  SELECT item, any_value(item_id) AS item_id, row, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY item, row
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM r JOIN c USING (row) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""

#: Levels that a tree may have here: 8**7 leaves.
_DEPTH = 7


def _tree_sql(name: str, leaves: str) -> str:
    """{name}_p: g, idx, path (ancestors' siblings before and after the own place, from below) of `leaves` (g, idx, n, hash); {name}_top: g, hash."""
    levels = [f"{name}0 AS (SELECT g, idx, n, hash FROM {leaves})"]
    paths = [f"{name}_p{_DEPTH} AS (SELECT g, idx, CAST([] AS STRUCT(a VARCHAR, b VARCHAR)[]) AS path FROM {name}{_DEPTH})"]
    for k in range(_DEPTH):
        levels.append(f"{name}{k + 1} AS (SELECT g, idx // 8 AS idx, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY idx)) END AS hash FROM {name}{k} GROUP BY g, idx // 8, n)")
        around = "coalesce(string_agg(hash, '') OVER (PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN {}), '')"
        step = f"CASE WHEN n = 1 THEN [] ELSE [{{'a': {around.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, 'b': {around.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}}}] END"
        paths.append(f"{name}_s{k} AS (SELECT g, idx, {step} AS step FROM {name}{k}), {name}_p{k} AS (SELECT s.g, s.idx, s.step || p.path AS path FROM {name}_s{k} s JOIN {name}_p{k + 1} p ON p.g = s.g AND p.idx = s.idx // 8)")
    return ", ".join([*levels, paths[0], *reversed(paths[1:])])


def _leaf_sql(text: str) -> str:
    told = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(told)})"


_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END))"""

OP13_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_leaf_sql("text")} AS hash, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(_LOWER)} END AS tampered FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l
), {_tree_sql("a", "ranked")}, subroots AS (
  SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n, hash FROM a{_DEPTH}
), {_tree_sql("b", "subroots")}, whole AS (
  SELECT doc_id, r.hash AS leaf, s.hash AS subroot, b{_DEPTH}.hash AS root, coalesce(tampered, r.hash) AS told, pa.path || pb.path AS path
  FROM ranked r JOIN a_p0 pa ON pa.g = r.g AND pa.idx = r.idx JOIN subroots s ON s.lang = r.g JOIN b_p0 pb ON pb.idx = s.idx, b{_DEPTH}
), told AS (
  SELECT *, list_reduce(list_prepend({{'a': told, 'b': ''}}, path), lambda h, s: {{'a': sha256(s.a || h.a || s.b), 'b': ''}}).a AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string([s.a || s.b for s in path], ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM told
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op4_source_mixing": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
