"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curves, mixing, packing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, token_store, toxicity
from .common import shared_dir, table

#: DuckDB's form of the word pattern.
SQL_WORD = r"'[^\x20\x09-\x0D]+'"


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_first_quality(table(spark, sf_dir, "documents"))


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: Words of stock phrases in a line.
_STOCK_SQL = " + ".join(f"(length(low) - length(replace(low, {_sql_list([p])}, ''))) // {len(p)} * {len(p.split())}" for p in quality_rules.PHRASES)
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {SQL_WORD}) AS w FROM d),
lines AS (
  SELECT rid, line, regexp_extract_all(line, {SQL_WORD}) AS lw,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
faults AS (
  SELECT rid, line, len(lw) AS n,
    len(list_filter(lw, lambda x: right(x, 1) IN ({_sql_list(quality_rules.CLOSING)}))) = 0
      OR 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > strlen(array_to_string(lw, ''))
      OR 3 * len(list_filter(lw, lambda x: ends_with(x, '!!'))) > len(lw) AS punctuation,
    len(list_filter(lw, lambda x: x IN ({_sql_list(quality_rules.SEPARATORS)}))) >= 2
      AND 4 * len(list_filter(lw, lambda x: x IN ({_sql_list(quality_rules.SEPARATORS)}))) >= len(lw) AS navigation,
    2 * len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) > len(lw)
      OR ({_STOCK_SQL} > 0 AND {quality_rules.PHRASE_SHARE} * ({_STOCK_SQL}) >= len(lw)) AS boilerplate
  FROM lines WHERE len(lw) > 0),
by_line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (punctuation) AS n_bad_punctuation, count(*) FILTER (navigation) AS n_navigation,
    count(*) FILTER (boilerplate) AS n_boilerplate,
    coalesce(sum(n) FILTER (punctuation OR navigation OR boilerplate), 0) AS n_lost_words
  FROM faults GROUP BY rid),
windows AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w[i:i + 7]) > 1),
repeats AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(8) AS r(j) GROUP BY rid),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_bad_punctuation, 0)::BIGINT AS n_bad_punctuation, coalesce(n_navigation, 0)::BIGINT AS n_navigation,
    coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
  FROM w LEFT JOIN by_line USING (rid) LEFT JOIN repeats r USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND 100 * n_lost_words <= {quality_rules.MAX_LOST_PERCENT} * n_words AS kept
FROM counts
"""


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), every=20)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    where = f"{shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), where, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_store(spark, where)


def op7_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op8_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {SQL_WORD}) AS w FROM documents),
windows AS (SELECT rid, doc_id, i, hash(w[i:i + 49]) AS k, md5(array_to_string(w[i:i + 49], ' ')) AS k2
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
covered AS (SELECT rid, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY k, k2) < doc_id),
gone AS (SELECT DISTINCT rid, i + j AS pos FROM covered, range(50) AS r(j)),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {SQL_WORD}))::BIGINT AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
caps AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {mixing.MAX_EPOCHS} * source_size AS cap FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM caps),
level AS (SELECT min(level) FILTER (level < cap::DOUBLE / weight) AS first_level FROM (
  SELECT level, cap, weight, sum((level < cap::DOUBLE / weight)::INT) OVER (ORDER BY cap::DOUBLE / weight, r) AS nth FROM levels) WHERE nth = 1),
targets AS (
  SELECT source, source_size, least(coalesce(first_level * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM caps, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM targets),
runs AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized s)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - start)))::BIGINT AS taken
FROM runs JOIN parts ON runs.source IS NOT DISTINCT FROM parts.source
"""

#: Exact nearest neighbours. The query's are exact up to curves.LEAST distinct vectors, and beyond that of the recall fitted.
OP5_SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
good AS (SELECT * FROM fine WHERE len(e) = (SELECT len(e) FROM fine GROUP BY len(e) ORDER BY count(*) DESC, len(e) DESC LIMIT 1)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    max(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b)) AS score
  FROM good q, good c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_karmarkar_karp": op2_karmarkar_karp,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_components": op4_simhash_components,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_token_store": op6_token_store,
    "op7_capped_water_filling": op7_capped_water_filling,
    "op8_naive_bayes_svm": op8_naive_bayes_svm,
    "op9_recurrent_toxicity": op9_recurrent_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_hilbert_neighbours": OP5_SQL,
    "op7_capped_water_filling": OP7_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op1_line_quality": OP1_SQL,
}
