"""The registered queries of this subpackage, each over its whole table, and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, linededup, lm, mixing, quality, sharding, simhash, substring, tokens
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col("quality")[c].alias(c) for c in base), "base_failed", "kept")


def op3_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS))) + "]"

OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM windows),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams SEMI JOIN twice USING (doc_id, g)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
         len(list_filter(l, lambda x: substr(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 1, 1) IN ('-', '*', '•'))) AS n_bullets,
         len(list_filter(l, lambda x: suffix(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '...') OR suffix(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '…'))) AS n_cut,
         len(list_filter(w, lambda x: list_contains({_STOPS}, lower(trim(x, '.,;:!?"''()'))))) AS n_stop,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AND 10 * n_symbols <= n_words
         AND 50 * n_stop >= n_words AND 2 * n_dup_lines <= n_lines
         AND 10 * n_bullets <= 9 * n_lines AND 10 * n_cut <= 3 * n_lines AS kept
FROM f
"""

OP7_SQL = r"""
WITH t AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (
  SELECT DISTINCT side, id, text, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, text, count(*) AS n FROM s WHERE side = 1 GROUP BY id, text)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found,
       count(*) / any_value(n.n) AS containment
FROM s d JOIN s b ON d.s = b.s AND d.side = 0 AND b.side = 1 JOIN n ON n.id = b.id AND n.text = b.text
GROUP BY d.id, d.text, b.id, b.text HAVING 5 * count(*) >= 4 * any_value(n.n)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM s),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_mix_to_weights": op3_mix_to_weights,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_interleaved_shards": op5_interleaved_shards,
    "op6_line_dedup": op6_line_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_lm_scoring": op10_lm_scoring,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
}
