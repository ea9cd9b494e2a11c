"""op3: quality rules over the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import quality
from weftline.sources.tables import table

NAME = "op3_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_upper", "n_exclaim", "failure_bits",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), p AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM p)
), f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), m AS (
  SELECT p.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(t) - len(replace(t, '!', '')) AS BIGINT) AS n_exclaim
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id
), b AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_upper > 4 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_exclaim > n_words THEN 64 ELSE 0 END AS BIGINT) AS failure_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, n_lines, n_upper, n_exclaim, failure_bits
FROM b"""
