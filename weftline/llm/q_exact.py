"""op4: exact dedup over the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact
from weftline.sources.tables import table

NAME = "op4_exact_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(table(spark, sf_dir, "documents")).drop("len")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY bare ORDER BY len(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
