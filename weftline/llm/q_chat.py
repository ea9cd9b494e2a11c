"""op9: perspective rotation over the whole of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import chat
from weftline.sources.tables import table

NAME = "op9_perspective_rotation"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(nullif(role, ''), 'unknown') AS speaker,
    replace(coalesce(text, ''), '<|im_', '<|_im_') AS content
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'
), r AS (
  SELECT m.*, perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END
    || chr(10) AS opening
  FROM r
), s AS (
  SELECT *, CAST(len(opening) + len(content) + 11 AS BIGINT) AS size FROM h
), o AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, content
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start
  FROM s
)
SELECT conv_id, perspective, turn, chat_role, CASE WHEN chat_role = 'user' THEN speaker END AS name,
  opening || content || '<|im_end|>' || chr(10) AS segment, seg_start, seg_start + size AS seg_end,
  CASE WHEN chat_role = 'assistant' THEN seg_start + len(opening) END AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN seg_start + size - 1 END AS mask_end
FROM o"""
