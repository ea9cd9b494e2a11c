"""Queries of the training-data operators, with their SQL oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import q_bpe, q_chat, q_exact, q_lines, q_packing, q_pfor, q_quality, q_secrets, q_simhash, q_toxicity

_MODULES = (q_quality, q_exact, q_chat, q_packing, q_lines, q_pfor, q_simhash, q_bpe, q_secrets, q_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if getattr(m, "SQL", None)}
