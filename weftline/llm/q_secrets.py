"""op1: secret scans over the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import secrets
from weftline.sources.tables import table

NAME = "op1_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))
