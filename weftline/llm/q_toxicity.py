"""op2: toxicity of the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import toxicity
from weftline.sources.tables import table

NAME = "op2_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
