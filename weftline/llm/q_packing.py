"""op5: harmonic packing of the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import packing
from weftline.llm.tokens import vocabulary
from weftline.sources.tables import table

NAME = "op5_harmonic_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
