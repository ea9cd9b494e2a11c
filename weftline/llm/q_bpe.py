"""op8: byte-level BPE of the whole of ``documents`` and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe
from weftline.llm.tokens import vocabulary
from weftline.sources.tables import table

NAME = "op8_byte_bpe"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
