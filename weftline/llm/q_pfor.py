"""op10: token-id files of the whole of ``documents``, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import pfor
from weftline.llm.tokens import vocabulary
from weftline.sources.tables import table

NAME = "op10_pfor_files"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = pfor.new_folder(spark)
    manifest = pfor.written(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder)
    return pfor.read(spark, folder, manifest)
