"""From raw documents to packed training sequences.

Each stage takes what the one before it kept. ``STAGES`` lists them; ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again, so that a lost executor
never repeats more than a stage.

1. quality rules: documents that fail the base rules or policy ``v1`` go.
2. exact dedup: of texts equal but for white space, the longest stays.
3. SimHash near-dedup: of each component of near copies (0.8 and more of their five-word
   shingles in common), the smallest id stays.
4. secret scans: spans found are replaced by a mark; the documents stay.
5. packing: token sequences of 2048.

Null texts count as empty and fail the quality rules. Extra columns are carried through
all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact, nearcopies, packing, quality, secrets
from weftline.llm.tokens import vocabulary
from weftline.session import shared_dir
from weftline.sources.tables import table


#: Words that a packing worker keeps; executors hold what earlier stages left as well.
WORDS = 120_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.without_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), words=WORDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither fingerprints' majority bits nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
