"""The rows of a table that a dedup keeps, found by their ids.

Deciding reads lean rows (id, a mark of the text, keep or not); texts move only where
they must. Ids of which not every row stays make a gate of bounded size
(``operators.skew``); texts that it holds back stay where they are, the others are looked
up by id, frequent ids by broadcast. An id that several rows have says too little: such
rows are looked up by id and mark, and of rows that agree in both one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import MOST_HOT, gate, joined, split
from weftline.session import cut

#: Texts that one task can sort.
FEW_TEXTS = 1 << 12


def surviving(docs: DataFrame, decided: DataFrame, mark: Column, doc_id: str = "doc_id", most_hot: int = MOST_HOT) -> DataFrame:
    """Rows of ``docs`` that ``decided`` (``doc_id, mark, keep``, a row for each row of ``docs``) keeps.

    ``mark`` is the expression over ``docs`` that gave ``decided`` its marks.
    """
    key = F.xxhash64(F.col(doc_id).cast("long"))
    name = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null"))
    odd = cut(
        decided.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.xxhash64("doc_id").alias("_hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("stay"))
        .where("n > 1 OR stay = 0")
    )
    plain, several = split(docs, key, cut(gate(odd.select("_hash"))))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    looked = joined(
        several.select(whole, name.alias("_id")), odd.select("_id", "n", "stay", F.col("n").alias("of")), ["_id"], decided.count(), "left", most_hot, FEW_TEXTS
    )
    single = looked.where("of IS NULL").select("_row.*")
    if odd.where("n > 1 AND stay > 0").isEmpty():
        return plain.unionByName(single)
    marked = several.select(whole, name.alias("_id"), mark.alias("_mark"))
    staying = decided.where("keep").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("mark").alias("_mark"))
    several_ids = odd.where("n > 1 AND stay > 0").select("_id")
    keys = staying.join(several_ids, "_id", "left_semi").distinct()
    found = marked.join(keys, ["_id", "_mark"], "left_semi").groupBy("_id", "_mark").agg(F.any_value("_row").alias("_row"))
    return plain.unionByName(single).unionByName(found.select("_row.*"))
