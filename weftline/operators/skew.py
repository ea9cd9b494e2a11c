"""Joins and filters that hold up when one key has a third of all rows.

``joined`` looks keys up in a table that knows how many rows each key has: keys above a
share of all rows are sent to all tasks, and there are at most ``MOST_HOT`` of them however
large the input; all other keys go by shuffle, and none of them fills a task. A table of
``FEW`` rows and less cannot fill a task by any key and is joined as it is.

``gate`` folds keys into a bit map of at most ``SLOTS`` rows of 64 bits, which can be sent
to all tasks at any size. ``split`` parts rows by it: those whose key is surely not in the
set, and those whose key may be. The more keys, the more rows of the second kind; they are
to be looked up exactly, so a full map costs a shuffle and never a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOT = 1 << 14
FEW = 1 << 16
SLOTS_LOG2 = 19


def joined(
    rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner", most_hot: int = MOST_HOT, few: int = FEW
) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``table``: one row a key, ``n`` rows of it in ``rows``, ``total`` in all.

    Keys are not null. ``n`` is not in the result.
    """
    if total <= few:
        return rows.join(table.drop("n"), keys, how)
    limit = total // most_hot
    hot, cold = table.where(F.col("n") > limit).drop("n"), table.where(F.col("n") <= limit).drop("n")
    found = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return found.unionByName(others)


def _slot(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - SLOTS_LOG2)


def _bit(key: Column) -> Column:
    return key.bitwiseAND(F.lit(63)).cast("int")


def gate(keys: DataFrame) -> DataFrame:
    """``slot, bits`` of the only column of ``keys``, 64-bit hashes."""
    key = F.col(keys.columns[0])
    places = keys.select(_slot(key).alias("slot"), _bit(key).alias("bit"))
    return places.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def split(rows: DataFrame, key: Column, door: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` (a 64-bit hash) is surely not behind the gate, and rows whose key may be."""
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), key.alias("_key"))
    place = door.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits"))
    looked = keyed.join(F.broadcast(place), _slot(F.col("_key")) == F.col("_slot"), "left")
    inside = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_key & 63 as int)) & 1 = 1"), F.lit(False))
    return looked.where(~inside).select("_row.*"), looked.where(inside).select("_row.*")
