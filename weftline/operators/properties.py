"""Measured properties: tables folded into one by all columns they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_outer(one: DataFrame, two: DataFrame) -> DataFrame:
    """Full outer join on all shared columns; null keys match null keys."""
    shared = [c for c in one.columns if c in two.columns]
    if not shared:
        raise ValueError("the tables share no column")
    a, b = one.alias("a"), two.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in shared])
    return a.join(b, same, "full_outer").select(
        *[F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")).alias(c) for c in shared],
        *[F.col(f"a.`{c}`") for c in one.columns if c not in shared],
        *[F.col(f"b.`{c}`") for c in two.columns if c not in shared],
    )


def fold(tables: dict[str, DataFrame], key: str = "input-id") -> DataFrame:
    """One wide table from the table of each property; names are compared in lower case."""

    def checked(name: str, df: DataFrame) -> DataFrame:
        low = df.toDF(*[c.lower() for c in df.columns])
        if lacking := [c for c in (key, name.lower()) if c not in low.columns]:
            raise ValueError(f"the table of {name} lacks {', '.join(lacking)}")
        return low

    return reduce(natural_outer, [checked(k, df) for k, df in tables.items()])


def replica_match(one: DataFrame, two: DataFrame, key: str, value: str, name: str = "matches") -> DataFrame:
    """``one`` with the ordered values of ``two`` that have the same key; rows of ``two`` without one are dropped.

    Values are gathered for each key, so a key should have few rows in ``two``.
    """
    gathered = two.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))
    empty = F.array().cast(gathered.schema[name].dataType)
    return one.join(gathered, key, "left").withColumn(name, F.coalesce(name, empty))


def missing_documents(docs: DataFrame, found: DataFrame, uri: str) -> DataFrame:
    """Documents for which no table was found."""
    return docs.join(found.select(uri), uri, "left_anti")
