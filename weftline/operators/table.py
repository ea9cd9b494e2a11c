"""Table operators: projections, schema edits, row order, sets of tables.

Rows have no position of their own; operators that need one (slices, sorts with ranks,
offsets) take an order, which should be total, and number rows with ``numbered``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import cut


# -- projections ----------------------------------------------------------------------


def select_known(df: DataFrame, names: list[str], always: list[str] = []) -> DataFrame:  # noqa: B006
    """``always`` and those of ``names`` that exist; unknown names are left out silently."""
    return df.select(*dict.fromkeys([*[c for c in always if c in df.columns], *[c for c in names if c in df.columns]]))


def select_strict(df: DataFrame, names: list[str], always: list[str] = []) -> DataFrame:  # noqa: B006
    """As ``select_known``, but an unknown name is an error."""
    if unknown := [c for c in [*always, *names] if c not in df.columns]:
        raise KeyError(f"no such columns: {', '.join(unknown)}")
    return select_known(df, names, always)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def lower_values(df: DataFrame) -> DataFrame:
    """Names and string values in lower case."""
    return df.select(*[
        (F.lower(F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.col(f.name)).alias(f.name.lower())
        for f in df.schema.fields
    ])


def title_of(name: str, joined: bool = False) -> str:
    """``boilingPoint`` as ``Boiling Point`` (or ``BoilingPoint``), the header an attribute stands for."""
    words: list[str] = []
    for c in name:
        if not words or c.isupper():
            words.append(c.upper())
        else:
            words[-1] += c
    return ("" if joined else " ").join(words)


def column_of(df: DataFrame, attribute: str) -> Column:
    """The column that an attribute name stands for: itself, its title words, or these joined."""
    for name in (attribute, title_of(attribute), title_of(attribute, joined=True)):
        if name in df.columns:
            return F.col(f"`{name}`")
    raise KeyError(attribute)


def add_column(df: DataFrame, value: Column, name: str = "None", at: int | None = None) -> DataFrame:
    """A new column before position ``at`` (from the end if negative), or last."""
    names = [F.col(f"`{c}`") for c in df.columns]
    names.insert(len(names) if at is None else at, value.alias(name))
    return df.select(*names)


def drop_at(df: DataFrame, at: int) -> DataFrame:
    """Without the column at a position, from the end if negative."""
    return df.drop(df.columns[at])


def widen(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` appended by name; columns that one side lacks are null there."""
    return df.unionByName(rows, allowMissingColumns=True)


def set_where(df: DataFrame, chosen: Column, values: dict[str, object]) -> DataFrame:
    """The chosen rows with new values; unknown columns are an error."""
    if unknown := values.keys() - set(df.columns):
        raise KeyError(f"no such columns: {', '.join(sorted(unknown))}")
    return df.withColumns({k: F.when(chosen, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def stringify_nan(df: DataFrame) -> DataFrame:
    """Floating-point columns as text, with ``NaN``, ``inf`` and ``-inf`` spelt that way."""
    kinds = (T.DoubleType, T.FloatType)

    def text(name: str) -> Column:
        c = F.col(name)
        return (
            F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
            .otherwise(c.cast("string")).alias(name)
        )

    return df.select(*[text(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


# -- order ----------------------------------------------------------------------------


def numbered(df: DataFrame, *order: Column, name: str = "row_idx") -> DataFrame:
    """Rows with their place (from 0) in a total order, without gathering them in one task.

    Rows are sorted by ranges and kept; one count for each range is all that is summed up.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": at})
    )
    sizes = sorted_rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row for each range of the sort, as many as shuffle partitions
    joined = sorted_rows.join(F.broadcast(starts), "_range")
    return joined.withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def slice_rows(df: DataFrame, order: list[Column], start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows ``start`` to ``stop`` (exclusive) of the order, with their place."""
    if step != 1:
        raise ValueError("slices have step 1")
    return numbered(df, *order).where((F.col("row_idx") >= start) & (F.col("row_idx") < stop))


def sorted_table(df: DataFrame, column: str, tie: str, descending: bool = True) -> DataFrame:
    """Rows with their place in the order of ``column``, falling by default, ties in the order of ``tie``."""
    key = F.col(column).desc() if descending else F.col(column).asc()
    return numbered(df, key, F.col(tie).asc(), name="place")


def filtered_sorted(df: DataFrame, chosen: Column, column: str, tie: str) -> DataFrame:
    return sorted_table(df.where(chosen), column, tie)


def newest(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


# -- sets of tables -------------------------------------------------------------------


def union_labelled(tables: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Tables stacked by position under the first one's names, each row with its table's label."""
    names = next(iter(tables.values())).columns
    parts = [df.toDF(*names).select(F.lit(k).alias(label), *names) for k, df in tables.items()]
    return reduce(DataFrame.union, parts)


def outer_transpose(df: DataFrame, label: str, key: str, labels: int) -> DataFrame:
    """Rows regrouped by ``key`` instead of ``label``; every label must have every key.

    ``labels`` is the number of labels. A key that some label lacks is an error when its
    rows are read.
    """
    counts = df.groupBy(key).agg(F.count_distinct(label).alias("_n"))
    missing = F.concat(F.lit("a table lacks the key "), F.col(key).cast("string"))
    checked = counts.select(key, F.when(F.col("_n") != labels, F.raise_error(missing)).otherwise(F.lit(True)).alias("_whole"))
    return df.join(checked, key).where("_whole").drop("_whole")


def equal_tables(one: DataFrame, two: DataFrame) -> bool:
    """The same names and the same rows, each as often."""
    if one.columns != two.columns:
        return False
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
