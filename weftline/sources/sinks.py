"""Writing: key outputs, status reports, properties, appended launches, tables by version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_outputs(outputs: DataFrame, path: str) -> None:
    """Only outputs that some stage has written (version above 0)."""
    outputs.where("version > 0").write.mode("overwrite").json(path)


def status_details(states: DataFrame) -> DataFrame:
    """``stage, details``: the components of each stage as JSON, ordered by reference."""
    return states.groupBy("stage").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*states.columns)))).alias("details"))


def input_ids(ids: DataFrame, path: str, column: str = "input-id") -> None:
    ids.select(F.col(column).cast("string")).distinct().write.mode("overwrite").json(path)


def append_launches(executions: DataFrame, path: str) -> None:
    executions.write.mode("append").parquet(path)


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("_last")).select("_last.*")
