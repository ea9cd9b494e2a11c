"""Streams of component states: changes, upserts, first events, expiring logs, notices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.session import shared_dir
from weftline.sources.sinks import latest_by_key


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet table read as a stream of its files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # the last letter as a class: a file source takes globs, but no single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path[:-1] + "[t]")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the source has now, in batches, written to the shared folder and read back."""
    spark = stream.sparkSession
    place = _place(spark, "stream")
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/rows")
        .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def _changes(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")  # one component's rows of one trigger
    before = state.get[0] if state.exists else None
    was = rows["state"].shift()
    was.iloc[0] = before
    state.update((rows["state"].iloc[-1],))
    yield rows[rows["state"] != was][["reference", "ts", "seq", "state"]]


def state_changes(states: DataFrame) -> DataFrame:
    """Rows (``reference, ts, seq, state``) whose state differs from the component's previous one."""
    schema = states.select("reference", "ts", "seq", "state").schema
    return states.groupBy("reference").applyInPandasWithState(_changes, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key after all batches; each batch writes a new version of the table.

    A batch that runs again overwrites its own version, so the result is the same.
    """
    spark = stream.sparkSession
    place = _place(spark, "upsert")
    schema = stream.schema
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = [n for n in done if n < number]
        rows = batch if not earlier else batch.unionByName(session.read.schema(schema).parquet(f"{place}/v{earlier[-1]}"))
        latest_by_key(rows, key, order).write.mode("overwrite").parquet(f"{place}/v{number}")
        if number not in done:
            done.append(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/v{done[-1]}") if done else spark.createDataFrame([], schema)


def first_events(stream: DataFrame, key: str = "reference") -> DataFrame:
    """The first event of each key that arrives; later ones are dropped."""
    return stream.dropDuplicates([key])


def expiring_log(stream: DataFrame, keys: list[str], life: str = "300 seconds", ts: str = "ts") -> DataFrame:
    """Events without repeats of the same keys within ``life``; state older than that is forgotten."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, life).dropDuplicatesWithinWatermark(keys)


def notices(stream: DataFrame, edges: DataFrame) -> DataFrame:
    """``dst, src, ts``: each success of a producer wakes its repeating consumers of the same stage.

    ``edges``: ``src, dst, length, repeats``; ``length`` 1 means the same stage.
    """
    woken = edges.where("repeats AND length = 1").select(F.col("src").alias("reference"), "dst")
    return stream.where("exit_code = 0").join(woken, "reference").select("dst", F.col("reference").alias("src"), "ts")


def older_files(stream: DataFrame, delay: str, ts: str = "modificationTime") -> DataFrame:
    """Rows whose time lies at least ``delay`` back."""
    return stream.where(F.col(ts) < F.current_timestamp() - F.expr(f"INTERVAL {delay}"))
