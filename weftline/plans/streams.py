"""Streams over ``events`` read as files, against the same result in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.history import CHANGES_SQL
from weftline.plans.registry import Plans
from weftline.sources.tables import table
from weftline.streaming import streams

plans = Plans()


def _states(spark, sf_dir):
    return streams.table_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("reference"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"), "value"
    )


@plans.query(CHANGES_SQL)
def st_change_stream(spark, sf_dir):
    return streams.run_to_table(streams.state_changes(_states(spark, sf_dir))).select("reference", "seq", "state")


@plans.query("SELECT user_id AS reference, arg_max(event_id, (ts, event_id)) AS seq, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def st_upsert_sink(spark, sf_dir):
    return streams.upsert_sink(_states(spark, sf_dir).drop("value"), "reference", ["ts", "seq"]).select("reference", "seq", "state")


@plans.query("SELECT DISTINCT user_id AS reference FROM events WHERE event_type IN ('purchase', 'error')")
def st_first_event(spark, sf_dir):
    done = _states(spark, sf_dir).where("state IN ('purchase', 'error')")
    return streams.run_to_table(streams.first_events(done)).select("reference")


@plans.query("SELECT DISTINCT user_id AS reference, event_type AS state FROM events WHERE value > 100")
def st_expiring_log(spark, sf_dir):
    long = _states(spark, sf_dir).where("value > 100")
    # a life beyond the table's thirty days: repeats of a component's state never return
    return streams.run_to_table(streams.expiring_log(long, ["reference", "state"], "60 days")).select("reference", "state")


@plans.query("SELECT user_id + 1 AS dst, user_id AS src, event_id % 1000 AS mark FROM events WHERE event_type <> 'error' AND user_id % 3 = 0")
def st_push_notify(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("src")).distinct()
    edges = users.select("src", (F.col("src") + 1).alias("dst"), (F.col("src") % 2 * 0 + 1).alias("length"), (F.col("src") % 3 == 0).alias("repeats"))
    runs = _states(spark, sf_dir).withColumn("exit_code", F.when(F.col("state") == "error", 1).otherwise(0))
    woken = streams.notices(runs.select("reference", "exit_code", (F.col("seq") % 1000).alias("ts")), edges)
    return streams.run_to_table(woken).select("dst", "src", F.col("ts").alias("mark"))


@plans.query("SELECT user_id AS reference, event_id AS seq, event_type AS state FROM events WHERE event_type IN ('view', 'error')")
def st_merge(spark, sf_dir):
    every = _states(spark, sf_dir)
    both = every.where("state = 'view'").union(_states(spark, sf_dir).where("state = 'error'"))
    return streams.run_to_table(both).select("reference", "seq", "state")
