"""Component states: named predicates, roll-ups, readiness and shutdown rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States and exit reasons.
INITIALISING, FINISHED, FAILED, RUNNING, SUSPENDED = "initialising", "finished", "failed", "running", "suspended"
WAITING, CHECKING, SHUTDOWN = "waiting_on_resource", "checking", "component_shutdown"
SUCCESS = "Success"
DEFAULT_FILTERS = ("failed", "engine-exited", "blocked-output", "blocked-resource", "not-executed")

#: Columns of a status report by category, in the order of the report.
CATEGORIES = {
    "producer": ("consumes_from",),
    "engine": ("engine", "backend", "engine_exit", "engine_reason"),
    "task": ("last_launch_ts", "last_run_s", "last_state", "last_finish_ts", "last_exit", "last_exit_reason"),
    "repeat": ("repeat_interval", "next_kernel_s", "task_launches"),
}
DEFAULT_COLUMNS = ("reference", "state")


def predicates() -> dict[str, Column]:
    """What each named filter chooses; a null value is never chosen by an equality."""
    state, last = F.col("state"), F.col("last_state")
    return {
        "failed": state == FAILED,
        "interesting": ~state.isin(FINISHED, RUNNING),
        "engine-exited": F.col("engine_reason") != SUCCESS,
        "blocked-output": F.col("is_waiting"),
        "not-executed": F.col("task_launches") == 0,
        "blocked-resource": last == WAITING,
        "executing": last == RUNNING,
        "not-finished": ~state.isin(FINISHED, FAILED),
        "all": F.lit(True),
    }


def filtered(states: DataFrame, filters: tuple[str, ...] = DEFAULT_FILTERS, stages: tuple[int, ...] = ()) -> DataFrame:
    """Rows that any of the filters chooses, in the given stages (none: in all)."""
    known = predicates()
    chosen = reduce(lambda a, b: a | b, [F.coalesce(known[f], F.lit(False)) for f in filters])
    return states.where(chosen & F.col("stage").isin(*stages) if stages else chosen)


def category_columns(states: DataFrame, categories: list[str], defaults: bool = True) -> DataFrame:
    """The label, the default columns and those of each category, as far as they exist."""
    names = ["label", *(DEFAULT_COLUMNS if defaults else ()), *[c for k in CATEGORIES if k in categories for c in CATEGORIES[k]]]
    return states.select(*[c for c in dict.fromkeys(names) if c in states.columns])


def states_map(states: DataFrame) -> DataFrame:
    """``stage, states``: a map of name to state for each stage."""
    return states.groupBy("stage").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "state")))).alias("states"))


def lists_by_state(states: DataFrame) -> DataFrame:
    """``running, finished, failed`` components of each stage, sorted."""
    of = lambda *s: F.sort_array(F.collect_list(F.when(F.col("state").isin(*s), F.col("reference"))))
    return states.groupBy("stage").agg(of(RUNNING).alias("running"), of(FINISHED).alias("finished"), of(FAILED, SHUTDOWN).alias("failed"))


def stage_completion(states: DataFrame) -> DataFrame:
    """The share of finished components of each stage."""
    return states.groupBy("stage").agg(F.avg((F.col("state") == FINISHED).cast("double")).alias("completion"))


def total_progress(stages: DataFrame) -> DataFrame:
    """Weighted progress over stages (``weight, progress, finished``): finished ones count in whole."""
    part = F.when(F.col("finished"), F.col("weight")).otherwise(F.col("weight") * F.coalesce("progress", F.lit(0.0)))
    return stages.agg(F.sum(part).alias("progress"))


def stage_state(states: DataFrame) -> DataFrame:
    """``stage, state``: waiting, then failed, running, shut down; else the one state there is.

    States that no rule brings together give ``inconsistent``.
    """
    has = lambda *s: F.bool_or(F.col("state").isin(*s))
    return states.groupBy("stage").agg(
        F.when(has(WAITING), WAITING).when(has(FAILED), FAILED).when(has(RUNNING, CHECKING), RUNNING).when(has(SHUTDOWN), SHUTDOWN)
        .when(F.min("state") == F.max("state"), F.min("state")).otherwise("inconsistent").alias("state")
    )


def stages_in_transit(states: DataFrame) -> DataFrame:
    """``stage, in_transit, finished``: with, or without, components that are not done."""
    done = F.col("state").isin(FINISHED, FAILED, SHUTDOWN)
    return states.groupBy("stage").agg(F.bool_or(~done).alias("in_transit"), F.bool_and(done).alias("finished"))


def final_stage_failed(states: DataFrame, leaves: DataFrame) -> DataFrame:
    """``stage, failed``: a last stage fails if none of its leaves finished."""
    last = states.agg(F.max("stage").alias("stage"))
    here = states.join(F.broadcast(last), "stage").join(leaves, "reference", "left_semi")  # one row
    return here.groupBy("stage").agg((~F.bool_or(F.col("state") == FINISHED)).alias("failed"))


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components not yet started whose producers let them start.

    ``nodes``: ``reference, stage, state, staged``. A producer of another stage must be
    done; one of the same stage must be staged.
    """
    done = F.col("state").isin(FINISHED, FAILED, SHUTDOWN)
    producers = nodes.select(F.col("reference").alias("src"), F.col("stage").alias("src_stage"), done.alias("done"), F.col("staged").alias("src_staged"))
    waiting = nodes.where((F.col("state") == INITIALISING) & ~F.col("staged"))
    blocked = (
        edges.join(producers, "src").join(waiting.select(F.col("reference").alias("dst"), "stage"), "dst")
        .where(F.when(F.col("src_stage") == F.col("stage"), ~F.col("src_staged")).otherwise(~F.col("done")))
        .select("dst")
    )
    return waiting.join(blocked.withColumnRenamed("dst", "reference"), "reference", "left_anti").select("reference")


def shutdown_rule(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``dst, shut``: which consumers shut down because of their producers.

    ``nodes``: ``reference, state, is_replica, is_aggregate``. Any failed producer shuts a
    consumer. A consumer that aggregates shuts when any producer that is no replica is
    shut, or all its replicas are; any other shuts with any producer.
    """
    kind = nodes.select(F.col("reference").alias("dst"), "is_aggregate")
    made = nodes.select(F.col("reference").alias("src"), "state", "is_replica")
    shut, replica = F.col("state") == SHUTDOWN, F.col("is_replica")
    sums = edges.join(made, "src").groupBy("dst").agg(
        F.bool_or(F.col("state") == FAILED).alias("failed"), F.bool_or(shut).alias("any_shut"),
        F.bool_or(shut & ~replica).alias("any_single"), F.bool_and(F.when(replica, shut)).alias("all_replicas"),
    )
    by_fan_in = F.col("any_single") | F.coalesce("all_replicas", F.lit(False))
    return sums.join(kind, "dst").select(
        "dst", (F.col("failed") | F.when(F.col("is_aggregate"), by_fan_in).otherwise(F.col("any_shut"))).alias("shut")
    )


def restart_policy(rows: DataFrame, default_max: int = 3) -> DataFrame:
    """``decision`` and ``final_state`` of finished tasks.

    ``rows``: ``reason, restarts, resubmissions, max_restarts, restart_on`` and
    ``shutdown_on`` (arrays of reasons), ``hook`` (null: none; else ``possible``,
    ``unavailable``, ``not-required``, ``not-possible``), ``max_resubmissions``.
    """
    listed = F.array_contains("restart_on", F.col("reason"))
    most = F.coalesce("max_restarts", F.when(F.col("hook").isNotNull(), -1).otherwise(default_max))
    over = (most >= 0) & (F.col("restarts") + 1 > most)
    hook = F.coalesce("hook", F.lit("unavailable"))
    sent = F.col("reason") == "SubmissionFailed"
    decision = (
        F.when(listed & over, "RestartMaxAttemptsExceeded")
        .when(listed & hook.isin("possible", "unavailable"), "RestartInitiated")
        .when(listed & (hook == "not-required"), "RestartNotRequired")
        .when(listed, "RestartCouldNotInitiate")
        .when(sent & (F.col("resubmissions") < F.col("max_resubmissions")) & ~over, "RestartInitiated")
        .when(sent, "RestartMaxAttemptsExceeded")
        .otherwise("RestartCouldNotInitiate")
    )
    final = F.when(F.col("reason") == SUCCESS, FINISHED).when(F.array_contains("shutdown_on", F.col("reason")), SHUTDOWN).otherwise(FAILED)
    return rows.withColumn("decision", decision).withColumn(
        "final_state", F.when(F.col("decision") != "RestartInitiated", final)
    )
