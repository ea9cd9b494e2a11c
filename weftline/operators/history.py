"""Execution-history analytics: one row per task launch, grouped by component reference.

``executions``: ``reference, seq, launch_ts, run_s, exit_code``. A NULL exit code counts
as a failure, NULL seconds as no time. As-of and interval operators keep an equality on
the component, so Spark deals rows out by it; a component with very many rows is dealt
out by buckets of time as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

#: Seconds in a bucket of time.
BUCKET_S = 86_400


def seconds_after(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=F.coalesce(seconds, F.lit(0.0)).cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def finished_at() -> Column:
    return seconds_after(F.col("launch_ts"), F.col("run_s"))


def succeeded(exit_code: str = "exit_code") -> Column:
    return F.coalesce(F.col(exit_code) == 0, F.lit(False))


# -- use of resources -----------------------------------------------------------------


def resource_usage(
    executions: DataFrame, by: str = "reference", seconds: str = "run_s", exit_code: str = "exit_code", within: Column | None = None
) -> DataFrame:
    """Launches and seconds of each component, in total and by outcome.

    ``within`` restricts the launches (for example to those that finish inside a span).
    """
    rows = executions if within is None else executions.where(within)
    good = succeeded(exit_code)
    took = F.coalesce(F.col(seconds), F.lit(0.0))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(good).alias("successful_executions"),
        F.count_if(~good).alias("failed_executions"),
        F.sum(took).alias("total_s"),
        F.sum(F.when(good, took).otherwise(0.0)).alias("successful_s"),
        F.sum(F.when(~good, took).otherwise(0.0)).alias("failed_s"),
    )


def graph_resources(usage: DataFrame) -> DataFrame:
    """Sums of ``resource_usage`` over all components."""
    return usage.agg(*[F.sum(c).alias(c) for c in usage.columns if c.endswith(("_executions", "_s"))])


def finishing_between(executions: DataFrame, spans: DataFrame) -> DataFrame:
    """``resource_usage`` of the launches that finish inside ``reference, start, end``, limits excluded."""
    joined = executions.withColumn("finish_ts", finished_at()).join(spans, "reference")
    return resource_usage(joined, within=(F.col("finish_ts") > F.col("start")) & (F.col("finish_ts") < F.col("end")))


def resource_cost(rows: DataFrame) -> DataFrame:
    """``cost_s`` from ``processes, threads, run_s`` and ``estimated_s`` from ``walltime_s``."""
    each = F.col("processes") * F.col("threads")
    return rows.withColumns({"cost_s": each * F.col("run_s"), "estimated_s": each * F.col("walltime_s")})


# -- the run of one component ---------------------------------------------------------


def _in_order():
    return Window.partitionBy("reference").orderBy("launch_ts", "seq")


def _up_to():
    return _in_order().rowsBetween(Window.unboundedPreceding, 0)


def delta_last_task(executions: DataFrame) -> DataFrame:
    """``delta_last_s``: idle seconds since the previous launch ended; 0 for the first or after NULL seconds."""
    idle = seconds_between(F.lag("launch_ts").over(_in_order()), F.col("launch_ts")) - F.lag("run_s").over(_in_order())
    return executions.withColumn("delta_last_s", F.coalesce(idle, F.lit(0.0)))


def weighted_recent(executions: DataFrame, value: str = "run_s", last: int = 3) -> DataFrame:
    """``guess``: mean of up to ``last`` latest values, weights rising evenly from 1 to 2."""
    recent = F.collect_list(value).over(_in_order().rowsBetween(1 - last, 0))
    weight = lambda i, n: F.when(n > 1, i / (n - 1)).otherwise(F.lit(0.0)) + 1
    found = executions.withColumn("_recent", recent)
    n = F.size("_recent")
    sums = F.transform("_recent", lambda x, i: F.struct((x * weight(i, n)).alias("v"), weight(i, n).alias("w")))
    total = lambda field: F.aggregate("_sums", F.lit(0.0), lambda a, s: a + s[field])
    return found.withColumn("_sums", sums).withColumn("guess", F.when(n > 0, total("v") / total("w"))).drop("_recent", "_sums")


def since_success(executions: DataFrame) -> DataFrame:
    """``since_success_s``: seconds of failed launches since the last success; ``fail_streak``: their number; ``times_run``."""
    grouped = executions.withColumn("_island", F.count_if(succeeded()).over(_up_to()))
    island = Window.partitionBy("reference", "_island").orderBy("launch_ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.when(~succeeded(), F.coalesce("run_s", F.lit(0.0))).otherwise(0.0)
    return grouped.select(
        *executions.columns, F.sum(failed).over(island).alias("since_success_s"),
        F.count_if(~succeeded()).over(island).alias("fail_streak"), F.count(F.lit(1)).over(_up_to()).alias("times_run"),
    )


def state_changes(states: DataFrame, keys: list[str], always: list[str] = [], by: str = "reference", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:  # noqa: B006
    """``changes``: a map of the keys whose text differs from the emitter's previous row; rows without changes go.

    The first row of an emitter has all its values. Where something changed, the keys in
    ``always`` are bundled as they are.
    """
    before = Window.partitionBy(by).orderBy(*order)
    first = F.row_number().over(before) == 1
    pairs = [
        F.when(first | ~F.lag(k).over(before).eqNullSafe(F.col(k)), F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")))
        for k in keys
    ]
    found = states.withColumn("_changed", F.array_compact(F.array(*pairs))).where(F.size("_changed") > 0)
    bundled = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in always])
    entries = F.concat("_changed", bundled) if always else F.col("_changed")
    return found.select(by, *order, F.map_from_entries(entries).alias("changes"))


def last_execution(executions: DataFrame, successful: bool = False) -> DataFrame:
    """The final launch of each component, or its final success."""
    rows = executions.where(succeeded()) if successful else executions
    last = F.max_by(F.struct("seq", "launch_ts", "run_s", "exit_code"), F.struct("launch_ts", "seq"))
    return rows.groupBy("reference").agg(last.alias("_last")).select("reference", "_last.*")


def first_after_done(executions: DataFrame, done: DataFrame) -> DataFrame:
    """A component's first launch after ``done`` (``reference, done_ts``) is taken as a success if it had one before."""
    joined = executions.join(done, "reference", "left")
    after = F.col("launch_ts") > F.col("done_ts")
    group = Window.partitionBy("reference")
    first = F.min_by("seq", F.when(after, F.struct("launch_ts", "seq"))).over(group)
    had = F.count_if(succeeded()).over(_in_order().rowsBetween(Window.unboundedPreceding, -1)) > 0
    code = F.when((F.col("seq") == first) & had, 0).otherwise(F.col("exit_code"))
    return joined.withColumn("exit_code", code).select(*executions.columns)


def output_versions(outputs: DataFrame) -> DataFrame:
    """``version`` (one more for each stage that wrote an output) and ``final`` (the last stage's)."""
    by = Window.partitionBy("name")
    return outputs.withColumns({
        "version": F.row_number().over(by.orderBy("stage")), "final": F.col("stage") == F.max("stage").over(by),
    })


def latest_instance(instances: DataFrame, by: str = "hash", path: str = "instance") -> DataFrame:
    """The newest instance of each key, by the time in its path; paths without one are left out."""
    stamped = instances.withColumn("instance_ts", instance_time(F.col(path))).where("instance_ts IS NOT NULL")
    ranked = stamped.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("instance_ts"), F.desc(path))))
    return ranked.where("_rank = 1").drop("_rank")


def instance_time(path: Column) -> Column:
    """The time in the last three ``-`` tokens of a path, such as ``x-2024-01-31T101500.250000``."""
    text = F.regexp_extract(path, r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{6}\.[0-9]{1,6})(?:\.[a-z]+)?/?$", 1)
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyy-MM-dd'T'HHmmss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]")).cast("timestamp_ntz")


def memo_lookup(nodes: DataFrame, stored: DataFrame, hash_col: str = "memo_hash") -> DataFrame:
    """For each node the most recent stored document with its hash; NULL where there is none."""
    best = latest_instance(stored.where(F.col(hash_col).isNotNull()), by=hash_col)
    return nodes.join(best.select(hash_col, F.col("instance").alias("found_instance"), "instance_ts"), hash_col, "left")


# -- as-of and interval joins ---------------------------------------------------------


def next_success(points: DataFrame, executions: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """For each ``reference, ts`` (other columns stay) the first success that starts after ``ts``.

    Adds ``next_seq, next_start, next_finish``. No pairs are made: points and launches are
    sorted together within a component and bucket of time; the first launch of each bucket,
    one lean row, serves points of the buckets before.
    """
    bucket = lambda ts: F.floor(F.unix_timestamp(ts.cast("timestamp")) / bucket_s).cast("long")
    good = executions.where(succeeded()).select(
        "reference", F.col("launch_ts").alias("_ts"), F.lit(0).alias("_kind"),
        F.struct(F.col("seq").alias("next_seq"), F.col("launch_ts").alias("next_start"), finished_at().alias("next_finish")).alias("_next"),
    )
    extra = [c for c in points.columns if c != "reference"]
    asked = points.select("reference", F.col("ts").alias("_ts"), F.lit(1).alias("_kind"), F.struct(*extra).alias("_row"))
    both = good.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", bucket(F.col("_ts")))
    firsts = both.groupBy("reference", "_bucket").agg(F.min_by("_next", F.when(F.col("_kind") == 0, F.struct("_ts", "_next.next_seq"))).alias("_first"))
    later = Window.partitionBy("reference").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select("reference", "_bucket", F.first("_first", ignorenulls=True).over(later).alias("_carried"))
    inside = Window.partitionBy("reference", "_bucket").orderBy("_ts", "_kind", "_next.next_seq").rowsBetween(1, Window.unboundedFollowing)
    # at one time launches come before points, so only later launches follow a point
    found = both.withColumn("_here", F.first("_next", ignorenulls=True).over(inside)).where("_kind = 1").drop("_next")
    joined = found.join(carried, ["reference", "_bucket"])
    return joined.select("reference", "_row.*", F.coalesce("_here", "_carried").alias("_n")).select("reference", *extra, "_n.*")


def clipped_overlap(quanta: DataFrame, windows: DataFrame, least_s: float = 0.5) -> DataFrame:
    """Seconds of producers' quanta inside each consumer's window, by outcome.

    ``quanta``: ``producer, start, stop, exit_code`` (open: NULL stop); ``windows``:
    ``consumer, producer, since, now, repeating``. A quantum counts if it starts before
    ``now`` and stops after ``since``, with at least ``least_s``. What is not repeating
    always counts as success; an open quantum of a repeating producer as unknown.
    """
    hits = quanta.join(windows, "producer").where((F.col("start") < F.col("now")) & (F.col("stop").isNull() | (F.col("stop") > F.col("since"))))
    end = F.least(F.coalesce("stop", "now"), "now")
    clipped = F.greatest(F.lit(least_s), seconds_between(F.greatest("start", "since"), end))
    kind = F.when(~F.col("repeating"), "succeed").when(F.col("stop").isNull(), "unknown").when(F.col("exit_code") == 0, "succeed").otherwise("fail")
    sums = [F.sum(F.when(F.col("_kind") == k, F.col("_s")).otherwise(0.0)).alias(f"{k}_s") for k in ("succeed", "fail", "unknown")]
    return hits.withColumns({"_s": clipped, "_kind": kind}).groupBy("consumer", "producer").agg(*sums)


def producer_times(overlaps: DataFrame) -> DataFrame:
    """Least, most, sum and mean seconds over a consumer's producers, and sums by outcome."""
    total = F.col("succeed_s") + F.col("fail_s") + F.col("unknown_s")
    return overlaps.withColumn("_t", total).groupBy("consumer").agg(
        F.min("_t").alias("min_s"), F.max("_t").alias("max_s"), F.sum("_t").alias("sum_s"), F.avg("_t").alias("avg_s"),
        F.sum("succeed_s").alias("succeed_sum_s"), F.max("succeed_s").alias("succeed_max_s"), F.sum("unknown_s").alias("unknown_sum_s"),
    )


def top_producer(overlaps: DataFrame) -> DataFrame:
    """The producer with the most successful seconds of each consumer, ties to the smaller name."""
    best = F.max_by("producer", F.struct("succeed_s", -F.col("producer")))
    return overlaps.groupBy("consumer").agg(best.alias("producer"), F.max("succeed_s").alias("succeed_s"))


def running_at(executions: DataFrame, times: DataFrame) -> DataFrame:
    """``t, running, finished``: launches that run, and have finished, at each of a few times.

    ``times`` (one column ``t``) is a grid whose size the caller chooses, not the data. A
    launch counts as running from a second before it starts.
    """
    ends = executions.select("launch_ts", finished_at().alias("finish_ts"))
    soon = F.col("t") + F.expr("INTERVAL 1 SECOND")
    counted = F.broadcast(times).join(ends, F.col("launch_ts") <= soon)
    return counted.groupBy("t").agg(
        F.count_if(F.col("finish_ts") >= soon).alias("running"), F.count_if(F.col("finish_ts") <= F.col("t")).alias("finished")
    )


def time_grid(span: DataFrame, step: str, name: str = "t") -> DataFrame:
    """Times from ``start`` to ``end`` of a one-row span."""
    return span.select(F.explode(F.sequence("start", "end", F.expr(f"INTERVAL {step}"))).alias(name))


# -- span -----------------------------------------------------------------------------


def span(times: DataFrame, levels: DataFrame, edges: DataFrame, executions: DataFrame, every: bool = True) -> DataFrame:
    """When each component has answered to what its sources had at each time.

    ``times``: ``t``; ``levels``: ``node, level`` (sources at 0); ``edges``: ``src, dst``.
    A source is green at ``t``. Another node is green when its first success that starts
    after all (``every``) or any of its green producers' times finishes; its total span is
    that of its latest green producer plus the seconds between the two. One join for each
    level serves all times together. Result: ``t, node, green, span_node, total_span``.
    """
    sources = levels.where("level = 0").select("node")
    done = cut(times.crossJoin(F.broadcast(sources)).select(  # a grid by definition: times x sources
        "t", "node", F.col("t").alias("green"), F.lit(None).cast(levels.schema["node"].dataType).alias("span_node"), F.lit(0.0).alias("total_span")
    ))
    deepest = levels.agg(F.max("level")).first()[0] or 0
    needs = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("needed"))
    for level in range(1, deepest + 1):
        here = levels.where(F.col("level") == level).select(F.col("node").alias("dst"))
        fed = edges.join(here, "dst").join(done.withColumnRenamed("node", "src"), "src")
        latest = F.struct("green", "src", "total_span")
        met = fed.groupBy("t", "dst").agg(F.count(F.lit(1)).alias("n"), F.max(latest).alias("last"), F.min(latest).alias("first"))
        if every:
            met = met.join(needs, "dst").where("n = needed")
        chosen = F.col("last") if every else F.col("first")
        asked = met.select(F.col("dst").alias("reference"), chosen["green"].alias("ts"), "t", F.col("last.src").alias("span_node"), F.col("last.green").alias("from_ts"), F.col("last.total_span").alias("before"))
        answered = next_success(asked, executions).where("next_finish IS NOT NULL")
        new = answered.select(
            "t", F.col("reference").alias("node"), F.col("next_finish").alias("green"), "span_node",
            (F.col("before") + seconds_between(F.col("from_ts"), F.col("next_finish"))).alias("total_span"),
        )
        done = cut(done.unionByName(new))
    return done


def graph_span(spans: DataFrame, leaves: DataFrame) -> DataFrame:
    """``t, span, n_leaves``: the longest total span over the leaves that answered."""
    return spans.join(leaves, "node", "left_semi").groupBy("t").agg(F.max("total_span").alias("span"), F.count(F.lit(1)).alias("n_leaves"))


def kpis(graph_spans: DataFrame, executions: DataFrame) -> DataFrame:
    """One row: seconds from first launch to last finish, and the span at the first time that has one."""
    run = executions.agg(F.min("launch_ts").alias("_a"), F.max(finished_at()).alias("_b"))
    first = graph_spans.agg(F.min_by("span", "t").alias("first_response_s"), F.min("span").alias("best_response_s"))
    return run.crossJoin(first).select(seconds_between(F.col("_a"), F.col("_b")).alias("makespan_s"), "first_response_s", "best_response_s")


def stability(exceptions: DataFrame, now: Column, frame_s: int = 180, life_s: int = 300) -> DataFrame:
    """One row: exceptions that live, and whether none lies in the frame before ``now``."""
    age = seconds_between(F.col("ts"), now)
    return exceptions.agg(
        F.count_if((age >= 0) & (age <= life_s)).alias("live"), (F.count_if((age >= 0) & (age <= frame_s)) == 0).alias("stable")
    )


# -- repeat interval ------------------------------------------------------------------


def next_interval(rows: DataFrame) -> DataFrame:
    """``next_s`` from ``exit_code, guess`` (may be NULL) and ``p`` (longest successful producer time).

    After a success it is the guess; after a failure the guess while it stays below ``p``,
    else ``p`` and a step that depends on the size of ``p``.
    """
    p = F.col("p")
    step = (
        F.when(p <= 600, F.least(F.lit(60.0), 1.5 * p)).when(p <= 3600, F.least(F.lit(600.0), 1.5 * p))
        .when(p <= 43_200, F.lit(1800.0)).when(p <= 86_400, F.lit(3600.0)).otherwise(F.least(F.lit(14_400.0), 1.5 * p))
    )
    later = F.when(F.col("guess") < p, F.col("guess")).otherwise(p + F.greatest(F.lit(1.0), step))
    return rows.withColumn("next_s", F.when(F.col("exit_code") == 0, F.col("guess")).otherwise(later))


def task_events(tasks: DataFrame) -> DataFrame:
    """``wait, execute, complete`` times of tasks from state and epochs; an epoch is hidden until the state allows it."""
    at = lambda name: F.timestamp_seconds(F.try_to_number(F.col(name), F.lit("9999999999")).cast("long"))
    begun = F.col("state").isin("running", "finished", "failed")
    ended = F.col("state").isin("finished", "failed")
    return tasks.select("task", at("submitted").alias("wait"), F.when(begun, at("started")).alias("execute"), F.when(ended, at("finished")).alias("complete"))


def routed_events(updates: DataFrame) -> DataFrame:
    """Ordered events of each update: leaving the queue comes before running, running before its end."""
    event = lambda step, name, on: F.when(on, F.struct(F.lit(step).alias("step"), F.lit(name).alias("event")))
    coded = F.when(F.col("stopped") & F.col("exit_code").isNull(), F.raise_error(F.lit("a finished run has no exit code"))).otherwise(F.lit(True))
    listed = F.array_compact(F.array(
        event(0, "queue-start", F.col("queued")), event(1, "queue-stop", F.col("started")),
        event(2, "run-start", F.col("started")), event(3, "run-stop", F.col("stopped")),
    ))
    return updates.where(coded).select("reference", "seq", F.explode(listed).alias("_e"), "exit_code").select(
        "reference", "seq", "_e.step", "_e.event", F.when(F.col("_e.event") == "run-stop", F.col("exit_code")).alias("exit_code")
    )
