"""Execution-history queries over the ``events`` table.

A user is a component, an event one launch: it starts at ``ts``, runs ``value`` seconds,
and fails if its type is ``error``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph, history
from weftline.operators import table as tables
from weftline.plans.registry import Plans
from weftline.sources.tables import table

plans = Plans()

_EX = """
ex AS (SELECT user_id AS reference, event_id AS seq, ts AS launch_ts, value AS run_s, event_type = 'error' AS failed,
  ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS finish_ts FROM events)"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("reference"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("launch_ts"),
        F.col("value").alias("run_s"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
    )


def _shown(used: DataFrame, *keys: str) -> DataFrame:
    counts = ("total_executions", "successful_executions", "failed_executions")
    return used.select(*keys, *counts, *[F.round(c, 4).alias(c) for c in ("total_s", "successful_s", "failed_s")])


_USAGE = """count(*) AS total_executions, count(*) FILTER (WHERE NOT failed) AS successful_executions,
  count(*) FILTER (WHERE failed) AS failed_executions, round(sum(run_s), 4) AS total_s,
  round(sum(CASE WHEN failed THEN 0 ELSE run_s END), 4) AS successful_s, round(sum(CASE WHEN failed THEN run_s ELSE 0 END), 4) AS failed_s"""


@plans.query(f"WITH {_EX} SELECT reference, {_USAGE} FROM ex GROUP BY reference")
def agg_resource_usage(spark, sf_dir):
    return _shown(history.resource_usage(executions(spark, sf_dir)), "reference")


@plans.query(f"WITH {_EX} SELECT {_USAGE} FROM ex")
def agg_graph_resources(spark, sf_dir):
    used = history.graph_resources(history.resource_usage(executions(spark, sf_dir)))
    return _shown(used)


@plans.query(f"""WITH {_EX}, s AS (SELECT user_id AS reference, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT reference, {_USAGE} FROM ex JOIN s USING (reference) WHERE finish_ts > a AND finish_ts < b GROUP BY reference""")
def jn_range_resources(spark, sf_dir):
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("reference"))
    spans = signups.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return _shown(history.finishing_between(executions(spark, sf_dir), spans), "reference")


@plans.query("SELECT event_id AS seq, 2 * (event_id % 3 + 1) * value AS cost_s, 60.0::DOUBLE * 2 * (event_id % 3 + 1) AS estimated_s FROM events")
def agg_resource_cost(spark, sf_dir):
    rows = executions(spark, sf_dir).select("seq", "run_s", F.lit(2).alias("processes"), (F.col("seq") % 3 + 1).alias("threads"), F.lit(60.0).alias("walltime_s"))
    return history.resource_cost(rows).select("seq", "cost_s", "estimated_s")


@plans.query(f"""WITH {_EX} SELECT seq, round(coalesce(date_diff('microsecond', lag(launch_ts) OVER w, launch_ts) / 1e6 - lag(run_s) OVER w, 0), 6) AS delta_last_s
FROM ex WINDOW w AS (PARTITION BY reference ORDER BY launch_ts, seq)""")
def win_delta_last_task(spark, sf_dir):
    return history.delta_last_task(executions(spark, sf_dir)).select("seq", F.round("delta_last_s", 6).alias("delta_last_s"))


@plans.query(f"""WITH {_EX}, l AS (SELECT seq, run_s AS c, lag(run_s) OVER w AS b, lag(run_s, 2) OVER w AS a FROM ex WINDOW w AS (PARTITION BY reference ORDER BY launch_ts, seq))
SELECT seq, round(CASE WHEN b IS NULL THEN c WHEN a IS NULL THEN (b + 2 * c) / 3 ELSE (a + 1.5 * b + 2 * c) / 4.5 END, 6) AS guess FROM l""")
def win_weighted_recent(spark, sf_dir):
    return history.weighted_recent(executions(spark, sf_dir)).select("seq", F.round("guess", 6).alias("guess"))


_STREAK = f"""WITH {_EX}, i AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY reference ORDER BY launch_ts, seq) AS island,
  row_number() OVER (PARTITION BY reference ORDER BY launch_ts, seq) AS times_run FROM ex)
SELECT seq, %s FROM i WINDOW w AS (PARTITION BY reference, island ORDER BY launch_ts, seq)"""


@plans.query(_STREAK % "round(sum(CASE WHEN failed THEN run_s ELSE 0 END) OVER w, 4) AS since_success_s")
def win_since_success(spark, sf_dir):
    return history.since_success(executions(spark, sf_dir)).select("seq", F.round("since_success_s", 4).alias("since_success_s"))


@plans.query(_STREAK % "count(*) FILTER (WHERE failed) OVER w AS fail_streak, times_run")
def win_fail_streak(spark, sf_dir):
    return history.since_success(executions(spark, sf_dir)).select("seq", "fail_streak", "times_run")


CHANGES_SQL = """
WITH l AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS reference, event_id AS seq, event_type AS state FROM l WHERE n = 1 OR before IS DISTINCT FROM event_type"""


@plans.query(CHANGES_SQL)
def win_state_change(spark, sf_dir):
    states = table(spark, sf_dir, "events").select(F.col("user_id").alias("reference"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return history.state_changes(states, ["state"]).select("reference", "seq", F.col("changes")["state"].alias("state"))


@plans.query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def win_retention(spark, sf_dir):
    return tables.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@plans.query(f"WITH {_EX} SELECT reference, seq, run_s FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY launch_ts DESC, seq DESC) AS n FROM ex) WHERE n = 1")
def win_last_exec(spark, sf_dir):
    return history.last_execution(executions(spark, sf_dir)).select("reference", "seq", "run_s")


@plans.query(f"WITH {_EX} SELECT reference, seq, launch_ts FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY launch_ts DESC, seq DESC) AS n FROM ex WHERE NOT failed) WHERE n = 1")
def jn_asof_last_success(spark, sf_dir):
    return history.last_execution(executions(spark, sf_dir), successful=True).select("reference", "seq", "launch_ts")


@plans.query(f"""WITH {_EX}, d AS (SELECT user_id AS reference, min(ts) + INTERVAL 10 DAY AS done_ts FROM events GROUP BY 1),
j AS (SELECT ex.*, done_ts, coalesce(count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY reference ORDER BY launch_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS had
  FROM ex JOIN d USING (reference)),
f AS (SELECT reference, arg_min(seq, (launch_ts, seq)) AS first_seq FROM j WHERE launch_ts > done_ts GROUP BY 1)
SELECT seq, CAST(CASE WHEN seq = first_seq AND had THEN 0 WHEN failed THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM j LEFT JOIN f USING (reference)""")
def win_first_after_done(spark, sf_dir):
    runs = executions(spark, sf_dir)
    done = runs.groupBy("reference").agg((F.min("launch_ts") + F.expr("INTERVAL 10 DAY")).alias("done_ts"))
    return history.first_after_done(runs, done).select("seq", "exit_code")


@plans.query("""SELECT o_orderstatus AS name, stage, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY stage) AS INTEGER) AS version,
  stage = max(stage) OVER (PARTITION BY o_orderstatus) AS final FROM (SELECT DISTINCT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS stage FROM orders)""")
def win_output_version(spark, sf_dir):
    outputs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name"), F.year("o_orderdate").alias("stage")).distinct()
    return history.output_versions(outputs)


def instances(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HHmmss.SSSSSS"))
    path = F.when(F.col("event_id") % 11 == 0, "file://g/runs/unnamed").otherwise(F.concat(F.lit("file://g/runs/u"), "user_id", F.lit("-"), stamp, F.lit(".instance")))
    return table(spark, sf_dir, "events").select(F.md5(F.col("user_id").cast("string")).alias("memo_hash"), path.alias("instance"), "event_id")


_LATEST = """last AS (SELECT md5(CAST(user_id AS VARCHAR)) AS memo_hash, 'file://g/runs/u' || user_id || '-' || strftime(max(ts), '%Y-%m-%dT%H%M%S.%f') || '.instance' AS instance
  FROM events WHERE event_id % 11 <> 0 GROUP BY user_id)"""


@plans.query(f"WITH {_LATEST} SELECT * FROM last")
def win_latest_instance(spark, sf_dir):
    return history.latest_instance(instances(spark, sf_dir), by="memo_hash").select("memo_hash", "instance")


@plans.query(f"WITH {_LATEST} SELECT s_suppkey, instance AS found_instance FROM supplier LEFT JOIN last ON memo_hash = md5(CAST(s_suppkey * 2 AS VARCHAR))")
def jn_memo_lookup(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select("s_suppkey", F.md5((F.col("s_suppkey") * 2).cast("string")).alias("memo_hash"))
    return history.memo_lookup(nodes, instances(spark, sf_dir)).select("s_suppkey", "found_instance")


@plans.query("SELECT user_id AS stage, event_type AS name, CAST(max(event_id % 12) AS INTEGER) AS iteration FROM events GROUP BY 1, 2")
def win_latest_iteration(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stage"), F.col("event_type").alias("name"), (F.col("event_id") % 12).cast("string").alias("iteration"))
    return graph.latest_iterations(rows)


@plans.query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.user_id AS reference, p.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS next_seq, min(b.ts) AS next_start
FROM p LEFT JOIN b ON b.user_id = p.user_id AND b.ts > p.ts GROUP BY 1, 2""")
def jn_asof_green(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.where("event_type = 'signup'").select(F.col("user_id").alias("reference"), "event_id", "ts")
    bought = executions(spark, sf_dir).join(events.where("event_type = 'purchase'").select(F.col("event_id").alias("seq")), "seq", "left_semi")
    return history.next_success(points, bought).select("reference", "event_id", "next_seq", "next_start")


_OVERLAP = f"""WITH {_EX}, q AS (SELECT reference AS producer, launch_ts AS a, CASE WHEN seq % 50 = 0 THEN NULL ELSE finish_ts END AS b, failed FROM ex),
w AS (SELECT user_id + 1 AS consumer, user_id AS producer, min(ts) + INTERVAL 5 DAY AS since, max(ts) - INTERVAL 2 DAY AS until, user_id % 3 <> 0 AS repeating FROM events GROUP BY user_id),
h AS (SELECT consumer, producer, greatest(0.5, date_diff('microsecond', greatest(a, since), least(coalesce(b, until), until)) / 1e6) AS s,
  CASE WHEN NOT repeating THEN 'succeed' WHEN b IS NULL THEN 'unknown' WHEN NOT failed THEN 'succeed' ELSE 'fail' END AS k
  FROM q JOIN w USING (producer) WHERE a < until AND (b IS NULL OR b > since)),
o AS (SELECT consumer, producer, sum(CASE WHEN k = 'succeed' THEN s ELSE 0 END) AS succeed_s, sum(CASE WHEN k = 'fail' THEN s ELSE 0 END) AS fail_s,
  sum(CASE WHEN k = 'unknown' THEN s ELSE 0 END) AS unknown_s FROM h GROUP BY 1, 2)
"""


def overlaps(spark, sf_dir):
    runs = executions(spark, sf_dir)
    stop = F.when(F.col("seq") % 50 != 0, history.finished_at())
    quanta = runs.select(F.col("reference").alias("producer"), F.col("launch_ts").alias("start"), stop.alias("stop"), "exit_code")
    windows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("producer")).agg(
        (F.min("ts") + F.expr("INTERVAL 5 DAY")).alias("since"), (F.max("ts") - F.expr("INTERVAL 2 DAY")).alias("now")
    )
    return history.clipped_overlap(quanta, windows.withColumns({"consumer": F.col("producer") + 1, "repeating": F.col("producer") % 3 != 0}))


@plans.query(_OVERLAP + "SELECT consumer, producer, round(succeed_s, 6) AS succeed_s, round(fail_s, 6) AS fail_s, round(unknown_s, 6) AS unknown_s FROM o")
def jn_interval_overlap(spark, sf_dir):
    return overlaps(spark, sf_dir).select("consumer", "producer", *[F.round(c, 6).alias(c) for c in ("succeed_s", "fail_s", "unknown_s")])


@plans.query(_OVERLAP + """SELECT consumer % 7 AS consumer, round(min(succeed_s + fail_s + unknown_s), 6) AS min_s, round(max(succeed_s + fail_s + unknown_s), 6) AS max_s,
  round(sum(succeed_s + fail_s + unknown_s), 6) AS sum_s, round(avg(succeed_s + fail_s + unknown_s), 6) AS avg_s, round(sum(succeed_s), 6) AS succeed_sum_s,
  round(max(succeed_s), 6) AS succeed_max_s, round(sum(unknown_s), 6) AS unknown_sum_s FROM o GROUP BY consumer % 7""")
def agg_producer_times(spark, sf_dir):
    times = history.producer_times(overlaps(spark, sf_dir).withColumn("consumer", F.col("consumer") % 7))
    return times.select("consumer", *[F.round(c, 6).alias(c) for c in times.columns if c != "consumer"])


@plans.query(_OVERLAP + "SELECT consumer % 7 AS consumer, arg_max(producer, (succeed_s, -producer)) AS producer FROM o GROUP BY 1")
def topk_producer(spark, sf_dir):
    return history.top_producer(overlaps(spark, sf_dir).withColumn("consumer", F.col("consumer") % 7)).select("consumer", "producer")


def _times(spark, days=(5, 10, 15)):
    return spark.sql("SELECT explode(array(" + ", ".join(f"timestamp_ntz'2024-01-{d:02d} 00:00:00'" for d in days) + ")) AS t")


@plans.query(f"""WITH {_EX}, g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28', INTERVAL 2 DAY)) AS t)
SELECT t, count(*) FILTER (WHERE finish_ts >= t + INTERVAL 1 SECOND) AS running, count(*) FILTER (WHERE finish_ts <= t) AS finished
FROM g JOIN ex ON launch_ts <= t + INTERVAL 1 SECOND GROUP BY t""")
def jn_point_in_interval(spark, sf_dir):
    span = spark.sql("SELECT timestamp_ntz'2024-01-02 00:00:00' AS start, timestamp_ntz'2024-01-28 00:00:00' AS end")
    return history.running_at(executions(spark, sf_dir), history.time_grid(span, "2 DAYS"))


@plans.query("""WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS t)
SELECT t, e.event_type, (SELECT count(*) FROM events v WHERE v.event_type = e.event_type AND date_trunc('day', v.ts) = t) AS n_events
FROM g, (SELECT DISTINCT event_type FROM events) e""")
def jn_cross_grid(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    span = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS start, timestamp_ntz'2024-01-30 00:00:00' AS end")
    counts = events.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    grid = events.select("event_type").distinct().crossJoin(F.broadcast(history.time_grid(span, "1 DAY")))  # thirty days
    return grid.join(counts, ["event_type", "t"], "left").select("t", "event_type", F.coalesce("n", F.lit(0)).alias("n_events"))


def spans(spark, sf_dir, every=True):
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct()
    depth = nodes.withColumn("level", (F.col("node") % 3).cast("int"))
    edges = nodes.where("node % 3 < 2").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return history.span(_times(spark), depth, edges, executions(spark, sf_dir), every)


_SPAN = f"""WITH {_EX}, u AS (SELECT DISTINCT user_id AS node FROM events),
t AS (SELECT unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-15']) AS t),
g0 AS (SELECT t, node, t AS green, 0.0::DOUBLE AS total FROM t, u WHERE node % 3 = 0),
g1 AS (SELECT g.t, reference AS node, g.node AS src, arg_min(finish_ts, (launch_ts, seq)) AS green, any_value(g.green) AS before, any_value(total) AS total
  FROM g0 g JOIN ex ON reference = g.node + 1 AND launch_ts > g.green AND NOT failed GROUP BY 1, 2, 3),
s1 AS (SELECT t, node, src, green, total + date_diff('microsecond', before, green) / 1e6 AS total FROM g1),
g2 AS (SELECT g.t, reference AS node, g.node AS src, arg_min(finish_ts, (launch_ts, seq)) AS green, any_value(g.green) AS before, any_value(total) AS total
  FROM s1 g JOIN ex ON reference = g.node + 1 AND launch_ts > g.green AND NOT failed GROUP BY 1, 2, 3),
s2 AS (SELECT t, node, src, green, total + date_diff('microsecond', before, green) / 1e6 AS total FROM g2)
"""


@plans.query(_SPAN + """SELECT t, node, green, NULL::BIGINT AS span_node, 0.0::DOUBLE AS total_span FROM g0
UNION ALL SELECT t, node, green, src, round(total, 6) FROM s1 UNION ALL SELECT t, node, green, src, round(total, 6) FROM s2""")
def gr_span_calc(spark, sf_dir):
    return spans(spark, sf_dir).withColumn("total_span", F.round("total_span", 6))


@plans.query(_SPAN + "SELECT t, round(max(total), 6) AS span, count(*) AS n_leaves FROM s2 GROUP BY t")
def win_span_recurrence(spark, sf_dir):
    leaves = table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct().where("node % 3 = 2")
    return history.graph_span(spans(spark, sf_dir), leaves).withColumn("span", F.round("span", 6))


@plans.query(_SPAN + """, gs AS (SELECT t, max(total) AS span FROM s2 GROUP BY t)
SELECT (SELECT round(date_diff('microsecond', min(launch_ts), max(finish_ts)) / 1e6, 6) FROM ex) AS makespan_s,
  round(arg_min(span, t), 6) AS first_response_s, round(min(span), 6) AS best_response_s FROM gs""")
def agg_kpis(spark, sf_dir):
    leaves = table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct().where("node % 3 = 2")
    found = history.kpis(history.graph_span(spans(spark, sf_dir), leaves), executions(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@plans.query("""WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT date_diff('microsecond', ts, now) / 1e6 AS age FROM events, n WHERE event_type = 'error')
SELECT count(*) FILTER (WHERE age BETWEEN 0 AND 86400) AS live, count(*) FILTER (WHERE age BETWEEN 0 AND 600) = 0 AS stable FROM e""")
def agg_stability(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    errors = events.where("event_type = 'error'").select("ts").crossJoin(F.broadcast(now))  # one row
    return history.stability(errors, F.col("now"), 600, 86_400)


@plans.query("""WITH r AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 20 END AS guess, (event_id % 4000 + 1) * 30.0::DOUBLE AS p FROM events)
SELECT seq, round(CASE WHEN exit_code = 0 THEN guess WHEN guess < p THEN guess ELSE p + greatest(1.0, CASE WHEN p <= 600 THEN least(60.0, 1.5 * p)
  WHEN p <= 3600 THEN least(600.0, 1.5 * p) WHEN p <= 43200 THEN 1800.0 WHEN p <= 86400 THEN 3600.0 ELSE least(14400.0, 1.5 * p) END) END, 4) AS next_s FROM r""")
def st_eri_decide(spark, sf_dir):
    guess = F.when(F.col("seq") % 5 != 0, F.col("run_s") * 20)
    rows = executions(spark, sf_dir).select("seq", "exit_code", guess.alias("guess"), ((F.col("seq") % 4000 + 1) * F.lit(30.0)).alias("p"))
    return history.next_interval(rows).select("seq", F.round("next_s", 4).alias("next_s"))


@plans.query("""WITH t AS (SELECT event_id AS task, event_type, 1700000000 + event_id AS s FROM events)
SELECT task, CAST(to_timestamp(s) AT TIME ZONE 'UTC' AS TIMESTAMP) AS wait, CASE WHEN event_type IN ('view', 'click', 'error') THEN CAST(to_timestamp(s + 5) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS execute,
  CASE WHEN event_type IN ('click', 'error') THEN CAST(to_timestamp(s + 9) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS complete FROM t""")
def st_task_events(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "view", "running").when(kind == "click", "finished").when(kind == "error", "failed").otherwise("waiting_on_resource")
    at = lambda n: (F.col("event_id") + 1_700_000_000 + n).cast("string")
    tasks = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task"), state.alias("state"), at(0).alias("submitted"), at(5).alias("started"),
        F.when(kind == "view", "none").otherwise(at(9)).alias("finished"),
    )
    return history.task_events(tasks).select("task", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("wait", "execute", "complete")])


@plans.query("""WITH u AS (SELECT user_id AS reference, event_id AS seq, event_type IN ('signup', 'view') AS q, event_type IN ('view', 'click') AS r, event_type IN ('click', 'error') AS s,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS code FROM events)
SELECT reference, seq, 0 AS step, 'queue-start' AS event, NULL::INTEGER AS exit_code FROM u WHERE q UNION ALL SELECT reference, seq, 1, 'queue-stop', NULL FROM u WHERE r
UNION ALL SELECT reference, seq, 2, 'run-start', NULL FROM u WHERE r UNION ALL SELECT reference, seq, 3, 'run-stop', code FROM u WHERE s""")
def st_event_router(spark, sf_dir):
    kind = F.col("event_type")
    updates = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("reference"), F.col("event_id").alias("seq"), kind.isin("signup", "view").alias("queued"), kind.isin("view", "click").alias("started"),
        kind.isin("click", "error").alias("stopped"), F.when(kind == "error", 1).otherwise(0).alias("exit_code"),
    )
    return history.routed_events(updates)
