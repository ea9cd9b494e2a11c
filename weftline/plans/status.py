"""Status queries: orders as components, customers' nations as stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import status as ops
from weftline.plans.registry import Plans
from weftline.sources.tables import table

plans = Plans()

_STATES = """
st AS (SELECT o_orderkey AS reference, CAST(o_custkey % 6 AS INTEGER) AS stage, CASE WHEN o_custkey % 6 = 5 THEN 'finished' WHEN o_custkey % 6 = 4 AND o_orderstatus = 'P' THEN 'finished'
  WHEN o_custkey % 6 = 3 AND o_orderstatus <> 'F' THEN 'checking' WHEN o_custkey % 6 = 2 AND o_orderstatus = 'P' THEN 'component_shutdown'
  WHEN o_custkey % 6 = 2 THEN 'suspended' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'running'
  WHEN o_custkey % 6 = 0 THEN 'waiting_on_resource' ELSE 'failed' END AS state,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'waiting_on_resource' WHEN o_orderpriority = '2-HIGH' THEN 'running' ELSE 'finished' END AS last_state,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Killed' WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'Success' END AS engine_reason,
  o_orderkey % 13 = 0 AS is_waiting, o_orderkey % 17 AS task_launches FROM orders)"""


def states(spark, sf_dir):
    stage, kind = F.col("o_custkey") % 6, F.col("o_orderstatus")
    state = (
        F.when(stage == 5, "finished").when((stage == 4) & (kind == "P"), "finished").when((stage == 3) & (kind != "F"), "checking")
        .when((stage == 2) & (kind == "P"), "component_shutdown").when(stage == 2, "suspended").when(kind == "F", "finished")
        .when(kind == "O", "running").when(stage == 0, "waiting_on_resource").otherwise("failed")
    )
    last = F.when(F.col("o_orderpriority") == "1-URGENT", "waiting_on_resource").when(F.col("o_orderpriority") == "2-HIGH", "running").otherwise("finished")
    key = F.col("o_orderkey")
    reason = F.when(key % 9 == 0, "Killed").when(key % 9 != 1, "Success")
    return table(spark, sf_dir, "orders").select(
        key.alias("reference"), stage.cast("int").alias("stage"), state.alias("state"), last.alias("last_state"),
        reason.alias("engine_reason"), (key % 13 == 0).alias("is_waiting"), (key % 17).alias("task_launches"),
    )


@plans.query(f"WITH {_STATES} SELECT * FROM st WHERE state = 'failed' OR engine_reason <> 'Success' OR is_waiting OR last_state = 'waiting_on_resource' OR task_launches = 0")
def flt_status_default(spark, sf_dir):
    return ops.filtered(states(spark, sf_dir))


@plans.query(f"WITH {_STATES} SELECT reference, state FROM st WHERE state NOT IN ('finished', 'failed') AND last_state = 'running'")
def flt_status_executing(spark, sf_dir):
    return ops.filtered(ops.filtered(states(spark, sf_dir), ("executing",)), ("not-finished",)).select("reference", "state")


@plans.query(f"WITH {_STATES} SELECT * FROM st WHERE stage IN (1, 3)")
def flt_stage(spark, sf_dir):
    return ops.filtered(states(spark, sf_dir), ("all",), (1, 3))


@plans.query(f"WITH {_STATES} SELECT 'o' || reference AS label, reference, state, last_state FROM st")
def prj_category_columns(spark, sf_dir):
    labelled = states(spark, sf_dir).withColumn("label", F.concat(F.lit("o"), "reference"))
    return ops.category_columns(labelled, ["task"])


@plans.query(f"WITH {_STATES} SELECT stage, round(avg(CASE WHEN state = 'finished' THEN 1.0 ELSE 0.0 END), 9) AS completion FROM st GROUP BY stage")
def agg_stage_completion(spark, sf_dir):
    return ops.stage_completion(states(spark, sf_dir)).withColumn("completion", F.round("completion", 9))


@plans.query(f"""WITH {_STATES}, p AS (SELECT stage, avg(CASE WHEN state = 'finished' THEN 1.0 ELSE 0.0 END) AS c FROM st GROUP BY stage)
SELECT round(sum(CASE WHEN c = 1 THEN (stage + 1) / 21.0 ELSE c * (stage + 1) / 21.0 END), 9) AS progress FROM p""")
def agg_total_progress(spark, sf_dir):
    stages = ops.stage_completion(states(spark, sf_dir)).select(
        ((F.col("stage") + 1) / 21.0).alias("weight"), F.col("completion").alias("progress"), (F.col("completion") == 1).alias("finished")
    )
    return ops.total_progress(stages).withColumn("progress", F.round("progress", 9))


@plans.query(f"""WITH {_STATES} SELECT stage, CASE WHEN bool_or(state = 'waiting_on_resource') THEN 'waiting_on_resource' WHEN bool_or(state = 'failed') THEN 'failed'
  WHEN bool_or(state IN ('running', 'checking')) THEN 'running' WHEN bool_or(state = 'component_shutdown') THEN 'component_shutdown'
  WHEN count(DISTINCT state) = 1 THEN min(state) ELSE 'inconsistent' END AS state FROM st GROUP BY stage""")
def agg_stage_state(spark, sf_dir):
    return ops.stage_state(states(spark, sf_dir))


@plans.query(f"""WITH {_STATES} SELECT stage, bool_or(state NOT IN ('finished', 'failed', 'component_shutdown')) AS in_transit,
  bool_and(state IN ('finished', 'failed', 'component_shutdown')) AS finished FROM st GROUP BY stage""")
def agg_stages_in_transit(spark, sf_dir):
    return ops.stages_in_transit(states(spark, sf_dir))


@plans.query(f"""WITH {_STATES} SELECT stage, coalesce(string_agg(CAST(reference AS VARCHAR), ' ' ORDER BY reference) FILTER (WHERE state = 'running'), '') AS running,
  coalesce(string_agg(CAST(reference AS VARCHAR), ' ' ORDER BY reference) FILTER (WHERE state = 'finished'), '') AS finished,
  coalesce(string_agg(CAST(reference AS VARCHAR), ' ' ORDER BY reference) FILTER (WHERE state IN ('failed', 'component_shutdown')), '') AS failed FROM st GROUP BY stage""")
def agg_running(spark, sf_dir):
    lists = ops.lists_by_state(states(spark, sf_dir))
    return lists.select("stage", *[F.array_join(c, " ").alias(c) for c in ("running", "finished", "failed")])


@plans.query(f"WITH {_STATES} SELECT stage, NOT bool_or(state = 'finished') AS failed FROM st WHERE stage = 5 AND reference % 3 = 0 GROUP BY stage")
def agg_final_stage(spark, sf_dir):
    rows = states(spark, sf_dir)
    return ops.final_stage_failed(rows, rows.where("reference % 3 = 0").select("reference"))


@plans.query("""SELECT n_regionkey AS stage, string_agg(n_name || '=' || CASE WHEN n_nationkey % 2 = 0 THEN 'running' ELSE 'finished' END, ',' ORDER BY n_name) AS states FROM nation GROUP BY 1""")
def src_states_map(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("stage"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "running").otherwise("finished").alias("state"))
    text = F.transform(F.sort_array(F.map_entries("states")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return ops.states_map(rows).select("stage", F.array_join(text, ",").alias("states"))


@plans.query(f"WITH {_STATES} SELECT reference, state, o_totalprice AS wait_s FROM st JOIN orders ON o_orderkey = reference")
def jn_state_engine(spark, sf_dir):
    plain = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("reference"), F.col("o_totalprice").alias("wait_s"))
    repeating = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("reference"), F.col("o_totalprice").alias("wait_s"))
    return states(spark, sf_dir).select("reference", "state").join(plain.unionByName(repeating), "reference")


def _work(spark, sf_dir):
    """Parts and orders as components: a line is an edge from its part to its order."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.concat(F.lit("p"), "p_partkey")
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").select(
        part.alias("reference"), F.lit(0).alias("stage"), F.when(size < 2, "failed").when(size < 12, "component_shutdown").otherwise("finished").alias("state"),
        F.lit(True).alias("staged"), (size % 2 == 0).alias("is_replica"), F.lit(False).alias("is_aggregate"),
    )
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), key).alias("reference"), F.when(key % 2 == 0, 0).otherwise(1).alias("stage"), F.lit("initialising").alias("state"),
        F.lit(False).alias("staged"), F.lit(False).alias("is_replica"), (key % 3 == 0).alias("is_aggregate"),
    )
    edges = lines.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("dst"))
    return parts, orders, edges


@plans.query("""WITH e AS (SELECT l_orderkey, p_size < 2 AS f, p_size BETWEEN 2 AND 11 AS s, p_size % 2 = 0 AS r FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT l_orderkey, bool_or(f) AS failed, bool_or(s) AS any_shut, bool_or(s AND NOT r) AS any_single, bool_and(s) FILTER (WHERE r) AS all_rep FROM e GROUP BY 1)
SELECT 'o' || l_orderkey AS dst, failed OR CASE WHEN l_orderkey % 3 = 0 THEN any_single OR coalesce(all_rep, FALSE) ELSE any_shut END AS shut
FROM k JOIN orders ON o_orderkey = l_orderkey""")
def agg_shutdown_rule(spark, sf_dir):
    parts, orders, edges = _work(spark, sf_dir)
    return ops.shutdown_rule(parts.unionByName(orders), edges)


@plans.query("""SELECT 'o' || o_orderkey AS reference FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_orderkey = o_orderkey AND CASE WHEN o_orderkey % 2 = 0 THEN p_size % 10 = 0 ELSE p_size % 10 = 1 END)""")
def jn_dependencies(spark, sf_dir):
    parts, orders, edges = _work(spark, sf_dir)
    size = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("reference"), "p_size")
    running = parts.join(size, "reference").select(
        "reference", "stage", F.when(F.col("p_size") % 10 == 1, "running").otherwise("finished").alias("state"), (F.col("p_size") % 10 != 0).alias("staged")
    )
    return ops.ready(running.unionByName(orders.select("reference", "stage", "state", "staged")), edges)


@plans.query("""WITH r AS (SELECT event_id AS task, ['Success', 'KnownIssue', 'SystemIssue', 'SubmissionFailed', 'Killed', 'ResourceExhausted'][event_id % 6 + 1] AS reason,
  event_id % 5 AS restarts, event_id % 7 AS resubmissions, CASE WHEN event_id % 4 = 0 THEN 2 END AS most,
  [NULL, 'possible', 'unavailable', 'not-required', 'not-possible'][user_id % 5 + 1] AS hook FROM events),
d AS (SELECT *, reason IN ('KnownIssue', 'ResourceExhausted') AS listed, coalesce(most, CASE WHEN hook IS NULL THEN 3 ELSE -1 END) AS cap FROM r),
x AS (SELECT task, reason, CASE WHEN listed AND cap >= 0 AND restarts + 1 > cap THEN 'RestartMaxAttemptsExceeded'
  WHEN listed AND coalesce(hook, 'unavailable') IN ('possible', 'unavailable') THEN 'RestartInitiated' WHEN listed AND hook = 'not-required' THEN 'RestartNotRequired'
  WHEN listed THEN 'RestartCouldNotInitiate' WHEN reason = 'SubmissionFailed' AND resubmissions < 5 AND NOT (cap >= 0 AND restarts + 1 > cap) THEN 'RestartInitiated'
  WHEN reason = 'SubmissionFailed' THEN 'RestartMaxAttemptsExceeded' ELSE 'RestartCouldNotInitiate' END AS decision FROM d)
SELECT task, decision, CASE WHEN decision = 'RestartInitiated' THEN NULL WHEN reason = 'Success' THEN 'finished' WHEN reason = 'Killed' THEN 'component_shutdown' ELSE 'failed' END AS final_state FROM x""")
def st_restart_policy(spark, sf_dir):
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    key, user = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(
        key.alias("task"), pick(["Success", "KnownIssue", "SystemIssue", "SubmissionFailed", "Killed", "ResourceExhausted"], key % 6).alias("reason"),
        (key % 5).alias("restarts"), (key % 7).alias("resubmissions"), F.when(key % 4 == 0, 2).alias("max_restarts"),
        pick([None, "possible", "unavailable", "not-required", "not-possible"], user % 5).alias("hook"), F.lit(5).alias("max_resubmissions"),
        F.array(F.lit("KnownIssue"), F.lit("ResourceExhausted")).alias("restart_on"), F.array(F.lit("Killed")).alias("shutdown_on"),
    )
    return ops.restart_policy(rows).select("task", "decision", "final_state")
