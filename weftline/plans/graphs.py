"""Graph queries: nations as components, in a binary tree with an edge more to some grandchildren.

Edges from key arithmetic: ``n -> 2n + 1``, ``n -> 2n + 2`` and ``n -> 4n + 3``. Larger
graphs come from lines (orders and parts).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators import graph as ops
from weftline.plans.registry import Plans
from weftline.sources.tables import table

plans = Plans()

_G = """
n AS (SELECT n_nationkey AS node, CASE n_nationkey WHEN 1 THEN 3 WHEN 2 THEN 5 END AS replicas, n_nationkey IN (3, 6) AS aggregates FROM nation),
e AS (SELECT node AS src, unnest([2 * node + 1, 2 * node + 2, 4 * node + 3]) AS dst FROM n),
edges AS (SELECT DISTINCT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM e WHERE dst IN (SELECT node FROM n))"""
_WAYS = _G + ", ways AS (SELECT src, dst FROM edges UNION SELECT w.src, e.dst FROM ways w JOIN edges e ON e.src = w.dst)"


def nodes(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(key.alias("node"), F.when(key == 1, 3).when(key == 2, 5).alias("replicas"), key.isin(3, 6).alias("aggregates"))


def edges(spark, sf_dir):
    n = nodes(spark, sf_dir).select("node")
    made = n.select(F.col("node").alias("src"), F.explode(F.array(*[(F.col("node") * a + b).cast("int") for a, b in ((2, 1), (2, 2), (4, 3))])).alias("dst"))
    return made.join(n.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


@plans.query(f"""WITH RECURSIVE {_G}, r AS (SELECT node, 0 AS d FROM n WHERE node NOT IN (SELECT dst FROM edges) UNION ALL SELECT dst, d + 1 FROM r JOIN edges ON src = node)
SELECT node, CAST(max(d) AS INTEGER) AS level FROM r GROUP BY node""")
def srt_topological(spark, sf_dir):
    return ops.levels(nodes(spark, sf_dir), edges(spark, sf_dir))


@plans.query("SELECT DISTINCT 'p' || l_partkey AS src, 'o' || l_orderkey AS dst, 2 AS length FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def gr_build(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("reference"), F.lit(0).alias("stage"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("reference"), F.lit(1).alias("stage"))
    used = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("reference"), F.concat(F.lit("p"), "l_partkey").alias("producer"))
    return ops.build_edges(parts.unionByName(orders), used)


@plans.query(f"WITH {_G} SELECT dst AS node, CAST(count(*) AS BIGINT) AS n_producers FROM edges GROUP BY dst")
def gr_producers(spark, sf_dir):
    return edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_producers"))


@plans.query(f"WITH {_G} SELECT node FROM n WHERE node IN (SELECT dst FROM edges) AND node NOT IN (SELECT src FROM edges)")
def flt_leaf_nodes(spark, sf_dir):
    return ops.leaves(nodes(spark, sf_dir), edges(spark, sf_dir))


@plans.query(f"WITH {_G} SELECT node FROM n WHERE replicas IS NULL")
def flt_sources(spark, sf_dir):
    return nodes(spark, sf_dir).where("replicas IS NULL OR replicas = 0").select("node")


@plans.query(f"WITH RECURSIVE {_WAYS} SELECT src, dst FROM edges WHERE NOT EXISTS (SELECT 1 FROM edges a JOIN ways w ON w.src = a.dst WHERE a.src = edges.src AND w.dst = edges.dst)")
def gr_transitive_reduction(spark, sf_dir):
    return ops.transitive_reduction(edges(spark, sf_dir)).select("src", "dst")


@plans.query(f"""WITH RECURSIVE {_WAYS} SELECT dst AS node FROM ways WHERE src = 1 AND dst IN (SELECT src FROM ways WHERE dst = 15) UNION SELECT 1 UNION SELECT 15""")
def gr_spanning_subgraph(spark, sf_dir):
    return ops.between(edges(spark, sf_dir), 1, 15)


@plans.query(f"WITH RECURSIVE {_WAYS} SELECT src AS root, dst AS node FROM ways WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT node, node FROM n WHERE node NOT IN (SELECT dst FROM edges)")
def gr_root_leaf_graphs(spark, sf_dir):
    return ops.root_leaf_sets(nodes(spark, sf_dir), edges(spark, sf_dir))


_PATHS = f"""WITH RECURSIVE {_G}, p AS (SELECT [node] AS path, node AS last FROM n WHERE node NOT IN (SELECT dst FROM edges)
  UNION ALL SELECT list_append(path, dst), dst FROM p JOIN edges ON src = last), paths AS (SELECT path FROM p WHERE last NOT IN (SELECT src FROM edges))"""


@plans.query(_PATHS + "SELECT array_to_string(path, '>') AS path FROM paths")
def gr_leaf_paths(spark, sf_dir):
    return ops.leaf_paths(nodes(spark, sf_dir), edges(spark, sf_dir)).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


_BLOCKS = _PATHS + """, o AS (SELECT node, list_sort(list(DISTINCT id)) AS ids FROM (SELECT array_to_string(path, '>') AS id, unnest(path) AS node FROM paths) GROUP BY node),
blocks AS (SELECT node, min(node) OVER (PARTITION BY ids) AS block FROM o)"""


@plans.query(_BLOCKS + "SELECT node, block FROM blocks")
def jn_pairwise_equiv(spark, sf_dir):
    return ops.equivalent(ops.leaf_paths(nodes(spark, sf_dir), edges(spark, sf_dir)))


@plans.query(f"WITH {_G} SELECT DISTINCT CAST(src % 5 AS INTEGER) AS src, CAST(dst % 5 AS INTEGER) AS dst FROM edges WHERE src % 5 <> dst % 5")
def gr_block_replication(spark, sf_dir):
    blocks = nodes(spark, sf_dir).select("node", (F.col("node") % 5).cast("int").alias("block"))
    return ops.quotient(edges(spark, sf_dir), blocks)


@plans.query(f"""WITH RECURSIVE {_G}, r AS (SELECT node, 0 AS d FROM n WHERE node NOT IN (SELECT dst FROM edges) UNION ALL SELECT dst, d + 1 FROM r JOIN edges ON src = node),
l AS (SELECT node, max(d) AS level FROM r GROUP BY node) SELECT CAST(node % 5 AS INTEGER) AS block, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY level, node) AS members FROM l GROUP BY 1""")
def gr_block_members(spark, sf_dir):
    blocks = nodes(spark, sf_dir).select("node", (F.col("node") % 5).cast("int").alias("block"))
    members = ops.block_members(blocks, ops.levels(nodes(spark, sf_dir), edges(spark, sf_dir)))
    return members.select("block", F.array_join(F.col("members").cast("array<string>"), " ").alias("members"))


@plans.query("""WITH RECURSIVE c AS (SELECT c_custkey AS node FROM customer), f AS (SELECT node, CASE WHEN node % 10 = 0 THEN node ELSE node - 1 END AS parent FROM c)
SELECT node, node - node % 10 AS component FROM f""")
def gr_components(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    chain = customers.where("node % 10 <> 0").select((F.col("node") - 1).alias("src"), F.col("node").alias("dst"))
    return ops.components(customers, chain)


_REPLICAS = _G + """, r AS (SELECT node, replicas AS v FROM n WHERE replicas IS NOT NULL UNION SELECT dst, v FROM r JOIN n USING (node) JOIN edges ON src = r.node WHERE NOT n.aggregates),
k AS (SELECT n.node, max(v) AS replicas, any_value(aggregates) AS aggregates FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node)"""


@plans.query(f"WITH RECURSIVE {_REPLICAS} SELECT node, replicas FROM k")
def gr_propagate_replicate(spark, sf_dir):
    return ops.propagate_replicas(nodes(spark, sf_dir), edges(spark, sf_dir))


def clones(spark, sf_dir):
    """A node that aggregates is not cloned itself."""
    counted = ops.propagate_replicas(nodes(spark, sf_dir), edges(spark, sf_dir)).join(nodes(spark, sf_dir).select("node", "aggregates"), "node")
    return ops.replicated(counted.withColumn("replicas", F.when(~F.col("aggregates"), F.col("replicas"))))


_CLONES = _REPLICAS + """, c AS (SELECT node, unnest(CASE WHEN replicas IS NULL OR aggregates THEN [NULL] ELSE range(replicas) END) AS replica FROM k),
clones AS (SELECT node, CAST(replica AS INTEGER) AS replica, node || coalesce(CAST(replica AS VARCHAR), '') AS name FROM c)"""


@plans.query(f"WITH RECURSIVE {_CLONES} SELECT node, replica, name FROM clones")
def udtf_replicate(spark, sf_dir):
    return clones(spark, sf_dir).select("node", "replica", "name")


@plans.query(f"""WITH RECURSIVE {_CLONES} SELECT e.src, e.dst, a.name AS src_name, b.name AS dst_name FROM edges e JOIN clones a ON a.node = e.src JOIN clones b ON b.node = e.dst
WHERE a.replica IS NULL OR b.replica IS NULL OR a.replica = b.replica""")
def gr_apply_replicate(spark, sf_dir):
    return ops.replicated_edges(edges(spark, sf_dir), clones(spark, sf_dir))


@plans.query(f"WITH RECURSIVE {_CLONES} SELECT node, string_agg(name || '/out.dat', ' ' ORDER BY replica) AS refs FROM clones GROUP BY node")
def agg_replica_fanin(spark, sf_dir):
    return ops.fan_in_references(clones(spark, sf_dir), "/out.dat")


#: The first two levels only, by hand: SQL that covers nodes 0 to 2 of ``gr_memo_hash``.
MEMO_TOP = f"""WITH {_G}, t AS (SELECT node, 'run ' || node AS command, 'image' || node % 3 AS image, CASE WHEN node % 4 = 1 THEN md5('w' || node) END AS content FROM n),
h0 AS (SELECT node, md5(command || chr(1) || image || chr(1)) AS h FROM t WHERE node = 0), r0 AS (SELECT node, coalesce(content, h) AS x FROM t JOIN h0 USING (node)),
i1 AS (SELECT dst AS node, string_agg(x, ',' ORDER BY x) AS i FROM edges JOIN r0 ON src = r0.node WHERE dst IN (1, 2) GROUP BY 1),
h1 AS (SELECT node, md5(command || chr(1) || image || chr(1) || i) AS h FROM t JOIN i1 USING (node))
SELECT node, h AS memo_hash FROM h0 UNION ALL SELECT node, h FROM h1"""


@plans.query()
def gr_memo_hash(spark, sf_dir):
    node = F.col("node")
    tasks = nodes(spark, sf_dir).select(
        "node", F.concat(F.lit("run "), node).alias("command"), F.concat(F.lit("image"), node % 3).alias("image"),
        F.when(node % 4 == 1, F.md5(F.concat(F.lit("w"), node))).alias("content"),
    )
    return ops.memo_hashes(tasks, edges(spark, sf_dir))


@plans.query("SELECT p_partkey, md5(p_brand || chr(1) || p_type || chr(1) || p_size) AS digest FROM part")
def fn_md5_struct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", refs.struct_digest(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("digest"))


@plans.query("""WITH a AS (SELECT p_name || p_partkey AS path, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_name || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS v FROM part WHERE p_partkey % 3 <> 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS before, b.v AS after
FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.v <> b.v""")
def jn_config_diff(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    path = F.concat("p_name", "p_partkey").alias("path")
    one = parts.where("p_partkey % 3 <> 0").select(path, F.col("p_brand").alias("value"))
    two = parts.where("p_partkey % 3 <> 1").select(path, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("value"))
    return ops.config_diff(one, two)


@plans.query("""WITH n AS (SELECT n_regionkey AS stage, n_name AS name, n_nationkey AS k FROM nation), i AS (SELECT unnest(range(3)) AS i)
SELECT 'stage' || a.stage || '.' || i || '#' || a.name AS src, 'stage' || b.stage || '.' || i || '#' || b.name AS dst FROM i, n a JOIN n b ON b.k = a.k + 1 WHERE a.k % 5 <> 4
UNION ALL SELECT 'stage' || a.stage || '.' || (i - 1) || '#' || a.name, 'stage' || b.stage || '.' || i || '#' || b.name FROM i, n a JOIN n b ON b.k = a.k - 4 WHERE a.k % 5 = 4 AND i > 0""")
def gr_loop_instantiate(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    looped = nations.select(F.col("n_regionkey").alias("stage"), F.col("n_name").alias("name"))
    key, name = F.col("n_nationkey"), F.col("n_name")
    target = nations.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("consumer"))
    bound = nations.select(name.alias("producer"), F.when(key % 5 == 4, key - 4).otherwise(key + 1).alias("_k"), (key % 5 == 4).alias("loop")).join(target, "_k")
    made = [ops.next_iteration(looped, bound, i)[1] for i in range(3)]
    return made[0].union(made[1]).union(made[2])
