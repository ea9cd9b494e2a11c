"""Component graphs as node and edge tables (``src, dst``: producer, consumer).

Iteration goes level by level; each turn's rows are written to the shared folder, and the
number of turns is the depth of the graph, not its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.components import components as connected
from weftline.session import cut


def build_edges(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """``src, dst, length`` from each consumer's producers; unknown producers are left out.

    ``nodes``: ``reference, stage``; ``references``: ``reference, producer``.
    """
    made = nodes.select(F.col("reference").alias("producer"), F.col("stage").alias("_from"))
    used = references.select("reference", "producer").distinct().join(nodes.select("reference", "stage"), "reference")
    return used.join(made, "producer").select(
        F.col("producer").alias("src"), F.col("reference").alias("dst"), (F.col("stage") - F.col("_from") + 1).alias("length")
    )


def levels(nodes: DataFrame, edges: DataFrame, node: str = "node", most: int = 10_000) -> DataFrame:
    """``node, level``: the longest way from a source. A cycle is an error."""
    links = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select(F.col(node).alias("node")).distinct())
    found = None
    for level in range(most):
        # nodes without a producer among those that are left
        now = left.join(links.select(F.col("dst").alias("node")), "node", "left_anti")
        now = cut(now.withColumn("level", F.lit(level)))
        if now.isEmpty():
            if left.isEmpty():
                return found if found is not None else now
            raise ValueError("the graph has a cycle")
        found = now if found is None else found.unionByName(now)
        left = cut(left.join(now.select("node"), "node", "left_anti"))
        links = cut(links.join(now.select(F.col("node").alias("src")), "src", "left_anti"))
    raise ValueError(f"the graph is deeper than {most}")


def leaves(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes with producers and without consumers."""
    mine = nodes.select(F.col(node).alias("node"))
    return mine.join(edges.select(F.col("dst").alias("node")), "node", "left_semi").join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst, length``: all pairs with a way between them, and the fewest edges on it."""
    known = cut(edges.select("src", "dst").distinct().withColumn("length", F.lit(1)))
    newest, step = known, edges.select(F.col("src").alias("dst"), F.col("dst").alias("_to")).distinct()
    while not newest.isEmpty():
        further = newest.join(step, "dst").select("src", F.col("_to").alias("dst"), (F.col("length") + 1).alias("length")).distinct()
        newest = cut(further.join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        known = known.unionByName(newest)
    return known


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges that no longer way replaces."""
    ways = closure(edges).select(F.col("src").alias("_mid"), F.col("dst").alias("_end"))
    longer = edges.select("src", F.col("dst").alias("_mid")).join(ways, "_mid").select("src", F.col("_end").alias("dst")).distinct()
    return edges.join(longer, ["src", "dst"], "left_anti")


def between(edges: DataFrame, start, end) -> DataFrame:
    """Nodes on ways from ``start`` to ``end``, both included."""
    ways = closure(edges)
    ahead = ways.where(F.col("src") == start).select(F.col("dst").alias("node"))
    behind = ways.where(F.col("dst") == end).select(F.col("src").alias("node"))
    inner = ahead.join(behind, "node", "left_semi")
    ends = ways.where((F.col("src") == start) & (F.col("dst") == end)).select(F.explode(F.array("src", "dst")).alias("node"))
    return inner.union(ends).distinct()


def root_leaf_sets(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``root, node``: what each node without producers reaches, itself included."""
    mine = nodes.select(F.col(node).alias("node"))
    roots = mine.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").select(F.col("node").alias("root"))
    reached = closure(edges).select(F.col("src").alias("root"), F.col("dst").alias("node")).join(roots, "root", "left_semi")
    return reached.union(roots.select("root", "root"))


def leaf_paths(nodes: DataFrame, edges: DataFrame, node: str = "node", most: int = 1000) -> DataFrame:
    """``path``: every way from a root to a leaf, as an array. Their number may grow with a power of the depth."""
    mine = nodes.select(F.col(node).alias("node"))
    start = mine.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    ways = cut(start.select(F.array("node").alias("path"), F.col("node").alias("end")))
    ended = None
    for _ in range(most):
        more = ways.join(edges.select(F.col("src").alias("end"), "dst"), "end").where(~F.array_contains("path", F.col("dst")))
        whole = ways.join(edges.select(F.col("src").alias("end")), "end", "left_anti").select("path")
        ended = whole if ended is None else ended.union(whole)
        ways = cut(more.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end")))
        if ways.isEmpty():
            return ended
    raise ValueError(f"a way is longer than {most}")


def equivalent(paths: DataFrame) -> DataFrame:
    """``node, block``: nodes that lie on the same paths share the smallest of them as block.

    Nodes are grouped by the set of their paths, so no pairs are made.
    """
    named = paths.select(F.xxhash64("path").alias("_id"), F.explode("path").alias("node")).distinct()
    on = named.groupBy("node").agg(F.sort_array(F.collect_list("_id")).alias("_on"))
    return on.join(on.groupBy("_on").agg(F.min("node").alias("block")), "_on").select("node", "block")


def quotient(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct edges between blocks (``node, block``); edges inside one go."""
    a = blocks.select(F.col("node").alias("src"), F.col("block").alias("_a"))
    b = blocks.select(F.col("node").alias("dst"), F.col("block").alias("_b"))
    both = edges.join(a, "src").join(b, "dst").where("_a <> _b")
    return both.select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()


def block_members(blocks: DataFrame, node_levels: DataFrame) -> DataFrame:
    """``block, members``: the members in order of level, then name."""
    rows = blocks.join(node_levels, "node")
    return rows.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "node"))), lambda x: x["node"]).alias("members"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``node, component``: the smallest node of each weakly connected part."""
    reached = connected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    mine = nodes.select(F.col(node).alias("node"))
    return mine.join(reached, "node", "left").select("node", F.coalesce("least", "node").alias("component"))


# -- fan-out and fan-in ---------------------------------------------------------------


def propagate_replicas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, replicas``: the one count that a node has or gets from producers that do not aggregate.

    ``nodes``: ``node, replicas`` (NULL: none of its own), ``aggregates``. Two different
    counts are an error.
    """
    depth = cut(levels(nodes, edges))
    done = cut(nodes.limit(0).select("node", "replicas", "aggregates"))
    for level in range((depth.agg(F.max("level")).first()[0] or 0) + 1):
        here = depth.where(F.col("level") == level).join(nodes, "node")
        handed = edges.join(done.where("NOT aggregates").select(F.col("node").alias("src"), F.col("replicas").alias("_given")), "src")
        got = here.join(handed, F.col("node") == F.col("dst"), "left").groupBy("node").agg(
            F.collect_set("_given").alias("_given"), F.first("replicas").alias("_own"), F.first("aggregates").alias("aggregates")
        )
        every = F.array_distinct(F.array_compact(F.concat("_given", F.array("_own"))))
        clash = F.raise_error(F.concat(F.lit("replica counts differ at "), F.col("node").cast("string")))
        new = got.withColumn("_all", every).select("node", F.when(F.size("_all") > 1, clash).otherwise(F.get("_all", 0)).cast(nodes.schema["replicas"].dataType).alias("replicas"), "aggregates")
        done = cut(done.unionByName(new))
    return done.select("node", "replicas")


def replicated(nodes: DataFrame) -> DataFrame:
    """``node, replica, name``: nodes with a count as that many clones, named by their index."""
    index = F.when(F.col("replicas").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("replicas").cast("int") - 1))
    each = nodes.where("replicas IS NULL OR replicas > 0").select("*", F.explode(index).alias("replica"))
    return each.withColumn("name", F.concat(F.col("node").cast("string"), F.coalesce(F.col("replica").cast("string"), F.lit(""))))


def replicated_edges(edges: DataFrame, clones: DataFrame) -> DataFrame:
    """Edges between clones: replica to the same replica, all replicas to a fan-in, one to all replicas.

    ``clones``: ``node, replica, name, aggregates``. The node is part of every join key.
    """
    a = clones.select(F.col("node").alias("src"), F.col("replica").alias("_ra"), F.col("name").alias("src_name"))
    b = clones.select(F.col("node").alias("dst"), F.col("replica").alias("_rb"), F.col("name").alias("dst_name"))
    both = edges.join(a, "src").join(b, "dst")
    return both.where("_ra IS NULL OR _rb IS NULL OR _ra = _rb").select("src", "dst", "src_name", "dst_name")


def fan_in_references(clones: DataFrame, path: str = "") -> DataFrame:
    """``node, refs``: references to all replicas in order, by blanks, or by commas where a path ends in one."""
    sep = "," if path.endswith(",") else " "
    one = F.concat(F.col("name"), F.lit(path.rstrip(",")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("replica", one.alias("ref")))), lambda x: x["ref"])
    return clones.groupBy("node").agg(F.array_join(ordered, sep).alias("refs"))


# -- loops ----------------------------------------------------------------------------


def iteration_name(stage: Column, iteration: Column, name: Column) -> Column:
    return F.concat(F.lit("stage"), stage, F.lit("."), iteration, F.lit("#"), name)


def next_iteration(nodes: DataFrame, bindings: DataFrame, iteration: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one more iteration.

    ``nodes``: ``stage, name``; ``bindings``: ``consumer, producer, loop`` by name. A loop
    binding reads the iteration before (from the second on), any other the same one.
    """
    at = F.lit(iteration)
    made = nodes.select("stage", "name", at.alias("iteration"), iteration_name(F.col("stage"), at, F.col("name")).alias("reference"))
    of = lambda side, turn: nodes.select(F.col("name").alias(side), iteration_name(F.col("stage"), turn, F.col("name")).alias(f"_{side}"))
    same = bindings.where("NOT loop").join(of("producer", at), "producer").join(of("consumer", at), "consumer")
    if iteration:
        before = bindings.where("loop").join(of("producer", F.lit(iteration - 1)), "producer").join(of("consumer", at), "consumer")
        same = same.unionByName(before)
    return made, same.select(F.col("_producer").alias("src"), F.col("_consumer").alias("dst"))


def latest_iterations(instances: DataFrame) -> DataFrame:
    """The newest iteration of each ``stage, name``, compared as a number."""
    return instances.groupBy("stage", "name").agg(F.max(F.col("iteration").cast("int")).alias("iteration"))


def placeholder_state(instances: DataFrame, conditions: DataFrame) -> DataFrame:
    """``name, state``: finished once all iterations are and the condition is false; failed where that is no truth value."""
    said = F.lower(F.btrim("condition"))
    judged = conditions.select("name", F.when(said == "true", True).when(said == "false", False).alias("_more"), F.col("condition").isNotNull().alias("_said"))
    done = instances.groupBy("name").agg(F.bool_and(F.col("state") == "finished").alias("_done"), F.bool_or(F.col("state") == "failed").alias("_failed"))
    return done.join(judged, "name", "left").select("name", (
        F.when(F.col("_failed") | (F.coalesce("_said", F.lit(False)) & F.col("_more").isNull()), "failed")
        .when(F.col("_done") & ~F.coalesce("_more", F.lit(True)), "finished").otherwise("running")
    ).alias("state"))


# -- lineage --------------------------------------------------------------------------


def memo_hashes(nodes: DataFrame, edges: DataFrame, fuzzy: bool = False) -> DataFrame:
    """``node, memo_hash``: what a node does and what it reads, by level.

    ``nodes``: ``node, command, image`` and ``content`` (a digest of what it wrote, or
    NULL). A node reads its producers' content, or, where fuzzy or without one, their
    hashes; the order of producers does not matter.
    """
    depth = cut(levels(nodes, edges))
    done = cut(nodes.limit(0).select("node", F.lit("").alias("memo_hash"), F.col("content").cast("string").alias("content")))
    own = nodes.withColumn("content", F.lit(None).cast("string")) if fuzzy else nodes
    for level in range((depth.agg(F.max("level")).first()[0] or 0) + 1):
        here = depth.where(F.col("level") == level).join(own, "node")
        read = edges.join(done.select(F.col("node").alias("src"), F.coalesce("content", "memo_hash").alias("_read")), "src")
        inputs = read.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("_read")), ",").alias("_inputs"))
        text = F.concat_ws("\x01", "command", "image", F.coalesce("_inputs", F.lit("")))
        done = cut(done.unionByName(here.join(inputs, "node", "left").select("node", F.md5(text).alias("memo_hash"), F.col("content").cast("string").alias("content"))))
    return done.select("node", "memo_hash")


def config_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """``path, change, before, after`` of two definitions as ``path, value``; equal ones go."""
    a, b = one.select("path", F.col("value").alias("before"), F.lit(True).alias("_a")), two.select("path", F.col("value").alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, "path", "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.where("_a IS NULL OR _b IS NULL OR NOT before <=> after").select("path", kind.alias("change"), "before", "after")


def new_nodes(new: DataFrame, old: DataFrame, node: str = "node") -> DataFrame:
    return new.select(node).exceptAll(old.select(node)).distinct()


def rows_with_rank(edges: DataFrame) -> DataFrame:
    """Each consumer's producers numbered by name."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("src")))
