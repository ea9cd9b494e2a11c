"""Connected components by alternating star contraction.

Edges stay distributed; each round is two grouped joins of the edges with themselves by
node, and every round's edges are written to the shared folder, so a lost executor
repeats one round at most. Nodes with very many edges, the centres of stars above all,
are joined by broadcast (``skew.joined``), so none of them fills a task. The number of
rounds grows with the logarithm of a component's width. ``FEW`` edges and less, which one
task holds in some megabytes, are no work to deal out: a task follows them to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import FEW, MOST_HOT, joined
from weftline.session import cut


def _large_star(edges: DataFrame, n: int, most_hot: int, few: int) -> DataFrame:
    """Each neighbour above a node is linked to the least around that node."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    around = joined(both, least, ["u"], 2 * n, most_hot=most_hot, few=few)
    return around.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int, most_hot: int, few: int) -> DataFrame:
    """Each node and its neighbours below are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    below = joined(down, least, ["u"], n, most_hot=most_hot, few=few).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return below.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, least`` of the edges of one task."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "least"])


def components(edges: DataFrame, most_rounds: int = 100, most_hot: int = MOST_HOT, few: int = FEW) -> DataFrame:
    """``node, least``: every node of ``edges`` (``a``, ``b``) with the least node it can reach."""
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)))
    before = now.select(mark).first()[0]
    if before["n"] <= few:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_followed, f"node {kind}, least {kind}")
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now, before["n"], most_hot, few), before["n"], most_hot, few))
        after = now.select(mark).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("least"))
    return stars.union(now.select("a", "a")).distinct()
