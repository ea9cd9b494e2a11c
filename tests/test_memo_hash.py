"""``gr_memo_hash`` over the whole graph, against a plain recursion; it has no SQL of its own."""

import hashlib

from conftest import SMALL
from weftline import catalogue
from weftline.operators import graph
from weftline.plans import graphs


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_hashes(tasks, edges):
    """``node -> hash`` of ``node -> (command, image, content)``."""
    known = {}

    def of(node):
        if node not in known:
            command, image, _ = tasks[node]
            inputs = sorted(tasks[a][2] or of(a) for a, b in edges if b == node)
            known[node] = md5("\x01".join((command, image, ",".join(inputs))))
        return known[node]

    return {n: of(n) for n in tasks}


def test_whole_graph(spark, oracle):
    keys = [r["n_nationkey"] for r in spark.read.parquet(f"{SMALL}/nation.parquet").collect()]
    tasks = {n: (f"run {n}", f"image{n % 3}", md5(f"w{n}") if n % 4 == 1 else None) for n in keys}
    edges = {(n, m) for n in keys for m in (2 * n + 1, 2 * n + 2, 4 * n + 3) if m in tasks}
    found = {r["node"]: r["memo_hash"] for r in catalogue.queries()["gr_memo_hash"](spark, SMALL).collect()}
    assert len(found) == len(keys) == 25 and found == plain_hashes(tasks, edges)
    _, _, top = oracle(graphs.MEMO_TOP)
    assert len(top) == 3 and all(found[node] == h for h, node in top)


def test_deep_levels_without_content(spark):
    """A change at the top of a chain without content reaches its end, and stops at content."""
    tasks = {n: (f"c{n}", "i", "digest" if n == 4 else None) for n in range(7)}
    edges = [*[(n, n + 1) for n in range(6)], (0, 3), (1, 6)]
    for first in ("c0", "other"):
        tasks[0] = (first, "i", None)
        df = spark.createDataFrame([(n, *t) for n, t in tasks.items()], "node int, command string, image string, content string")
        found = {r["node"]: r["memo_hash"] for r in graph.memo_hashes(df, spark.createDataFrame(edges, "src int, dst int")).collect()}
        assert found == plain_hashes(tasks, edges)
