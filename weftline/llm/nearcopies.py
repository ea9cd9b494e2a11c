"""Near copies by five-word shingles: SimHash finds pairs, exact similarity decides.

Two texts link where the Jaccard similarity of their sets of word shingles is ``LEAST`` or
more. Texts with one set are one node.

* A SimHash of 256 bits stands for each set, the majority of each bit over its shingles. At
  similarity 0.8 two of them differ in 39 bits on average (deviation 6; at most 48, for sets
  of four and five); pairs of up to ``RADIUS`` bits are candidates, and no others.
* No pair within the radius is missed. Narrow parts that two such fingerprints must share do
  not exist (64 bits at 14 and more differing bits leave parts of four bits, which is all
  with all), so fingerprints are compared by tiles: nodes stand in order of size and are cut
  into blocks; each two blocks whose sizes allow the similarity are a cell, and cells are
  dealt to all tasks.
* In a cell, tiles of ``tile`` nodes of like size are sorted by population count and compared
  by exclusive-or and bit count. Tiles whose sizes rule out the similarity and rows whose
  population counts differ by more than the radius are skipped.
* Candidates are verified on the sets themselves, and verified links alone make groups.
  Blocks are compared with themselves first, then with others, for pairs of different groups
  only. From cells with many candidates come only those that join their groups, nearest
  first, so a large group of near copies gives pairs in proportion to its members.
* What lies between different groups after that, and was not refuted, is settled where it
  is: the sets of the nodes concerned are sent once to a place of their cell, of at most
  ``HASHES`` hashes a side and one set more, and compared there with all others. Only links
  come out, at most one for each node of a place; no candidate goes untried.

Nulls: a null text is empty; texts without words are one node. Null and repeated ids are
treated as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.simhash import SEED, TILE
from weftline.llm.survivors import surviving
from weftline.llm.tokens import release
from weftline.operators.components import components
from weftline.operators.skew import MOST_HOT, gate, joined, split
from weftline.operators.table import numbered
from weftline.session import cut

SHINGLE = 5
LEAST = 0.8
WORDS = 4
RADIUS = 64
#: Nodes of a block: a ``SIDES``-th of all, so that there is work to deal out, ``BLOCK`` at most.
SIDES = 16
BLOCK = 1 << 16
#: Rows of a tile compared at a time.
ROWS = 64
#: Candidates of a cell that are all given, for each node in it.
FEW = 2
#: Hashes (one set more at most) and nodes of one side of a place; columns multiplied at a time.
HASHES = 1 << 18
NODES = 1 << 10
COLUMNS = 1 << 12
#: Hashes whose bits are counted together, and rows that a task holds in Python at a time.
TOGETHER = 1 << 12
AT_ONCE = 256
_BITS = [f"bits{w}" for w in range(WORDS)]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    ws = text.lower().split()
    if len(ws) <= shingle:
        found = {b" ".join(ws)} if ws else set()
    else:
        found = set(map(b" ".join, zip(*[ws[i:] for i in range(shingle)])))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))


def sign(hashes: np.ndarray) -> int:
    """What stands for a set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED + 1)).view(np.int64))


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-th hash made from one (splitmix64)."""
    if n == 0:
        return h
    z = h + np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bits_of(hashes: np.ndarray) -> bytes:
    """The SimHash of a set, ``WORDS`` times 64 bits."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), TOGETHER):
        some = np.stack([_mixed(hashes[i : i + TOGETHER], n) for n in range(WORDS)], axis=1)
        ones += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(i, AT_ONCE)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in _parts(batches):
            rows, bits = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingles(text or b"", shingle)
                rows.append((sign(h), len(h)))
                bits.append(bits_of(h))
            words = np.frombuffer(b"".join(bits), np.int64).reshape(-1, WORDS)
            columns = [*np.array(rows, np.int64).reshape(-1, 2).T, *words.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "node", "n", *_BITS])

    return run


def _set_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingles(t or b"", shingle) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            made = [pa.array([sign(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["node", "members"])

    return run


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])


class _Forest:
    """Of candidates given nearest first, those that join groups; done when all groups met are one."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def add(self, found: np.ndarray) -> None:
        """``found``: columns distance, node, node, label, label."""
        found = found[:, np.argsort(found[0], kind="stable")]
        left = len({self.find(x) for x in np.unique(found[3:]).tolist()}) - 1
        for i in range(0, found.shape[1], TOGETHER):
            for _, a, b, la, lb in zip(*found[:, i : i + TOGETHER].tolist()):
                p, q = self.find(la), self.find(lb)
                if p != q:
                    self.root[max(p, q)] = min(p, q)
                    self.kept.append((a, b))
                    left -= 1
            if left <= 0:
                return


def _side(rows: pa.Table, tile: int) -> dict[str, np.ndarray]:
    """The nodes of a block by tiles of like size, those of a tile by population count."""
    nodes, ns, labels = (rows.column(c).to_numpy() for c in ("node", "n", "label"))
    bits = np.stack([rows.column(c).to_numpy() for c in _BITS]).view(np.uint64)
    pops = np.bitwise_count(bits).sum(axis=0, dtype=np.int64)
    order = np.lexsort((nodes, ns))
    order = order[np.lexsort((pops[order], np.arange(len(order)) // tile))]
    side = {"nodes": nodes[order], "ns": ns[order], "labels": labels[order], "pops": pops[order], "bits": np.ascontiguousarray(bits[:, order])}
    refuted = np.empty(0, _PAIR)
    if "no" in rows.column_names:
        others = rows.column("no").combine_chunks()
        refuted = np.empty(len(others.flatten()), _PAIR)
        refuted["a"], refuted["b"] = nodes[pc.list_parent_indices(others).to_numpy()], others.flatten().to_numpy()
    return side | {"no": refuted}


def _sides(cell: pa.Table, tile: int) -> tuple[dict, dict | None]:
    """The two blocks of a cell (null: the first with itself)."""
    one, two = cell.column("one")[0].as_py(), cell.column("two")[0].as_py()
    first = _side(cell.filter(pc.equal(cell.column("block"), one)), tile)
    return first, None if one == two else _side(cell.filter(pc.equal(cell.column("block"), two)), tile)


def _tile_pairs(one: dict, two: dict, same: bool, least: float, tile: int) -> Iterator[tuple[slice, slice]]:
    """Rows of ``one`` and of ``two``, a few of the one at a time, that sizes and population counts let meet."""
    for i in range(0, len(one["nodes"]), tile):
        ns = one["ns"][i : i + tile]
        for j in range(i if same else 0, len(two["nodes"]), tile):
            ms = two["ns"][j : j + tile]
            if ns.max() < least * ms.min() - 1e-9 or ms.max() < least * ns.min() - 1e-9:
                continue
            pops = two["pops"][j : j + tile]
            for k in range(i, min(i + tile, len(one["nodes"])), ROWS):
                some = one["pops"][k : min(k + ROWS, i + tile)]
                low, high = np.searchsorted(pops, (some[0] - RADIUS, some[-1] + RADIUS + 1))
                if low < high:
                    yield slice(k, k + len(some)), slice(j + low, j + high)


def _near(one: dict, two: dict | None, least: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of two blocks (or of one), in parts: their columns, rows of ``one``, rows of ``two``.

    The columns are distance, node, node, label, label.
    """
    same = two is None
    two = one if same else two
    refuted = np.concatenate([one["no"], two["no"]])
    for rows, columns in _tile_pairs(one, two, same, least, tile):
        # all words but the last (192 bits, which a byte counts) rule out nearly all pairs; the last is looked at for the rest
        apart = np.bitwise_count(one["bits"][0, rows, None] ^ two["bits"][0, columns])
        for w in range(1, WORDS - 1):
            apart += np.bitwise_count(one["bits"][w, rows, None] ^ two["bits"][w, columns])
        spot = np.flatnonzero(apart <= RADIUS)
        if not len(spot):
            continue
        at, to = np.divmod(spot, apart.shape[1])
        at, to = at + rows.start, to + columns.start
        apart = apart.ravel()[spot].astype(np.int64) + np.bitwise_count(one["bits"][-1, at] ^ two["bits"][-1, to])
        near = apart <= RADIUS
        at, to, apart = at[near], to[near], apart[near]
        na, nb, la, lb = one["ns"][at], two["ns"][to], one["labels"][at], two["labels"][to]
        ok = (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9) & (la != lb)
        if same:
            ok &= at < to
        at, to, apart, la, lb = at[ok], to[ok], apart[ok], la[ok], lb[ok]
        a, b = one["nodes"][at], two["nodes"][to]
        turned = a > b
        found = np.stack([apart, np.where(turned, b, a), np.where(turned, a, b), np.where(turned, lb, la), np.where(turned, la, lb)])
        if len(refuted) and found.shape[1]:
            pairs = np.empty(found.shape[1], _PAIR)
            pairs["a"], pairs["b"] = found[1], found[2]
            ok = ~np.isin(pairs, refuted)
            found, at, to = found[:, ok], at[ok], to[ok]
        if len(at):
            yield found, at, to


def _compare(least: float, few: int, tile: int):
    """``a, b``: candidates of a cell; where some are left out, also the nodes that have any, without ``b``."""

    def run(cell: pa.Table) -> pa.Table:
        one, two = _sides(cell, tile)
        most = few * sum(len(side["nodes"]) for side in (one, two) if side is not None)
        other = one if two is None else two
        held, n, forest = [], 0, None
        ahead, behind = (np.zeros(len(side["nodes"]), bool) for side in (one, other))
        for found, at, to in _near(one, two, least, tile):
            n += found.shape[1]
            ahead[at] = behind[to] = True
            if forest is None:
                held.append(found)
                if n > most:
                    forest = _Forest()
                    forest.add(np.concatenate(held, axis=1))
                    held = []
            else:
                forest.add(found)
        if forest is None:
            kept = np.concatenate([np.empty((5, 0), np.int64), *held], axis=1)[1:3]
            return pa.table({"a": kept[0], "b": kept[1]})
        kept = np.array(forest.kept, np.int64).reshape(-1, 2)
        seen = np.concatenate([one["nodes"][ahead], other["nodes"][behind]])
        b = np.concatenate([kept[:, 1], np.zeros_like(seen)])
        return pa.table({"a": np.concatenate([kept[:, 0], seen]), "b": pa.array(b, mask=np.arange(len(b)) >= len(kept))})

    return run


def _shares(side: dict, hashes: int) -> np.ndarray:
    """Which part of the block each node is in: at most ``NODES`` nodes, ``hashes`` hashes and one set more."""
    ns = np.maximum(side["ns"], -(-hashes // NODES))
    return (np.cumsum(ns) - ns) // hashes


def _places(least: float, hashes: int, tile: int):
    """``place, node, label`` of the nodes that have candidates, a place for each two parts of a cell's blocks."""

    def run(cell: pa.Table) -> pa.Table:
        one, two = _sides(cell, tile)
        other = one if two is None else two
        p, q = _shares(one, hashes), _shares(other, hashes)
        wide = int(q.max()) + 1
        wanted: list[np.ndarray] = []
        held = 0
        for _, at, to in _near(one, two, least, tile):
            spot = p[at] * wide + q[to]
            pairs = np.empty(2 * len(at), _PAIR)
            pairs["a"] = np.concatenate([spot, spot])
            pairs["b"] = np.concatenate([at, len(p) + to])
            wanted.append(np.unique(pairs))
            held += len(wanted[-1])
            if held > 1 << 20:
                wanted = [np.unique(np.concatenate(wanted))]
                held = len(wanted[0]) // 2
        found = np.unique(np.concatenate([np.empty(0, _PAIR), *wanted]))
        nodes, labels = (np.concatenate([one[c], other[c]])[found["b"]] for c in ("nodes", "labels"))
        name = [cell.column("one")[0].as_py(), cell.column("two")[0].as_py()]
        spots, back = np.unique(found["a"], return_inverse=True)
        names = [xxhash.xxh64_intdigest(np.array([*name, s], np.int64).tobytes(), SEED) for s in spots.tolist()]
        return pa.table({"place": np.array(names, np.uint64).view(np.int64)[back], "node": nodes, "label": labels})

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets have in common."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    column = np.cumsum(several) - 1
    of, column = of[several[at]], column[at[several[at]]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(several.sum()), COLUMNS):
        i, j = np.searchsorted(column, (start, start + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[of[i:j], column[i:j] - start] = 1
        common += has @ has.T
    return common


def _settle(least: float):
    def run(place: pa.Table) -> pa.Table:
        members = place.column("members").combine_chunks()
        ends, flat = members.offsets.to_numpy(), members.values.to_numpy()
        sets = [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]
        nodes, labels = (place.column(c).to_numpy() for c in ("node", "label"))
        sizes, common = np.array([len(x) for x in sets], np.float32), _common(sets)
        alike = common >= least * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        at, to = np.nonzero(np.triu(alike & (labels[:, None] != labels[None, :]), 1))
        forest = _Forest()
        if len(at):
            forest.add(np.stack([np.zeros(len(at), np.int64), nodes[at], nodes[to], labels[at], labels[to]]))
        a, b = zip(*forest.kept) if forest.kept else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def blocks(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """``nodes`` (``node, n`` and more) with ``block``, cut from their order by size; kept in the shared folder."""
    side = min(BLOCK, max(tile, -(-nodes.count() // SIDES)))
    return cut(numbered(nodes, F.col("n"), F.col("node"), name="_place").withColumn("block", F.expr(f"_place div {side}")).drop("_place"))


def cells(placed: DataFrame, least: float = LEAST) -> DataFrame:
    """``one, two``: each two blocks (a block with itself too) whose sizes allow the similarity."""
    spans = placed.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = spans.select(F.col("block").alias("one"), "high"), spans.select(F.col("block").alias("two"), "low")
    # one row for each block
    met = one.join(F.broadcast(two), (F.col("one") <= F.col("two")) & (F.col("low") * least <= F.col("high") + 1e-9))
    return cut(met.select("one", "two"))


def _by_cell(placed: DataFrame, grid: DataFrame):
    """``placed`` grouped by the cells of ``grid``."""
    met = grid.select(F.explode(F.array_distinct(F.array("one", "two"))).alias("block"), "one", "two")
    return placed.join(F.broadcast(met), "block").groupBy("one", "two")


def candidates(placed: DataFrame, grid: DataFrame, least: float = LEAST, tile: int = TILE, few: int = FEW) -> DataFrame:
    """``a, b`` (``a`` below ``b``) of ``node, n, bits.., label, block``; ``b`` is null for nodes that have candidates left out."""
    return _by_cell(placed, grid).applyInArrow(_compare(least, few, tile), "a long, b long").distinct()


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def sets_of(wanted: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``node, members`` of ``wanted`` (``node, first_id``), kept in the shared folder."""
    _, texts = split(docs, F.xxhash64("doc_id"), cut(gate(wanted.select(F.xxhash64("first_id")))))
    sets = texts.select("text").mapInArrow(_set_of(shingle), "node long, members array<long>").dropDuplicates(["node"])
    return cut(sets.join(wanted.select("node"), "node", "left_semi"))


def settled(nodes: DataFrame, docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE, tile: int = TILE, hashes: int = HASHES) -> DataFrame:
    """``a, b``: links that join different labels of ``nodes`` (with ``first_id``), by the sets of shingles."""
    placed = blocks(nodes, tile)
    found = _by_cell(placed, cells(placed, least)).applyInArrow(_places(least, hashes, tile), "place long, node long, label long")
    places = cut(found.distinct())
    wanted = cut(places.select("node").distinct().join(nodes.select("node", "first_id"), "node"))
    given = places.join(sets_of(wanted, docs, shingle), "node")
    return cut(given.groupBy("place").applyInArrow(_settle(least), "a long, b long").distinct())


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """``a, b, alike`` by the sets of shingles; ``docs``: ``doc_id, text``."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first_id"), "node"))
    sets = sets_of(wanted, docs, shingle)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("two")), "b"
    )
    common = F.size(F.array_intersect("one", "two"))
    return both.select("a", "b", (common >= least * (F.size("one") + F.size("two") - common) - 1e-9).alias("alike"))


def grouped(
    docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, tile: int = TILE, few: int = FEW, most_hot: int = MOST_HOT,
    hashes: int = HASHES,
) -> DataFrame:
    """``doc_id, node, component_id, keep_node`` of each row of ``docs`` (``doc_id, text``)."""
    bits = ", ".join(f"{w} long" for w in _BITS)
    rows = cut(docs.mapInArrow(_sketch(shingle), f"doc_id long, node long, n long, {bits}"))
    same = [F.first(c).alias(c) for c in ("n", *_BITS)]
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *same))
    placed = blocks(nodes.select("node", "n", *_BITS), tile)
    grid = cells(placed, least)
    judged = labels = left = None
    for some in (grid.where("one = two"), grid.where("one < two")):
        found = cut(candidates(_labelled(placed, labels), some, least, tile, few))
        pairs = found.where("b IS NOT NULL")
        if pairs.isEmpty():
            continue
        now, open_now = cut(verified(pairs, nodes, docs, least, shingle)), found.where("b IS NULL").select(F.col("a").alias("node"))
        judged, left = (now, open_now) if judged is None else (judged.union(now), left.union(open_now))
        labels = cut(components(judged.where("alike").select("a", "b")).select("node", F.col("least").alias("label")))
    if left is not None and not left.isEmpty():
        # only nodes with candidates left out take part again
        refuted = judged.where("NOT alike").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("no"))
        open_nodes = _labelled(left.distinct().join(nodes, "node"), labels).join(refuted, "node", "left")
        more = settled(cut(open_nodes), docs, least, shingle, tile, hashes)
        if not more.isEmpty():
            links = judged.where("alike").select("a", "b").union(more)
            labels = cut(components(links).select("node", F.col("least").alias("label")))
    of_node = _labelled(nodes.select("node", "first_id", "copies"), labels)
    of_node = cut(of_node)
    best = of_node.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("best"))
    best = best.select("label", "n", F.col("best.first_id").alias("component_id"), F.col("best.node").alias("keep_node"))
    total = of_node.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    members = joined(of_node, best, ["label"], total[0], most_hot=most_hot)
    named = cut(members.select("node", F.col("copies").alias("n"), "component_id", "keep_node"))
    return joined(rows.select("doc_id", "node"), named, ["node"], total[1], most_hot=most_hot)


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with
    the smallest id (one of them, if that id is repeated)."""
    found = grouped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle, least)
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("keep_node"))
    decided = cut(found.select("doc_id", F.col("node").cast("string").alias("mark"), keep.alias("keep")))

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([str(sign(shingles((t or "").encode(), shingle))) for t in texts], dtype="object")

    return surviving(docs, decided, mark(F.col(text)), doc_id)
