"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

A fingerprint takes the majority of each bit over the hashes of all word shingles. Two
fingerprints link at ``RADIUS`` or fewer differing bits. Copies have one fingerprint, so
links are sought between distinct fingerprints only.

No link is missed: the 64 bits are cut into ``PARTS`` equal parts, and two fingerprints
within the radius agree on at least ``PARTS - RADIUS`` of them. Each choice of that many
parts is a key; fingerprints of a key are sorted by population count and cut into tiles of
at most ``TILE``; the sort is by ranges, so a key with very many fingerprints is spread over
tasks. Tiles of one key are compared with numpy's exclusive-or and bit count; a
pair of tiles is skipped when their population counts differ by more than the radius.
Pairs of tiles are made as pairs of numbers and dealt out over all tasks. From each pair of tiles come only links that join its local components, so a large
group of near copies gives links in proportion to its members.

Nulls: a null text has no words, fingerprint zero, linked like any other; a null id
stands in its component, which takes the smallest id that is not null (null if there is
none). Repeated rows and ids give a row each. Other columns are not read. An empty table
gives an empty result. A very long text is hashed in one pass over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.survivors import surviving
from weftline.operators.components import components
from weftline.operators.skew import MOST_HOT, joined
from weftline.session import cut

SEED = 42
RADIUS = 2
PARTS = 4
TILE = 2048
#: Hashes whose bits are counted together.
TOGETHER = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    ws = text.lower().split()  # of bytes: A-Z and the six white-space characters only
    if not ws:
        return 0
    if len(ws) < shingle:
        shingles = [b" ".join(ws)]
    else:
        shingles = map(b" ".join, zip(*[ws[i:] for i in range(shingle)]))
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashed), TOGETHER):
        some = np.ascontiguousarray(hashed[i : i + TOGETHER]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of each row, kept in the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(_prints(shingle), "doc_id long, fp long"))


def _choices() -> list[tuple[int, int]]:
    """Number and mask of each choice of parts on which two fingerprints may agree."""
    size = 64 // PARTS
    part = [((1 << size) - 1) << (size * i) for i in range(PARTS)]
    return [(n, sum(part[i] for i in c)) for n, c in enumerate(combinations(range(PARTS), PARTS - RADIUS))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _tiler(tile: int):
    """Tiles of each key's fingerprints, numbered by task; keys with a single one are left out.

    A key at either end of a task's rows may go on in the next task, so it stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles, held, pops = None, 0, [], []
        made, keys = TaskContext.get().partitionId() << 32, 0

        def close(out: list, last: bool = False) -> None:
            nonlocal tiles, held, pops, made
            if len(held) > 1 or held and (tiles or keys == 1 or last):
                blob = np.array(held, np.int64).tobytes()
                out.append((*key, made, pops[0], pops[-1], blob))
                tiles += 1
                made += 1
            held, pops = [], []

        for batch in batches:
            out: list = []
            for choice, part, pop, fp in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (choice, part):
                    close(out)
                    key, tiles, keys = (choice, part), 0, keys + 1
                elif len(held) >= tile:
                    close(out)
                held.append(fp)
                pops.append(pop)
            yield _tiles(out)
        out = []
        if key is not None:
            close(out, last=True)
        yield _tiles(out)

    return run


TILES = "choice int, part long, tile long, low int, high int, fps binary"


def _tiles(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*rows)) or [[]] * 6
    names = ["choice", "part", "tile", "low", "high", "fps"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links ``a[i]``-``b[i]``, those that join components of what came before."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(one, np.uint64)
                y = x if two is None else np.frombuffer(two, np.uint64)
                for i in range(0, len(x), 256):
                    near = np.bitwise_count(x[i : i + 256, None] ^ y[None, :]) <= radius
                    at, to = np.nonzero(near)
                    ahead = (x[at + i] < y[to]) if two is None else slice(None)
                    found += _spanning(x[at + i][ahead].view(np.int64), y[to][ahead].view(np.int64))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b`` between distinct fingerprints (column ``fp``) that connect all within the radius."""
    if radius > RADIUS:
        raise ValueError(f"the parts find all links up to {RADIUS} bits only")
    choices = F.array(*[F.struct(F.lit(n).alias("choice"), F.lit(_signed(m)).cast("long").alias("mask")) for n, m in _choices()])
    keyed = prints.select("fp", F.explode(choices).alias("c")).select(
        F.col("c.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("part"),
        F.bit_count("fp").alias("pop"), "fp",
    )
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by ranges, so that a key with many fingerprints is cut over several tasks
    order = ("choice", "part", "pop", "fp")
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tiles = cut(ordered.mapInArrow(_tiler(tile), TILES))
    within = tiles.select(F.col("fps").alias("one"), F.lit(None).cast("binary").alias("two"))
    # pairs are made of numbers alone, dealt out, and only then given their fingerprints
    lean = tiles.select("choice", "part", "tile", "low", "high")
    ahead = lean.select("choice", "part", F.col("tile").alias("two"), F.col("low").alias("from"))
    pairs = lean.join(ahead, ["choice", "part"]).where(F.col("tile") < F.col("two")).where(F.col("from") - F.col("high") <= radius)
    blobs = tiles.select("tile", "fps")
    across = (
        pairs.select(F.col("tile").alias("_one"), F.col("two").alias("_two")).repartition(n)
        .join(blobs.select(F.col("tile").alias("_one"), F.col("fps").alias("one")), "_one")
        .join(blobs.select(F.col("tile").alias("_two"), F.col("fps").alias("two")), "_two")
        .select("one", "two")
    )
    return within.union(across).repartition(n).mapInArrow(_compare(radius), "a long, b long")


def grouped(rows: DataFrame, radius: int = RADIUS, most_hot: int = MOST_HOT) -> DataFrame:
    """``fingerprints`` with ``component_id`` and ``keep_fp``, the fingerprint of the row that stands for all."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    reached = components(links(distinct.select("fp"), radius))
    of_print = distinct.join(reached, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", "n", F.coalesce("least", "fp").alias("group")
    )
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp"))
    of_group = of_print.groupBy("group").agg(first.alias("best"))
    sizes = reached.groupBy(F.col("least").alias("group")).agg(F.count(F.lit(1)).alias("members"))
    best = of_group.join(sizes, "group", "left").select(
        "group", F.coalesce("members", F.lit(1)).alias("n"), F.col("best.first_id").alias("component_id"), F.col("best.fp").alias("keep_fp")
    )
    total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    members = of_print.select("fp", "group", F.col("n").alias("copies"))
    named = cut(joined(members, best, ["group"], total[0], most_hot=most_hot).select("fp", F.col("copies").alias("n"), "component_id", "keep_fp"))
    return joined(rows, named, ["fp"], total[1], most_hot=most_hot).select("doc_id", "fp", "component_id", "keep_fp")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, component_id``."""
    return grouped(fingerprints(docs, shingle, doc_id, text), radius).drop("keep_fp")


def deduplicated(
    docs: DataFrame, shingle: int = 3, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with
    the smallest id (one of them, if that id is repeated)."""
    found = grouped(fingerprints(docs, shingle, doc_id, text), radius)
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp"))
    decided = cut(found.select("doc_id", F.col("fp").cast("string").alias("mark"), keep.alias("keep")))

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        prints = [fingerprint((t or "").encode(), shingle) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64).astype(str))

    return surviving(docs, decided, mark(F.col(text)), doc_id)
