"""Harmonic packing of token sequences.

The capacity is cut into reciprocal classes: class ``s`` holds pieces of ``s`` tokens, and
each of its bins holds exactly ``capacity // s`` of them, where ``s = capacity // k`` for
some k. A document is cut into pieces of such sizes, the largest first, so few pieces
cover it. (Classes of uncut lengths, which hold all lengths up to 1/k, would leave up to
half a bin empty.) What a bin leaves empty is what the divisions leave over, below 1%.

Workers fill the bins of a class by themselves once each knows how many pieces of the
class lie before its own: only counts by (class, partition) are shuffled and summed. The
last, unfilled bin of each class is opened again, and its pieces, below ``capacity`` in
number for each of at most 2 * sqrt(capacity) classes however many documents there are,
are packed first-fit by falling size.

A null text is empty and has one token, the end id. Null and repeated ids are carried:
each row is a document of its own. Other columns are not read. An empty table gives an
empty result. Very long texts just have many full pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.splitting import Classes, tokenizers_classes
from weftline.llm.tokens import encoder, in_parts, trim
from weftline.llm.wordcache import LIMIT
from weftline.session import cut as kept

CAPACITY = 2048
END_ID = 1


def largest_pieces(capacity: int) -> list[int]:
    """For each remainder the largest size ``capacity // k`` that does not exceed it."""
    return [0] + [capacity // (capacity // (r + 1) + 1) for r in range(1, capacity)]


def pieces_of(length: int, capacity: int, largest: list[int]) -> list[int]:
    sizes = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        sizes.append(largest[rest])
        rest -= largest[rest]
    return sizes


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, at long"


def _cutter(path: str, classes: Classes, words: int, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encode = encoder(path, classes, words).encode
        largest = largest_pieces(capacity)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for doc_ids, texts in in_parts(batch):
                rows = []
                for doc_id, ids in zip(doc_ids, encode(texts)):
                    ids += end
                    n, start = len(ids) // 4, 0
                    view = memoryview(ids)
                    for size in pieces_of(n, capacity, largest):
                        crc = zlib.crc32(view[4 * start : 4 * (start + size)])
                        rows.append((doc_id, start, size, crc, n, part, seen[size]))
                        seen[size] += 1
                        start += size
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*rows)],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "at"],
                    )

    return cut


def _first_fit(capacity: int):
    """Opened pieces, by falling size, each into the first bin with room."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # bounded: see the module's text
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        room: list[int] = []
        first = 0  # bins before it are full
        seq, offset = [], []
        for size in rows.column("length").to_pylist():
            b = next((b for b in range(first, len(room)) if room[b] >= size), len(room))
            if b == len(room):
                room.append(capacity)
            seq.append(b * 2 * capacity)
            offset.append(capacity - room[b])
            room[b] -= size
            while first < len(room) and room[first] == 0:
                first += 1
        rows = rows.set_column(rows.schema.get_field_index("sequence_id"), "sequence_id", pa.array(seq, pa.int64()))
        rows = rows.set_column(rows.schema.get_field_index("offset"), "offset", pa.array(offset, pa.int64()))
        yield from rows.to_batches()

    return pack


def packed(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    words: int = LIMIT,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``words`` bounds the encoded words that a worker keeps: more is faster, fewer is smaller.

    ``sequence_id`` is ``bin * 2 * capacity + class``, with class 0 for opened pieces.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = kept(rows.mapInArrow(_cutter(vocabulary, tokenizers_classes(), words, capacity, end_id), PIECES))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "length", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("length")).alias("total"),
    )
    each = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    ranked = pieces.join(before, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("before") + F.col("at")).alias("rank"), each.alias("each"), "total",
    )
    is_open = F.col("rank") >= F.col("total") - F.col("total") % F.col("each")
    bin_no = F.floor(F.col("rank") / F.col("each")).cast("long")
    final = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", is_open.alias("is_open"),
        (bin_no * F.lit(2 * capacity) + F.col("length")).alias("sequence_id"),
        (F.col("rank") % F.col("each") * F.col("length")).alias("offset"),
    )
    closed, opened = final.where(~F.col("is_open")).drop("is_open"), final.where("is_open").drop("is_open")
    return closed.unionByName(opened.repartition(1).mapInArrow(_first_fit(capacity), opened.schema))
