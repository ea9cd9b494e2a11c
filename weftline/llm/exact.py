"""Exact dedup: counting quotient filters merged by sorted remainders, then bytes.

1. One pass over the texts makes a digest row for each document: 64-bit fingerprint,
   SHA-256 and length. Only these lean rows are kept and shuffled.
2. Each partition builds counting quotient filters of its fingerprints, one for each
   range of high bits ("shard"). Filters of a shard merge without loss: their remainders
   are read back in sorted order and counts of equal fingerprints added.
3. Fingerprints with a count above one make a gate (``operators.skew``: a bit map of
   bounded size) through which their texts, and few others, pass to verification: texts
   are grouped by their bytes, partial groups first, so a text with a third of all rows
   leaves each task as one row. Texts that the gate holds back never move.
4. Of each verified group, the row with the most code points, then the smallest id,
   stays. Rows of large groups learn so by broadcast (at most ``skew.MOST_HOT`` groups,
   each with more than that share of all rows), rows of others by shuffle.

Texts are equal when identical without the six white-space characters. A null text
counts as empty, and all empty texts are one group. A null id ranks after every other
id. Rows repeated with the same id and text are members of one group; exactly one row of
a group is kept, whichever of the fully tied ones. Other columns are not read. An empty
table gives an empty result. Memory: a filter holds at most ``FLUSH`` fingerprints of a
task; a merge holds one shard, and the number of shards follows
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.survivors import surviving
from weftline.llm.texts import SPACE, whole, without
from weftline.llm.tokens import release
from weftline.operators.skew import FEW, MOST_HOT, gate, joined, split
from weftline.session import cut

SPACE_BYTES = b" \t\n\x0b\x0c\r"
FLUSH = 1 << 20
#: The seed that Spark's own xxhash64 has, so that tasks in Python and in the JVM agree.
SEED = 42


# -- counting quotient filter ---------------------------------------------------------


def cqf_pack(fps: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
    """A filter of ascending distinct ``fps``, which share their ``shard_bits`` high bits.

    Below the shard's bits a fingerprint is a quotient and a remainder. Quotients in use
    are one bitmap, the last member of each quotient's run another; remainders follow in
    order, whole bytes wide. Counts above one are listed with the place they belong to.
    """
    n = len(fps)
    q_bits = min(max(3, int(n).bit_length()), 64 - shard_bits - 1)
    r_bits = 64 - shard_bits - q_bits
    low = fps & np.uint64((1 << (64 - shard_bits)) - 1)
    quotients = (low >> np.uint64(r_bits)).astype(np.int64)
    remainders = low & np.uint64((1 << r_bits) - 1)
    occupied = np.zeros(1 << q_bits, np.uint8)
    occupied[quotients] = 1
    ends = np.ones(n, np.uint8)
    ends[:-1] = quotients[1:] != quotients[:-1]
    width = -(-r_bits // 8)
    packed = remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    above = np.flatnonzero(counts > 1)
    shard = int(fps[0]) >> (64 - shard_bits) if shard_bits else 0
    return b"".join(
        (
            struct.pack("<QIIBB", shard, n, len(above), q_bits, shard_bits),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            np.ascontiguousarray(packed).tobytes(),
            above.astype("<u4").tobytes(),
            counts[above].astype("<u8").tobytes(),
        )
    )


def cqf_unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending fingerprints of a filter, and their counts."""
    shard, n, n_above, q_bits, shard_bits = struct.unpack_from("<QIIBB", blob)
    at = struct.calcsize("<QIIBB")
    size = -(-(1 << q_bits) // 8)
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=1 << q_bits))
    at += size
    size = -(-n // 8)
    ends = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n)
    at += size
    r_bits = 64 - shard_bits - q_bits
    width = -(-r_bits // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    runs = np.concatenate(([0], np.cumsum(ends)[:-1])).astype(np.int64)
    fps = (np.uint64(shard) << np.uint64(64 - shard_bits)) if shard_bits else np.uint64(0)
    fps = fps | (occupied[runs].astype(np.uint64) << np.uint64(r_bits)) | wide.reshape(-1).view("<u8")
    counts = np.ones(n, np.uint64)
    above = np.frombuffer(blob, "<u4", n_above, at)
    counts[above] = np.frombuffer(blob, "<u8", n_above, at + 4 * n_above)
    return fps, counts


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending sequences of distinct fingerprints and their counts as one."""
    (one, n_one), (two, n_two) = a, b
    at = np.searchsorted(one, two)
    known = np.zeros(len(two), bool)
    inside = at < len(one)
    known[inside] = one[at[inside]] == two[inside]
    counts = n_one.copy()
    counts[at[known]] += n_two[known]
    return np.insert(one, at[~known], two[~known]), np.insert(counts, at[~known], n_two[~known])


def cqf_merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints of the filters in order, counts of equal ones added.

    Filters are read in the order of their sorted remainders and merged two by two.
    """
    parts = [cqf_unpack(b) for b in blobs]
    while len(parts) > 1:
        pairs = [_merged(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0]


# -- Spark jobs -----------------------------------------------------------------------


def normalised(column: pa.Array) -> list[bytes]:
    return [(t or b"").translate(None, SPACE_BYTES) for t in column.cast(pa.binary()).to_pylist()]


def _fingerprint(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, SEED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    row = (TaskContext.get().partitionId()) << 36
    for batch in batches:
        bare = normalised(batch.column(1))
        n = len(bare)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.array([_fingerprint(b) for b in bare], np.uint64).view(np.int64)),
                pa.array([hashlib.sha256(b).digest() for b in bare], pa.binary()),
                batch.column(2),
                pa.array(np.arange(row, row + n, dtype=np.int64)),
            ],
            names=["doc_id", "fp", "sha", "len", "row_no"],
        )
        row += n


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, sha, len, row_no``, kept in the shared folder: row numbers are drawn once."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("len"),
    )
    return cut(rows.mapInArrow(_digest, "doc_id long, fp long, sha binary, len long, row_no long"))


def _builder(shard_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(held: list[np.ndarray]) -> pa.RecordBatch:
            fps, counts = np.unique(np.concatenate(held), return_counts=True)
            shards = (fps >> np.uint64(64 - shard_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1])))
            blobs = [
                cqf_pack(fps[a:b], counts[a:b], shard_bits) for a, b in zip(cuts, [*cuts[1:], len(fps)])
            ]
            return pa.RecordBatch.from_arrays([pa.array(shards[cuts]), pa.array(blobs, pa.binary())], names=["shard", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    return build


def _repeated(group: pa.Table) -> pa.Table:
    fps, counts = cqf_merge(group.column("filter").to_pylist())
    more = counts > 1
    return pa.table({"fp": fps[more].view(np.int64), "n": counts[more].astype(np.int64)})


def repeated_fingerprints(digest_rows: DataFrame) -> DataFrame:
    """``fp, n`` of the fingerprints that occur more than once, from merged filters."""
    shards = 4 * int(digest_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard_bits = min(20, max(4, (shards - 1).bit_length()))
    built = digest_rows.select("fp").mapInArrow(_builder(shard_bits), "shard long, filter binary")
    return built.groupBy("shard").applyInArrow(_repeated, "fp long, n long")


def verified_groups(docs: DataFrame, door: DataFrame, text: str = "text") -> DataFrame:
    """``fp, sha, size``: texts whose fingerprint passes the gate, grouped by their bytes."""
    bare = docs.select(without(whole(text), SPACE).alias("bare"))
    _, routed = split(bare, F.xxhash64("bare"), door)
    groups = routed.groupBy("bare").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return groups.select(F.xxhash64("bare").alias("fp"), F.unhex(F.sha2("bare", 256)).alias("sha"), "size")


def decisions(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_hot: int = MOST_HOT, few: int = FEW
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, len``."""
    rows = digests(docs, doc_id, text)
    door = cut(gate(repeated_fingerprints(rows).select("fp")))
    alone, several = split(rows, F.col("fp"), door)
    rank = F.struct("len", (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("id"), (-F.col("row_no")).alias("row"))
    best = several.groupBy("fp", "sha").agg(F.max(rank).alias("best"), F.max_by("doc_id", rank).alias("keep_id"))
    kept = cut(
        verified_groups(docs, door, text).join(best, ["fp", "sha"])
        .select("fp", "sha", F.col("size").alias("n"), "size", "keep_id", (-F.col("best.row")).alias("keep_row"))
    )
    nothing = [F.lit(None).cast("long").alias(c) for c in ("size", "keep_id", "keep_row")]
    looked = joined(several, kept, ["fp", "sha"], rows.count(), "left", most_hot, few).unionByName(alone.select("*", *nothing))
    return looked.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "len",
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    decided = decisions(docs, doc_id, text).select("doc_id", F.concat_ws(":", "text_sha256", "len").alias("mark"), F.col("kept").alias("keep"))
    mark = F.concat_ws(":", F.sha2(without(whole(text), SPACE), 256), F.length(whole(text)))
    return surviving(docs, cut(decided), mark, doc_id)
