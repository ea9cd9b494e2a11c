"""Token ids in patched frame-of-reference files.

A file holds the ids of whole documents in blocks of ``BLOCK`` ids. A block subtracts its
minimum, packs the low ``width`` bits of each id, where ``width`` suffices for the
``PERCENTILE`` of the block, and lists what does not fit as exceptions (place, high part).
An index gives the byte at which each block starts, so any range of ids can be read alone.

Layout, little-endian: magic, counts (documents, ids, blocks, block size); document ids
(int64) and a null flag each; ids of each document (uint32); block starts (uint64); blocks:
minimum (uint32), width (uint8), exceptions (uint16), packed words (uint64), exception
places (uint16) and high parts (uint32).

``written`` encodes and writes where the rows are if they stand in order: that is, if a
look at the ids alone shows that they ascend in each task's share and that no two shares
overlap. Else texts are dealt out by ranges of their id first (rows of one id by their
text, so a hot id is spread) and sorted there. Each task writes files of at most
``FILE_IDS`` ids (or one longer document) to a new folder in the shared folder, under
names that no other attempt uses, and returns a manifest row for each; a lost or repeated
attempt leaves a file that no manifest names. ``read`` reads what the manifest names. The
manifest is held against the order once more, so rows that moved meanwhile are dealt out.

Ids ascend; null ids stand last; rows of one id are ordered by a hash of their text, then
the text, and all stay. A null text has the end id alone. Other columns are not read. An
empty table writes nothing and reads as an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.splitting import Classes, tokenizers_classes
from weftline.llm.tokens import encoder, in_parts
from weftline.session import cut, shared_dir

MAGIC = b"WPFR0001"
BLOCK = 1024
PERCENTILE = 95
FILE_IDS = 1 << 22
END_ID = 2
HEAD = struct.Struct("<8sIQII")
BLOCK_HEAD = struct.Struct("<IBH")


# -- bits -----------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of a multiple of 64 values below 2**width, as rows of 64-bit words."""
    rows, n = values.shape
    if width == 0:
        return np.zeros((rows, 0), np.uint64)
    v = values.reshape(rows, n // 64, 64).astype(np.uint64)
    out = np.zeros((rows, n // 64, width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= v[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= v[:, :, i] >> np.uint64(64 - shift)
    return out.reshape(rows, -1)


def _unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = len(words)
    if width == 0:
        return np.zeros((rows, n), np.uint64)
    w = words.reshape(rows, n // 64, width)
    out = np.empty((rows, n // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = w[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, i] = x & mask
    return out.reshape(rows, n)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of ``ids`` (uint32) and the byte at which each starts."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    full = np.empty(n_blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]  # repeats cost no width
    full = full.reshape(n_blocks, BLOCK)
    low = full.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    most = np.partition(rest, at, axis=1)[:, at] if n_blocks else np.zeros(0, np.uint32)
    widths = np.frexp(most.astype(np.float64))[1]  # bits of an integer below 2**53
    blobs: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        part = rest[chosen]
        words = _pack(part & np.uint32((1 << int(width)) - 1), int(width))
        high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
        for j, b in enumerate(chosen):
            places = np.flatnonzero(high[j])
            blobs[b] = b"".join(
                (
                    BLOCK_HEAD.pack(int(low[b]), int(width), len(places)),
                    words[j].astype("<u8").tobytes(),
                    places.astype("<u2").tobytes(),
                    high[j][places].astype("<u4").tobytes(),
                )
            )
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blobs])[:-1])) if n_blocks else np.zeros(0)
    return blobs, starts.astype("<u8")


def decode_blocks(data: memoryview, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of blocks that start at ``starts`` in ``data``."""
    heads = [BLOCK_HEAD.unpack_from(data, int(s)) for s in starts]
    out = np.empty((len(starts), BLOCK), np.uint32)
    by_width: dict[int, list[int]] = {}
    for b, (_, width, _) in enumerate(heads):
        by_width.setdefault(width, []).append(b)
    for width, chosen in by_width.items():
        size = BLOCK // 64 * width
        words = np.empty((len(chosen), size), np.uint64)
        for j, b in enumerate(chosen):
            words[j] = np.frombuffer(data, "<u8", size, int(starts[b]) + BLOCK_HEAD.size)
        part = _unpack(words, width, BLOCK)
        for j, b in enumerate(chosen):
            low, _, n_high = heads[b]
            if n_high:
                at = int(starts[b]) + BLOCK_HEAD.size + 8 * size
                places = np.frombuffer(data, "<u2", n_high, at)
                part[j, places] |= np.frombuffer(data, "<u4", n_high, at + 2 * n_high).astype(np.uint64) << np.uint64(width)
            out[b] = part[j] + np.uint64(low)
    return out.reshape(-1)[:n]


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blobs, starts = encode_blocks(ids)
    return b"".join(
        (
            HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blobs), BLOCK),
            np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
            np.array([i is None for i in doc_ids], np.uint8).tobytes(),
            np.array(lengths, "<u4").tobytes(),
            starts.tobytes(),
            *blobs,
        )
    )


def from_file(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, all ids."""
    magic, docs, n, blocks, size = HEAD.unpack_from(blob)
    if magic != MAGIC or size != BLOCK:
        raise ValueError("not a token-id file of this format")
    at = HEAD.size
    doc_ids = np.frombuffer(blob, "<i8", docs, at).tolist()
    nulls = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(blob, "<u4", docs, at + 9 * docs).astype(np.int64)
    starts = np.frombuffer(blob, "<u8", blocks, at + 13 * docs)
    data = memoryview(blob)[at + 13 * docs + 8 * blocks :]
    ids = decode_blocks(data, starts, n)
    return [None if x else i for i, x in zip(doc_ids, nulls)], lengths, ids


# -- Spark jobs -----------------------------------------------------------------------


def storage(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's view of a folder that Spark names; Hadoop's names of object stores are Arrow's here."""
    scheme, colon, rest = folder.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfs"}
    return fs.FileSystem.from_uri(f"{known.get(scheme, scheme)}://{rest}" if colon else folder)


SHARE = "n long, first long, last long, ascending boolean"


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last id of a task's share, and whether its ids ascend (none null or repeated)."""
    n, first, last, ascending = 0, None, None, True
    for batch in batches:
        ids = batch.column(0)
        if not len(ids):
            continue
        if ids.null_count:
            ascending = False
            ids = ids.drop_null()
        ids = ids.to_numpy()
        n += batch.num_rows
        if len(ids):
            ascending = ascending and bool((ids[1:] > ids[:-1]).all()) and (last is None or int(ids[0]) > last)
            first = int(ids[0]) if first is None else first
            last = int(ids[-1])
    row = {"n": [n], "first": [first], "last": [last], "ascending": [ascending]}
    yield pa.RecordBatch.from_pydict(row, pa.schema([("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("ascending", pa.bool_())]))


def in_order(shares: DataFrame) -> bool:
    """Whether ids ascend in each share and shares do not overlap; one row for each task."""
    by_first = Window.orderBy("first")
    apart = shares.where("n > 0").select(
        "ascending", (F.col("first") > F.coalesce(F.lag("last").over(by_first), F.col("first") - 1)).alias("apart")
    )
    return apart.where("NOT ascending OR apart IS NULL OR NOT apart").isEmpty()


MANIFEST = "shard long, segment long, path string, n_docs long, n_ids long, first long, last long, ascending boolean"
_MANIFEST = pa.schema(
    [(c, pa.int64()) for c in ("shard", "segment")] + [("path", pa.string())]
    + [(c, pa.int64()) for c in ("n_docs", "n_ids", "first", "last")] + [("ascending", pa.bool_())]
)


def _writer(path: str, classes: Classes, end_id: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, classes).encode
        end = np.array([end_id], "<u4").tobytes()
        store, base = storage(folder)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        segment, held, doc_ids, parts = 0, 0, [], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"{shard:08d}-{segment:06d}-{attempt}.pfor"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(to_file(doc_ids, [len(p) // 4 for p in parts], ids))
            ascending = None not in doc_ids and all(map(int.__lt__, doc_ids, doc_ids[1:]))
            row = (shard, segment, name, len(doc_ids), len(ids), doc_ids[0], doc_ids[-1], ascending)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _MANIFEST.types)], schema=_MANIFEST)

        for batch in batches:
            for own, texts in in_parts(batch):
                for doc_id, ids in zip(own, to_ids(texts)):
                    if parts and held + len(ids) // 4 + 1 > FILE_IDS:
                        yield flush()
                        segment, held, doc_ids, parts = segment + 1, 0, [], []
                    doc_ids.append(doc_id)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
        if parts:
            yield flush()

    return write


def dealt(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` dealt out by ranges of the id, and sorted in each."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id() % 1024)
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    ranged = keyed.repartitionByRange(parts, *order, F.col("salt"))
    return ranged.sortWithinPartitions(*order, "text").select("doc_id", "text")


def written(
    docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes files of all rows to ``folder``; returns their manifest."""
    store, base = storage(folder)
    store.create_dir(base)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    write = _writer(vocabulary, tokenizers_classes(), end_id, folder)
    if in_order(rows.select("doc_id").mapInArrow(_share, SHARE)):
        manifest = cut(rows.mapInArrow(write, MANIFEST))
        if in_order(manifest.withColumn("n", F.col("n_docs"))):
            return manifest
    return cut(dealt(rows).mapInArrow(write, MANIFEST))


READ = "name string, doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc_ids, lengths, ids = from_file(blob)
            data = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(data[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, lengths)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path.rsplit("/", 1)[-1]] * len(doc_ids)), pa.array(doc_ids, pa.int64()),
                    pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                ],
                names=["name", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files.

    Files are decoded where they are read; only a lean row for each document is joined
    with the place of its file.
    """
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # shards are as many as the write had tasks; their sums are all that one task sees
    ahead = Window.orderBy(F.col("from").asc_nulls_last(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.min_by("first", "segment").alias("from")).select(
        "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_first")
    )
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    named = manifest.join(shards, "shard").select(
        F.col("path").alias("name"),
        (F.col("shard_first") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first"),
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    found = files.mapInArrow(_reader, READ).join(named, "name")
    return found.select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/pfor-{uuid.uuid4().hex}"
