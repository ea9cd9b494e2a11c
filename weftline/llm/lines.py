"""Line dedup that can be undone: reference counts in tables, cuckoo filters in front.

A line's key is the line stripped of white space, A-Z in lower case; keys below
``MIN_CHARS`` code points are never dropped. The exact state is a table of references
``key, doc_id, sign``: one row for each key that a document holds. Inserting documents
appends rows, deleting a document appends the same rows with the sign turned, and
``compacted`` sums them, so any state can be reached again. ``counted`` gives for each
key its reference count and the largest document that holds it.

Frequent keys (``MIN_DOCS`` documents and more) are put into cuckoo filters, one for each
shard of the key space, about ``SHARD_KEYS`` keys to a shard. References meet the filter
of their shard first: it answers "surely not" for nearly all of them, supports deletion,
and never decides. What it lets through is looked up in the exact table. A shard with many
references is dealt out in portions, each with a copy of the filter, and frequent keys are
looked up by broadcast (``skew.joined``), so a line that a third of all documents hold
fills no task. ``maintained`` carries filters from one state of the table to the next.
Texts that lose lines are found by a gate of bounded size; the others do not move.

Keys are compared by their 128-bit XXH3 hash. Nulls: a null text is one empty line; a
null id counts as one document that is smaller than any other. Documents with the same
id count as one document. Repeated lines of one document count once for its key and go or
stay together. Ties between documents end with the largest id. Other columns are not
read. An empty table gives an empty result. Very long texts are handled line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.survivors import FEW_TEXTS
from weftline.operators.skew import MOST_HOT, gate, joined, split
from weftline.session import cut

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 1 << 16
#: References that go with one copy of a filter.
PORTION = 1 << 18
NO_DOC = -(2**63)


def line_key(line: str, min_chars: int) -> bytes | None:
    bare = line.strip(SPACE)
    return xxhash.xxh3_128_digest(bare.encode().lower()) if len(bare) >= min_chars else None


# -- cuckoo filter --------------------------------------------------------------------


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit tags, each key at one of two places.

    Holds copies: a key inserted twice must be deleted twice. A full table doubles and
    takes its keys anew from the exact table, so ``insert`` only reports that it is full.
    """

    SLOTS = 4
    KICKS = 500

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, (int(capacity / (self.SLOTS * 0.85)) or 1).bit_length())
        self.tags = np.zeros((self.buckets, self.SLOTS), np.uint16)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:8], "little") & (self.buckets - 1)
        return tag, one, self._other(one, tag)

    def _other(self, place: int, tag: int) -> int:
        return (place ^ (tag * 0x5BD1E995)) & (self.buckets - 1)

    def insert(self, key: bytes) -> bool:
        tag, one, two = self._places(key)
        for place in (one, two):
            free = np.flatnonzero(self.tags[place] == 0)
            if len(free):
                self.tags[place, free[0]] = tag
                return True
        saved = self.tags.copy()
        place = one
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            tag, self.tags[place, slot] = int(self.tags[place, slot]), tag
            place = self._other(place, tag)
            free = np.flatnonzero(self.tags[place] == 0)
            if len(free):
                self.tags[place, free[0]] = tag
                return True
        self.tags = saved
        return False

    def __contains__(self, key: bytes) -> bool:
        tag, one, two = self._places(key)
        return bool((self.tags[one] == tag).any() or (self.tags[two] == tag).any())

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Membership of many keys, rows of 16 bytes."""
        tag = keys[:, :2].copy().view("<u2")[:, 0].astype(np.int64)
        tag[tag == 0] = 1
        place = np.zeros((len(keys), 8), np.uint8)
        place[:, :6] = keys[:, 2:8]
        mask = self.buckets - 1
        one = place.view("<i8")[:, 0] & mask
        two = (one ^ tag * 0x5BD1E995) & mask
        return (self.tags[one] == tag[:, None]).any(axis=1) | (self.tags[two] == tag[:, None]).any(axis=1)

    def delete(self, key: bytes) -> bool:
        tag, one, two = self._places(key)
        for place in (one, two):
            held = np.flatnonzero(self.tags[place] == tag)
            if len(held):
                self.tags[place, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        capacity = max(1, len(keys))
        while True:
            made = cls(capacity)
            if all(made.insert(k) for k in keys):
                return made
            capacity *= 2

    def to_bytes(self) -> bytes:
        return self.tags.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Cuckoo:
        made = cls.__new__(cls)
        made.tags = np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy()
        made.buckets = len(made.tags)
        return made


# -- exact references -----------------------------------------------------------------


def _references(min_chars: int):
    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                if text and len(text) >= min_chars:
                    found = {line_key(x, min_chars) for x in text.split("\n") if len(x) >= min_chars}
                    found.discard(None)
                    keys += found
                    at += [n] * len(found)
            at = pa.array(at, pa.int64())
            ids, marks = batch.column(0).fill_null(NO_DOC).take(at), batch.column(2).take(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids, marks], names=["key", "doc_id", "mark"])

    return refer


def _own(rows: DataFrame, min_chars: int) -> DataFrame:
    """``key, doc_id, mark`` for each key that a row of ``doc_id, text, mark`` holds."""
    return rows.mapInArrow(_references(min_chars), "key binary, doc_id long, mark long")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))


def references(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, doc_id``: one row for each key that a row of ``docs`` holds."""
    return _own(_rows(docs, doc_id, text), min_chars).drop("mark")


def inserted(docs: DataFrame, **names) -> DataFrame:
    return references(docs, **names).withColumn("sign", F.lit(1))


def deleted(docs: DataFrame, **names) -> DataFrame:
    return references(docs, **names).withColumn("sign", F.lit(-1))


def compacted(state: DataFrame) -> DataFrame:
    """References that stand after all insertions and deletions."""
    return (
        state.groupBy("key", "doc_id").agg(F.sum("sign").cast("int").alias("sign")).where("sign > 0")
    )


def counted(refs: DataFrame, unique: bool = False) -> DataFrame:
    """``key, refs, last_doc``. ``unique``: no document occurs twice for a key in ``refs``."""
    once = refs.select("key", "doc_id") if unique else refs.select("key", "doc_id").distinct()
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("last_doc"))


def shard_of(shards: int, key: str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard")


FILTER = "shard long, filter binary"


def _filter(shard: int, keys: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([Cuckoo.of(keys).to_bytes()], pa.binary())})


def filters(frequent: DataFrame, shards: int) -> DataFrame:
    """``shard, filter``: a cuckoo filter of the frequent keys of each shard that has some."""

    def build(shard: tuple, group: pa.Table) -> pa.Table:
        return _filter(shard[0].as_py(), group.column("key").to_pylist())

    return frequent.select("key", shard_of(shards)).groupBy("shard").applyInArrow(build, FILTER)


def maintained(old: DataFrame, before: DataFrame, after: DataFrame, shards: int) -> DataFrame:
    """Filters of ``after``, made from those of ``before`` by deleting and inserting keys.

    ``before`` and ``after`` are the frequent keys of two states (column ``key``), ``old``
    the filters of the first. A filter that is full takes its keys anew from ``after``.
    """

    def update(shard: tuple, blobs: pa.Table, keys: pa.Table) -> pa.Table:
        rows = list(zip(keys.column("key").to_pylist(), keys.column("was").to_pylist(), keys.column("is").to_pylist()))
        if not any(now for _, _, now in rows):
            return pa.table({"shard": pa.array([], pa.int64()), "filter": pa.array([], pa.binary())})
        if not blobs.num_rows:
            return _filter(shard[0].as_py(), [k for k, _, now in rows if now])
        table = Cuckoo.from_bytes(blobs.column("filter")[0].as_py())
        for key, was, now in rows:
            if was and not now:
                table.delete(key)
        if not all(table.insert(key) for key, was, now in rows if now and not was):
            return _filter(shard[0].as_py(), [k for k, _, now in rows if now])
        return pa.table({"shard": pa.array([shard[0].as_py()], pa.int64()), "filter": pa.array([table.to_bytes()], pa.binary())})

    both = before.select("key", F.lit(True).alias("was")).join(after.select("key", F.lit(True).alias("is")), "key", "full")
    rows = both.select("key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"), shard_of(shards))
    return old.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(update, FILTER)


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References that their filter lets through; each portion's filter comes before its references."""
    table, portion = None, None
    for batch in batches:
        shard, salt, blobs = (batch.column(i) for i in (0, 1, 2))
        starts = shard.to_numpy() << 32 | salt.to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1]))) if len(starts) else []
        stays = np.zeros(len(starts), bool)
        for a, b in zip(cuts, [*cuts[1:], len(starts)]):
            if starts[a] != portion:
                portion, table = starts[a], None
            if blobs[int(a)].is_valid:
                table = Cuckoo.from_bytes(blobs[int(a)].as_py())
                a += 1
            if table is not None and a < b:
                keys = np.frombuffer(b"".join(batch.column(3).slice(a, b - a).to_pylist()), np.uint8).reshape(-1, 16)
                stays[a:b] = table.contains(keys)
        left = batch.filter(pa.array(stays))
        yield pa.RecordBatch.from_arrays([left.column(i) for i in (3, 4, 5)], names=["key", "doc_id", "mark"])


def candidates(own: DataFrame, frequent: DataFrame, shards: int, tables: DataFrame | None = None, portion: int = PORTION) -> DataFrame:
    """``key, doc_id, mark``: references that pass the filters of their shards."""
    tables = filters(frequent, shards) if tables is None else tables
    # as many rows as there are shards
    sizes = own.groupBy(shard_of(shards)).agg(F.count(F.lit(1)).alias("rows"))
    salts = cut(sizes.select("shard", (F.floor(F.col("rows") / portion) + 1).cast("int").alias("salts")))
    first = tables.join(F.broadcast(salts), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), "filter",
        F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("mark"),
    )
    then = own.select("*", shard_of(shards)).join(F.broadcast(salts), "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "mark"), F.col("salts")).cast("long").alias("salt"), F.lit(None).cast("binary").alias("filter"), "key", "doc_id", "mark"
    )
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = first.union(then).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return ordered.mapInArrow(_pass, "key binary, doc_id long, mark long")


# -- applying -------------------------------------------------------------------------


def _without(min_chars: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, texts = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, keys = (text or "").split("\n"), set(gone or ())
                stay = [x for x in lines if not keys or line_key(x, min_chars) not in keys]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                texts.append("\n".join(stay).encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary())],
                names=["doc_id", "n_lines", "n_dropped", "kept_text"],
            )

    return apply


def deduplicated(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text",
    refs: DataFrame | None = None, shard_keys: int = SHARD_KEYS, portion: int = PORTION, most_hot: int = MOST_HOT, few: int = FEW_TEXTS,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` (UTF-8 bytes) of each row of ``docs``.

    ``refs`` gives references kept from before (``compacted``); without it they are taken
    from ``docs``.
    """
    rows = _rows(docs, doc_id, text)
    own = cut(_own(rows, min_chars))
    each = own.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    of_own = each.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("last_doc"), F.sum("n").alias("n"))
    if refs is not None:
        of_own = counted(refs, unique=True).join(of_own.select("key", "n"), "key")
    frequent = cut(of_own.where(F.col("refs") >= min_docs))
    shards = frequent.count() // shard_keys + 1
    passed = candidates(own, frequent, shards, portion=portion)
    found = joined(passed, frequent.select("key", "last_doc", "n"), ["key"], own.count(), most_hot=most_hot, few=few)
    once = found.where("doc_id <> last_doc").groupBy("doc_id", "mark", "key").agg(F.count(F.lit(1)).alias("n"))
    gone = cut(once.groupBy("doc_id", "mark").agg(F.max("n").alias("n"), F.collect_list("key").alias("gone")))
    same = (F.coalesce("doc_id", F.lit(NO_DOC)), F.col("mark"))
    whole, fewer = split(rows, F.xxhash64(*same), cut(gate(gone.select(F.xxhash64("doc_id", "mark")))))
    stays = F.coalesce("text", F.lit(""))
    n_lines = (F.length(stays) - F.length(F.replace(stays, F.lit("\n"), F.lit(""))) + 1).cast("long")
    as_is = whole.select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), stays.cast("binary").alias("kept_text"))
    named = fewer.select(same[0].alias("of"), "mark", "text")
    looked = joined(named, gone.withColumnRenamed("doc_id", "of"), ["of", "mark"], rows.count(), "left", most_hot, few)
    cleaned = looked.select(F.nullif("of", F.lit(NO_DOC)).alias("doc_id"), "text", "gone").mapInArrow(_without(min_chars), OUT)
    return as_is.unionByName(cleaned)


OUT = "doc_id long, n_lines long, n_dropped long, kept_text binary"
