"""Token ids by the tokenizers library inside Spark tasks."""

from __future__ import annotations

import ctypes
import gc
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftline.llm.splitting import TOGETHER, Classes, tokenizers_classes
from weftline.llm.wordcache import LIMIT, WordCache


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte.

    Printable bytes stand for themselves; the others take the code points from 256 on,
    in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def encoder(path: str, classes: Classes | None = None, limit: int = LIMIT) -> WordCache:
    """The worker's encoder for a tokenizers file, equal to ``encode(text, add_special_tokens=False)``.

    ``classes`` are those of ``tokenizers_classes``, best made once on the driver.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    tokenize = whole.model.tokenize
    letters = byte_letters()
    specials = tuple(t.content for t in whole.get_added_tokens_decoder().values())

    def encode_word(word: str) -> bytes:
        return array("I", [t.id for t in tokenize(word.encode().decode("latin1").translate(letters))]).tobytes()

    def encode_whole(text: str) -> bytes:
        return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()

    return WordCache(classes or tokenizers_classes(), encode_word, specials, encode_whole, limit)


def trim() -> None:
    """Free memory that the worker's allocators still hold goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release() -> None:
    """Gives the encoder's memory back: workers outlive their tasks and turn to other work."""
    encoder.cache_clear()
    trim()


def in_parts(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts (null: empty) of neighbouring rows of ``doc_id, text``, some ``TOGETHER`` bytes at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    share = np.cumsum(size, dtype=np.int64) // TOGETHER
    cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            some = batch.slice(a, b - a)
            yield some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
