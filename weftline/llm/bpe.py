"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Encoding reads a word byte by byte. A boundary of tokens at some place fixes all tokens
before it: the last token before the boundary is the longest that ends there and is
compatible with its predecessor, that is, the two encode to themselves when put together.
After each byte, every boundary from which a longer token may still begin is one to reckon
with; what the chains of tokens of all of them share is certain and is emitted. A token
has a longest length, so the lookahead is bounded by it.

A state holds no text: for each boundary to reckon with, the token that ends there, the
boundary that this token began at, and how far down the trie of tokens the bytes since
have come. States that agree in these are one, whatever was read before. States and
transitions are built when first met, kept as numbers in flat tables, and dropped together
when there are ``MOST_STEPS`` transitions.

Decoding puts the tokens' bytes together and follows UTF-8 by a state machine over tokens,
so that a character cut between two tokens, or two calls, is completed when its rest
arrives. Only tokens that are not whole characters by themselves need a step.

Nulls: a null text is empty. Null and repeated ids are carried. Other columns are not
read. An empty table gives an empty result. Very long texts and words are read once, with
bounded state.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.splitting import Classes, tiktoken_classes
from weftline.llm.tokens import in_parts
from weftline.llm.wordcache import WordCache

MOST_STEPS = 800_000
MOST_PAIRS = 500_000

ROOT = 0
DEAD = -1
#: A transition in one number: what it emits above, the next state (with a byte's room below) in the low bits.
EMITS = 36
NEXT = (1 << EMITS) - 1


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.written = {i: np.array([i], "<u4").tobytes() for i in self.token}
        self.child: dict[int, int] = {}
        self.ends, self.goes_on = [-1], [True]  # of each node of the trie: the token there, whether it has children
        for data, i in ranks.items():
            node = ROOT
            for byte in data:
                if node << 8 | byte not in self.child:
                    self.child[node << 8 | byte] = len(self.ends)
                    self.goes_on[node] = True
                    self.ends.append(-1)
                    self.goes_on.append(False)
                node = self.child[node << 8 | byte]
            self.ends[node] = i
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[int, int] = {}
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.final: list[bytes] = []
        self.emits: list[bytes] = [b""]
        self.emitted: dict[bytes, int] = {b"": 0}
        self._state(-1, ((-1, -1, ROOT),))

    def merged(self, word: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: the pair of lowest rank (lower than ``below``), leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = below, None
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        found = self.halves.get(token, ())
        if found == ():
            parts = self.merged(self.token[token], token)
            found = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def _kept_apart(self, one: int, two: int) -> bool:
        """Whether no merge crosses the boundary between two tokens.

        The later made of the two tokens at the boundary is undone, again and again; a
        merge across it happens if it comes before what was undone last.
        """
        token, ranks = self.token, self.ranks
        limit = None
        while True:
            across = ranks.get(token[one] + token[two])
            if across is not None and (limit is None or across < limit):
                return False
            left, right = self.half(one), self.half(two)
            if left is None and right is None:
                return True
            # of equal ones the left is made first, so the right is undone first
            if right is None or (left is not None and one > two):
                limit, one = one, left[1]
            else:
                limit, two = two + 1, right[0]

    def compatible(self, one: int, two: int) -> bool:
        if one < 0:
            return True
        key = one << 32 | two
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._kept_apart(one, two)
        return known

    def _chain(self, bounds: list | tuple, at: int) -> bytes:
        """The tokens from the first boundary to the one ``at``."""
        tokens = []
        while at:
            at, token, _ = bounds[at]
            tokens.append(self.written[token])
        return b"".join(reversed(tokens))

    def _state(self, certain: int, bounds: tuple) -> int:
        """The number of a state: ``bounds`` has (began at, token, node) of each boundary.

        The last certain token matters only while a token may begin behind it.
        """
        key = (certain if bounds[0][2] != DEAD else -1, bounds)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.final.append(self._chain(bounds, len(bounds) - 1))
        return number

    def _step(self, state: int, byte: int) -> int:
        certain, bounds = self.states[state]
        child, ends, goes_on = self.child, self.ends, self.goes_on
        began, token, now = -1, -1, []
        for i, (before, last, node) in enumerate(bounds):
            if node != DEAD:
                node = child.get(node << 8 | byte, DEAD)
                if node != DEAD:
                    # the first boundary to match gives the longest token
                    if began < 0 and ends[node] >= 0 and self.compatible(last if i else certain, ends[node]):
                        began, token = i, ends[node]
                    if not goes_on[node]:
                        node = DEAD
            now.append((before, last, node))
        if began < 0:
            raise ValueError(f"no token ends with byte {byte}")
        now.append((began, token, ROOT))
        # boundaries that live, or that a living one's chain goes through
        heirs: list[list[int]] = [[] for _ in now]
        for i in range(len(now) - 1, 0, -1):
            if now[i][2] != DEAD or heirs[i]:
                heirs[now[i][0]].append(i)
        cut = 0
        while now[cut][2] == DEAD and len(heirs[cut]) == 1:
            cut = heirs[cut][0]
        sure = self._chain(now, cut)
        if cut:
            certain = now[cut][1]
        place, left = {cut: 0}, [(-1, -1, now[cut][2])]
        for i in range(cut + 1, len(now)):
            before, last, node = now[i]
            if (node != DEAD or heirs[i]) and before in place:
                place[i] = len(left)
                left.append((place[before], last, node))
        emitted = self.emitted.get(sure)
        if emitted is None:
            emitted = self.emitted[sure] = len(self.emits)
            self.emits.append(sure)
        made = self.steps[state << 8 | byte] = emitted << EMITS | self._state(certain, tuple(left)) << 8
        return made

    def encode(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of one word."""
        if len(self.steps) >= MOST_STEPS:
            self._forget()
        known, state, out = self.steps.get, 0, []
        for byte in word:
            step = known(state | byte)
            if step is None:
                step = self._step(state >> 8, byte)
            if step > NEXT:
                out.append(self.emits[step >> EMITS])
                step &= NEXT
            state = step
        out.append(self.final[state >> 8])
        return b"".join(out)


WHOLE = (0, 0, 0)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """State: bytes still to come, and the range of the next one. None: not UTF-8."""
    left, low, high = state
    if left:
        if not low <= byte <= high:
            return None
        return (left - 1, 0x80, 0xBF) if left > 1 else WHOLE
    if byte < 0x80:
        return WHOLE
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class StreamDecoder:
    """Ids to bytes; ``feed`` gives all whole characters so far, ``close`` says if none is cut."""

    def __init__(self, token: list[bytes]):
        self.token = token
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.size = np.array([len(b) for b in token])
        self.place = np.cumsum(self.size) - self.size
        self.steps: dict[tuple[tuple[int, int, int], int], tuple[int, int, int] | None] = {}
        self.odd = np.array([self._run(WHOLE, b) != WHOLE for b in token])
        self.reset()

    def reset(self) -> None:
        self.state, self.held, self.valid = WHOLE, b"", True

    @staticmethod
    def _run(state, data: bytes):
        for byte in data:
            state = utf8_step(state, byte)
            if state is None:
                return None
        return state

    def _bytes(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        places = np.arange(ends[-1]) + np.repeat(self.place[ids] - ends + size, size)
        return self.bytes[places].tobytes()

    def feed(self, ids: np.ndarray) -> bytes:
        data = self.held + self._bytes(ids)
        state, place = self.state, -1
        for i in np.flatnonzero(self.odd[ids]).tolist():
            if state != WHOLE and i != place + 1:  # a token of whole characters came inside one
                state, self.valid = WHOLE, False
            token = int(ids[i])
            key = (state, token)
            if key not in self.steps:
                self.steps[key] = self._run(state, self.token[token])
            state, place = self.steps[key], i
            if state is None:
                state, self.valid = WHOLE, False
        if state != WHOLE and place != len(ids) - 1 and len(ids):
            state, self.valid = WHOLE, False
        cut = 0
        if state != WHOLE:
            while data[-1 - cut] & 0xC0 == 0x80:
                cut += 1
            cut += 1
        self.state, self.held = state, data[len(data) - cut :]
        return data[: len(data) - cut]

    def close(self) -> tuple[bytes, bool]:
        rest, whole = self.held, self.valid and self.state == WHOLE
        self.reset()
        return rest, whole


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, classes: Classes | None = None) -> tuple[WordCache, StreamDecoder, list[bytes]]:
    """The worker's encoder, decoder and decimal forms for a file of ranks; ``classes`` of the library if none are given."""
    ranks = read_ranks(path)
    machine = Transducer(ranks)
    token = [b""] * (max(ranks.values()) + 1)
    for data, i in ranks.items():
        token[i] = data
    cache = WordCache(classes or tiktoken_classes(), lambda w: machine.encode(w.encode()), limit=250_000)
    return cache, StreamDecoder(token), [b"%d" % i for i in range(len(token))]


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
#: Ids that are decoded in one step of the stream.
STEP = 1 << 16


def _coded(path: str, classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, decoder, decimal = codec(path, classes)
        for batch in batches:
            for doc_ids, texts in in_parts(batch):
                rows = []
                for doc_id, text, data in zip(doc_ids, texts, cache.encode(texts)):
                    ids = np.frombuffer(data, "<u4")
                    said = hashlib.sha256(b" ".join(map(decimal.__getitem__, ids.tolist()))).hexdigest()
                    back = hashlib.sha256()
                    for i in range(0, len(ids), STEP):
                        back.update(decoder.feed(ids[i : i + STEP]))
                    rest, whole = decoder.close()
                    back.update(rest)
                    same = whole and back.digest() == hashlib.sha256(text.encode()).digest()
                    rows.append((doc_id, len(ids), said, back.hexdigest(), same))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def coded(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip`` of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_coded(ranks, tiktoken_classes()), OUT)
