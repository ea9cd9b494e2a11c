"""Token ids of whole texts from ids of words, each distinct word encoded once for a while.

Byte-level BPE splits a text into words by a pattern and encodes each by itself. Words of
at most ``SHORT`` bytes are looked up many at a time in a table of arrays (``WordTable``);
the few longer ones in two generations of a dict, the older dropped when the newer is
full. So memory stays bounded while frequent words stay known. Texts with a special token
go the plain way. One encoder lives in each Python worker and serves all its tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from weftline.llm.splitting import TOGETHER, Classes, Splitter

#: Words to keep: two slots of 24 bytes and 16 ids of 4 bytes each, 120 MB at most in all.
LIMIT = 1_000_000
#: Room for ids, for each slot.
IDS = 8
#: The most bytes of a short word: two numbers of 64 bits hold it and its size.
SHORT = 15
#: Of longer words, a generation keeps one for each ``LONG_SHARE`` of the limit.
LONG_SHARE = 8
#: Words with more characters are encoded each time.
LONGEST = 64

#: The low bytes of a 64-bit number.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def keys(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``data``: their first eight bytes, and the next seven with the size on top.

    Equal keys mean equal words where sizes are at most ``SHORT``.
    """
    eights = np.frombuffer(data + bytes(24 + -len(data) % 8), "<u8")
    at = starts >> 3
    down = ((starts & 7) << 3).astype(np.uint64)
    up = np.uint64(64) - down  # numpy shifts by 64 to zero
    one, two, three = eights[at], eights[at + 1], eights[at + 2]
    low = (one >> down | two << up) & LOW_BYTES[np.minimum(sizes, 8)]
    high = (two >> down | three << up) & LOW_BYTES[np.clip(sizes - 8, 0, SHORT - 8)]
    return low, high | np.minimum(sizes, SHORT + 1).astype(np.uint64) << np.uint64(56)


class WordTable:
    """Ids of short words by their keys. A word stands in its slot or, once a newer one took it, beside.

    A word that is pushed out is encoded anew when it comes again.
    """

    def __init__(self, limit: int):
        bits = max(1, (2 * limit - 1).bit_length())
        self.down = np.uint64(64 - bits)
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)  # high 0: free
        self.place = np.zeros(1 << bits, np.int64)  # where the ids begin, above four bits of their count
        self.ids, self.used = np.empty(IDS << bits, np.uint32), 0

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        return (mixed * np.uint64(0xD6E8FEB86659FD93) >> self.down).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is known, and its place."""
        slot = self.slots(low, high)
        known = (self.high[slot] == high) & (self.low[slot] == low)
        rest = np.flatnonzero(~known)
        beside = slot[rest] ^ 1
        slot[rest] = beside
        known[rest] = (self.high[beside] == high[rest]) & (self.low[beside] == low[rest])
        return known, self.place[slot]

    def read(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words at ``places``, joined, and how many each has."""
        counts = places & 15
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat((places >> 4) - ends + counts, counts) + np.arange(total)], counts

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Takes in words that are not known, with their ``ids`` joined."""
        if self.used + len(ids) > len(self.ids):
            self._tidy()
        if self.used + len(ids) > len(self.ids):
            return
        self.ids[self.used : self.used + len(ids)] = ids
        places = (self.used + np.cumsum(counts) - counts) << 4 | counts
        self.used += len(ids)
        slot, chosen = np.unique(self.slots(low, high), return_index=True)
        old = slot[self.high[slot] > 0]
        for kept, new in ((self.low, low), (self.high, high), (self.place, places)):
            kept[old ^ 1] = kept[old]
            kept[slot] = new[chosen]

    def _tidy(self) -> None:
        """Ids of words that were pushed out leave; if that is not half of the room, so does each second word."""
        live = np.flatnonzero(self.high)
        if int((self.place[live] & 15).sum()) > len(self.ids) // 2:
            self.high[live[1::2]] = 0
            live = live[::2]
        ids, counts = self.read(self.place[live])
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.place[live] = (np.cumsum(counts) - counts) << 4 | counts


class _Generation(dict):
    """Ids of words; a missing one is taken from the older generation or encoded."""

    __slots__ = ("old", "encode_word")

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode_word(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class WordCache:
    def __init__(
        self,
        classes: Classes,
        encode_word: Callable[[str], bytes],
        specials: tuple[str, ...] = (),
        encode_whole: Callable[[str], bytes] | None = None,
        limit: int = LIMIT,
    ):
        self.splitter = Splitter(classes)
        self.encode_word = encode_word
        self.specials = specials
        self.encode_whole = encode_whole
        self.limit = limit // LONG_SHARE
        self.known = self._generation({})
        self.table = WordTable(limit)

    def _generation(self, old: dict[str, bytes]) -> _Generation:
        made = _Generation()
        made.old, made.encode_word = old, self.encode_word
        return made

    def _together(self, texts: list[str]) -> list[bytes]:
        joined, starts, words = self.splitter.places(texts)
        if not joined:
            return [b""] * len(texts)
        data = joined.encode()
        points = np.append(starts, len(joined))
        if len(data) > len(joined):  # places of bytes, not of code points
            leads = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)
            bounds = np.append(leads[starts], len(data))
        else:
            bounds = points
        sizes = np.diff(bounds)
        low, high = keys(data, bounds[:-1], sizes)
        found, places = self.table.find(low, high)
        some, counts = self.table.read(places[found])
        sums = np.zeros(len(starts) + 1, np.int64)
        sums[1:][found] = counts
        rest = np.flatnonzero(~found)
        if len(rest):
            others = self._others([joined[a:b] for a, b in zip(points[rest].tolist(), points[rest + 1].tolist())], sizes[rest], low[rest], high[rest])
            sums[1:][rest] = [len(o) // 4 for o in others]
            mark = np.repeat(found, sums[1:])
            ids = np.empty(len(mark), "<u4")
            ids[mark] = some
            ids[~mark] = np.frombuffer(b"".join(others), "<u4")
        else:
            ids = some
        ends = 4 * np.cumsum(sums)[np.append(0, np.cumsum(words))]
        out = ids.astype("<u4", copy=False).tobytes()
        return [out[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def _others(self, words: list[str], sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        """Ids of each word that the table has not; short ones are taken in."""
        if len(self.known) > self.limit:
            self.known.old = {}
            self.known = self._generation(self.known)
        short = (sizes <= SHORT).tolist()
        at = {word: i for i, (word, s) in enumerate(zip(words, short)) if s}
        new = {word: self.encode_word(word) for word in at}
        if new:
            chosen = np.fromiter(at.values(), np.int64, len(at))
            ids = np.frombuffer(b"".join(new.values()), "<u4")
            self.table.add(low[chosen], high[chosen], ids, np.array([len(i) // 4 for i in new.values()], np.int64))
        return [new[word] if s else self.known[word] for word, s in zip(words, short)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The encoded words of each text, joined."""
        out: list[bytes] = [b""] * len(texts)
        some: list[int] = []
        size = 0

        def close() -> None:
            nonlocal some, size
            for i, ids in zip(some, self._together([texts[i] for i in some])):
                out[i] = ids
            some, size = [], 0

        for i, text in enumerate(texts):
            if any(s in text for s in self.specials):
                out[i] = self.encode_whole(text)
            elif len(text) > TOGETHER:
                out[i] = b"".join([self._together([part])[0] for part in self.splitter.cuts(text)])
            else:
                some.append(i)
                size += len(text)
                if size >= TOGETHER:
                    close()
        close()
        return out
