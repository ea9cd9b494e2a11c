"""Texts cut into the words of byte-level BPE, many at a time, with numpy.

The words are the matches of the public pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|
?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Which code points are letters, numbers and
spaces differs between versions of Unicode, so the class of each code point is asked of
the library whose ids are to be met (``Classes``), once on the driver; tasks get the
classes as ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
POINTS = 0x110000
#: The endings that the pattern takes after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters that are looked at together.
TOGETHER = 1_000_000


@dataclass(frozen=True)
class Classes:
    """The class of each code point, as ranges of one class."""

    starts: bytes
    kinds: bytes

    @classmethod
    def of(cls, table: np.ndarray) -> Classes:
        starts = np.flatnonzero(np.concatenate(([True], table[1:] != table[:-1])))
        return cls(starts.astype("<i4").tobytes(), table[starts].tobytes())

    def table(self) -> np.ndarray:
        starts = np.frombuffer(self.starts, "<i4")
        return np.repeat(np.frombuffer(self.kinds, np.uint8), np.diff(np.append(starts, POINTS)))


def _table(found: Callable[[str, str], str]) -> Classes:
    """``found(pattern, text)``: the characters of ``text`` that match, in order."""
    table = np.full(POINTS, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, POINTS)]))
    some = found(r"[\p{L}\p{N}\s]", every)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[np.frombuffer(found(pattern, some).encode("utf-32-le"), "<u4")] = kind
    return Classes.of(table)


@lru_cache(maxsize=1)
def tokenizers_classes() -> Classes:
    from tokenizers import Regex, pre_tokenizers

    def found(pattern: str, text: str) -> str:
        cut = pre_tokenizers.Split(Regex(pattern + "+"), "removed", invert=True)
        return "".join([piece for piece, _ in cut.pre_tokenize_str(text)])

    return _table(found)


@lru_cache(maxsize=1)
def tiktoken_classes() -> Classes:
    import tiktoken

    ranks = {bytes((b,)): b for b in range(256)}

    def found(pattern: str, text: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return probe.decode(probe.encode_ordinary(text))

    return _table(found)


def word_starts(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places at which words start. ``first`` marks the starts of texts, ``kind`` has the classes."""
    n = len(codes)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of white space before a word stands alone, or is the word's if it is a blank
    last = np.flatnonzero((kind[:-1] == SPACE) & start[1:] & ~first[1:])
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    # endings after a lone apostrophe that no blank precedes
    lone = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~first[1:])
    for at in lone.tolist():
        for ending in ENDINGS:
            to = at + 1 + len(ending)
            if to <= n and codes[at + 1 : to].tobytes() == ending.encode("utf-32-le") and not first[at + 1 : to].any():
                start[at + 1] = False
                if to < n:
                    start[to] = True
                break
    return np.flatnonzero(start)


class Splitter:
    def __init__(self, classes: Classes):
        self.kinds = classes.table()

    def places(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts joined, the places at which words start there, and how many words each text has."""
        joined = "".join(texts)
        if not joined:
            return joined, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(codes) + 1, bool)
        first[0] = True
        first[ends] = True
        starts = word_starts(codes, self.kinds[codes], first[:-1])
        return joined, starts, np.diff(np.searchsorted(starts, ends), prepend=0)

    def cuts(self, text: str) -> list[str]:
        """A long text in parts of about ``TOGETHER`` characters, cut before blanks that start a word."""
        parts, at = [], 0
        while len(text) - at > TOGETHER:
            to = text.find(" ", at + TOGETHER)
            while to > 0 and self.kinds[ord(text[to - 1])] == SPACE:
                to = text.find(" ", to + 1)
            if to < 0:
                break
            parts.append(text[at:to])
            at = to
        parts.append(text[at:])
        return parts
