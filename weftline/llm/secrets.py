"""Secret scans: fixed patterns, and a battery of randomness tests.

Fixed patterns give the base spans (``assign``, ``access``, ``hex``). The method adds spans
(``random``): runs of 20 and more characters of an encoding that look drawn by lot, also as
values after ``=``.

* The encoding is inferred from the characters of the run (hexadecimal, base 32, base 36
  in one case, base 64); a run in which only one or two kinds of character occur although
  its encoding has more is taken as a word and left.
* Against "drawn by lot" three tests are made on the places of the characters in the
  encoding's alphabet: chi-squared uniformity, runs above and below the middle, and serial
  correlation of neighbours. A run stays if Bonferroni's combination does not reject.
* Against "ordinary text" the log-likelihood ratio of a uniform draw to the letters of
  ordinary text gives a p-value from its mean and variance over the run's length.
  All runs of a document are held to a Benjamini-Hochberg rate ``RATE``; each p-value is
  divided by a weight in proportion to its run's length (mean one), since short runs carry
  little evidence. All spans are in code points, ends exclusive.

A null text is empty and gives no spans. Null and repeated ids are carried; ties in a
place are ordered by kind. Other columns are not read. An empty table gives an empty
result. A very long text is scanned once for each pattern.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("passw", "secret", "token", "api")
# A run may follow "=" (NAME=value) or stand before it; "=" at its end is padding unless
# more text of the alphabet goes on after it.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
DIGIT = re.compile(r"[0-9]")

RATE = 0.001
LEVEL = 0.001
ALPHABETS = (
    ("hex", "0123456789abcdef", ("d", "l")),
    ("HEX", "0123456789ABCDEF", ("d", "u")),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ("d", "u")),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", ("d", "l")),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("d", "u")),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", ("d", "l", "u")),
)
# Rounded shares in percent of the letters a to z in ordinary English text.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)


def _ordinary(c: str, mixed: bool) -> float:
    """The chance of a character in ordinary text without spaces, in one case or both."""
    if c.isdigit():
        return 0.02 / 10
    if c.isalpha():
        return LETTERS[ord(c.lower()) - 97] / 100 * ((0.93 if c.islower() else 0.04) if mixed else 0.97)
    return 0.01 / 4


def _tail(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


class Encoding:
    def __init__(self, name: str, alphabet: str, kinds: tuple[str, ...]):
        self.name, self.kinds = name, frozenset(kinds)
        self.size = len(alphabet) - 2 * (name == "base64")
        self.place = {c: min(i, self.size - 1) for i, c in enumerate(alphabet)}
        if name == "base64":
            self.place |= {"-": 62, "_": 63}
        self.characters = frozenset(alphabet)
        plain = {c: _ordinary(c, {"l", "u"} <= self.kinds) for c in alphabet}
        odds = {c: math.log(1 / self.size) - math.log(plain[c]) for c in alphabet}
        total = sum(plain.values())
        self.odds = odds
        self.mean = sum(plain[c] / total * odds[c] for c in alphabet)
        self.deviation = math.sqrt(sum(plain[c] / total * (odds[c] - self.mean) ** 2 for c in alphabet))


ENCODINGS = tuple(Encoding(*a) for a in ALPHABETS)


def inferred(run: str) -> Encoding | None:
    """The smallest encoding with all characters of ``run``; None if kinds are missing."""
    used = set(run)
    kinds = {"d" if c.isdigit() else "l" if c.islower() else "u" for c in run if c.isalnum()}
    for e in ENCODINGS:
        if used <= e.characters:
            return e if e.kinds <= kinds else None
    return None


def against_lot(places: list[int], size: int) -> float:
    """Bonferroni's p-value of the three tests of "drawn by lot"."""
    n = len(places)
    counts = [0] * size
    for p in places:
        counts[p] += 1
    chi = sum((c - n / size) ** 2 for c in counts) * size / n
    df = size - 1
    p_chi = _tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    p_chi = 2 * min(p_chi, 1 - p_chi)
    high = [2 * p >= size for p in places]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2 * 0.5**n
    mid = sum(places) / n
    spread = sum((p - mid) ** 2 for p in places)
    if spread:
        lag = sum((a - mid) * (b - mid) for a, b in zip(places, places[1:])) / spread
        p_serial = 2 * _tail(abs(lag + 1 / n) * math.sqrt(n))
    else:
        p_serial = 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def against_text(run: str, e: Encoding) -> float:
    """The p-value of "ordinary text" from the log-likelihood ratio."""
    n = len(run)
    ratio = sum(e.odds[c] for c in run)
    return _tail((ratio - n * e.mean) / (e.deviation * math.sqrt(n)))


def random_runs(text: str) -> list[tuple[int, int]]:
    """Spans of runs that look drawn by lot, at the document's false-discovery rate."""
    seen: list[tuple[float, int, int]] = []
    for m in RUN.finditer(text):
        bare = m[0].rstrip("=")
        if not DIGIT.search(bare):
            continue
        e = inferred(bare)
        if e is None:
            continue
        if against_lot([e.place[c] for c in bare], e.size) < LEVEL:
            continue
        seen.append((against_text(bare, e), m.start(), m.end()))
    if not seen:
        return []
    mean = sum(end - start for _, start, end in seen) / len(seen)
    ranked = sorted((p * mean / (end - start), start, end) for p, start, end in seen)
    last = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= RATE * i / len(ranked)), default=0)
    return sorted((start, end) for _, start, end in ranked[:last])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans; a random run inside a base span adds nothing, one that goes on beyond it does."""
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    more, reach, i = [], 0, 0
    for a, b in sorted(random_runs(text)):
        while i < len(base) and base[i][0] <= a:
            reach, i = max(reach, base[i][1]), i + 1
        if b > reach:
            more.append((a, b, "random"))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each stretch of spans replaced by a mark of its first kind."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{kind} removed]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


#: Rows that a task turns into Python texts at a time.
AT_ONCE = 512
OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(i, AT_ONCE)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, full = spans_of(text or "")
            counts = [sum(s[2] == k for s in full) for k in KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(full)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
        columns = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: counts by kind, ``base_sha256`` and ``spans``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan, OUT)


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        texts = [None if t is None else redacted(t, spans_of(t)[1]) for t in batch.column("text").to_pylist()]
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; all other columns as they are."""
    return docs.mapInArrow(_redact, docs.schema)
