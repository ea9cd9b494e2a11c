"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

A text is folded first: lower case, homoglyphs of other scripts and full-width forms to
the Latin letters they resemble, zero-width characters dropped, digits and signs within a
word to the letters they stand for, all else to single spaces. An entry is a word or the
beginning of one, with the space before it (and after it, for a whole word). Where several
entries match at a place the longest counts; an exception, a longer word or phrase that is
innocent although its beginning is not, takes the weight of all that begins inside it.

Training reads labelled rows only, of bounded, documented number: ``MOST_TOXIC`` and
``MOST_CLEAN`` rows with the lowest hash of their id. Entries and exceptions come from one
half of them: candidates are counted by Spark in words of toxic and clean rows, and an
entry's weight is the lower confidence bound of its log rate ratio. On the other half a
logistic regression turns the weight of a text, in sum, at most and normalised by length,
into a score. Labels, language, source and id never enter a score. Scores cover all rows.

A null or empty text has no weight and gets the score of such texts. Null and repeated ids
are carried; repeated labels of an id count as toxic if any is. Other columns are not
read. With no toxic or no clean row to learn from, every score is 0. An empty table gives
an empty result. A very long text is folded and matched once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOXIC = 6000
MOST_CLEAN = 12000
MOST_ENTRIES = 4000
SHORTEST, LONGEST = 3, 8
#: Occurrences of one candidate in one row that are counted.
PER_ROW = 3
LEAST_RATIO = math.log(6)
THRESHOLD = 0.7

# Cyrillic and Greek letters that look like Latin ones, and what stands for letters.
HOMOGLYPHS = dict(zip("авеіјкмнорсѕтухԁԛԝαβγενικορτυχ", "abeijkmhopcstyxdqwabyevikoptux"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | _ZERO_WIDTH
_ODD = re.compile("[Ͱ-ӿԀ-ԯ​-‍⁠﻿­＀-￯]")
_MIXED = re.compile(r"(?<![^\W\d_])[0-9@$]?[^\W\d_]+(?:[0-9@$!|]+[^\W\d_]+)+|(?<![\w@$])[0-9@$]+[^\W\d_]{2,}")
_SUBS = {ord(k): v for k, v in SUBSTITUTES.items()}
_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Words of the folded text, one space before, between and after them."""
    low = text.lower()
    if _ODD.search(low):
        low = unicodedata.normalize("NFKC", low).translate(_TABLE)
    low = _MIXED.sub(lambda m: m[0].translate(_SUBS), low)
    return " " + _OTHER.sub(" ", low).strip() + " "


def candidates(word: str) -> list[str]:
    return [f" {word} ", *[" " + word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]]


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()


@lru_cache(maxsize=4)
def automaton(lexicon: Lexicon):
    import ahocorasick

    made = ahocorasick.Automaton()
    for text, weight in lexicon.entries:
        made.add_word(text, (len(text), weight))
    for text in lexicon.exceptions:
        made.add_word(text, (len(text), 0.0))
    if len(made):
        made.make_automaton()
    return made


FEATURES = 6


def features(text: str, lexicon: Lexicon) -> list[float]:
    """What the regression sees: weight in sum, at most, by length, and hits."""
    words = folded(text)
    n = max(1, words.count(" ") - 1)
    made = automaton(lexicon)
    best: dict[int, tuple[int, float]] = {}
    if len(made):
        for end, (size, weight) in made.iter(words):
            start = end - size + 1
            if start not in best or best[start][0] < size:
                best[start] = (size, weight)
    total = most = hits = 0.0
    quiet = -1
    for start in sorted(best):
        size, weight = best[start]
        if weight == 0.0:
            quiet = max(quiet, start + size - 1)
        elif start >= quiet:
            total += weight
            most = max(most, weight)
            hits += 1
    return [min(total, 30.0), most, total / math.sqrt(n), min(3.0, 10 * total / n), min(hits, 5.0), math.log(n)]


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3


def labelled(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> DataFrame:
    """``text, toxic, half`` of the rows to learn from."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    some = [
        known.where(chosen).orderBy(order, "doc_id").limit(most)
        for chosen, most in ((F.col("toxic") == 1, MOST_TOXIC), (F.col("toxic") != 1, MOST_CLEAN))
    ]
    ids = some[0].union(some[1]).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    half = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int")
    # at most MOST_TOXIC + MOST_CLEAN rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", half.alias("half"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Counter(folded(text or "").split())
            counts[toxic][""] += sum(words.values())
            own: Counter = Counter()
            for word, n in words.items():
                for c in candidates(word):
                    own[c] += n
            for c, n in own.items():
                counts[toxic][c] += min(n, PER_ROW)
    for toxic, found in counts.items():
        items = list(found.items())
        for i in range(0, len(items), 20_000):
            part = items[i : i + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.string()), pa.array([toxic] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())],
                names=["entry", "toxic", "n"],
            )


def learned_lexicon(rows: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Entries and exceptions from labelled rows (``text, toxic``)."""
    counts = (
        rows.select("text", "toxic")
        .mapInArrow(_count, "entry string, toxic int, n long")
        .groupBy("entry")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
        )
    )
    totals = counts.where("entry = ''").first()
    if totals is None or not totals["bad"] or not totals["good"]:
        return Lexicon((), exceptions)
    ratio = F.log((F.col("bad") + 0.5) / F.lit(totals["bad"])) - F.log((F.col("good") + 0.5) / F.lit(totals["good"]))
    doubt = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    judged = counts.where("entry <> ''").withColumn("weight", ratio - doubt)
    best = (
        judged.where((F.col("weight") >= LEAST_RATIO) & (F.col("bad") >= 4))
        .orderBy(F.desc("weight"), "entry")
        .limit(MOST_ENTRIES)
        .collect()
    )
    entries = {r["entry"]: float(r["weight"]) for r in best}
    if not entries:
        return Lexicon((), exceptions)
    # longer words and beginnings that are as usual in clean rows although their beginning is an entry
    begins = [F.substring("entry", 1, k + 1) for k in range(SHORTEST, LONGEST + 1)]
    starts = F.array(*begins)
    short = [e for e in entries if not e.endswith(" ")]
    spared = (
        judged.where((ratio < 0) & (F.col("good") >= 4) & F.arrays_overlap(starts, F.array(*[F.lit(e) for e in short])))
        .orderBy(F.desc("good"), "entry")
        .limit(MOST_ENTRIES)
        .collect()
        if short
        else []
    )
    found = tuple(sorted({r["entry"] for r in spared} - entries.keys() | set(exceptions)))
    return Lexicon(tuple(sorted(entries.items())), found)


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "", lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"]
            )

    return run


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]  # the last one is the constant
    learned: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.zeros(len(x))
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's steps on standardised columns, for the raw ones."""
    mid, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mid) / spread, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        pull = z.T @ (p - y) + ridge * len(y) * w * np.r_[np.ones(len(w) - 1), 0]
        bend = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(bend, pull)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / spread
    return (*raw.tolist(), float(w[-1] - raw @ mid))


def trained(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    rows = labelled(docs, labels)
    lexicon = learned_lexicon(rows.where("half = 0"), exceptions)
    seen = rows.where("half = 1").select("text", "toxic").mapInArrow(_featured(lexicon), "x array<double>, toxic int").collect()
    y = np.array([r["toxic"] for r in seen], float)
    if not len(y) or y.min() == y.max() or not lexicon.entries:
        return Model(lexicon, (0.0,) * (FEATURES + 1), learned=False)
    return Model(lexicon, fitted(np.array([r["x"] for r in seen]), y))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.array([features(t or "", model.lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(x[:, 4].astype(np.int64))],
                names=["doc_id", "score", "predicted", "n_hits"],
            )

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * MOST_ENTRIES entries
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_scorer(shared), "doc_id long, score double, predicted int, n_hits long")
    return found.select(
        "doc_id", F.coalesce(bucket(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits"
    )
