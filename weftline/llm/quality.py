"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps what was measured
and one bit for each failed rule; a policy is a versioned choice of rules, applied to
the bits alone, so a new policy or an ablation never reads a text again.

All of it is DataFrame expressions. Nulls: a null text counts as empty (no words, so
``few_words`` fails); a null id is carried as it is. Repeated rows are judged row by
row; other columns are neither read nor needed. An empty table gives an empty ledger.
Very long texts cost one sort of their word windows inside one row. Windows are
compared by a 64-bit hash: two different windows of one text are taken as equal with a
chance below one in 10^10 even for a text of 40,000 words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.texts import SPACE, let, whole, words

SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-Z]"


def count_of(text: Column, characters: str) -> Column:
    """Characters of a class: pieces that they cut the text into, less one."""
    return (F.size(F.split(text, characters)) - 1).cast("long")


def repeated_window_words(ws: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in ``ws``."""
    n = F.size(ws)

    def covered(starts: Column) -> Column:
        # starts ascend; each window adds the words beyond the end of the one before
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct(
                (a["n"] + p + F.lit(width) - F.greatest(p, a["end"])).alias("n"), (p + F.lit(width)).alias("end")
            ),
            lambda a: a["n"],
        )

    def repeats(ordered: Column) -> Column:
        return F.filter(
            F.transform(
                ordered,
                lambda x, j: F.when(
                    (F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False)))
                    | (F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))),
                    x["p"],
                ),
            ),
            lambda p: p.isNotNull(),
        )

    def by_sort(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(ordered, lambda o: covered(F.sort_array(repeats(o))))

    hashes = F.transform(
        F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)])
    )
    checked = let(
        hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), by_sort(h)).otherwise(F.lit(0))
    )
    return F.when(n < width + 1, F.lit(0)).otherwise(checked).cast("long")


def measurements(text: Column) -> Column:
    """One struct with everything that the rules need, from one split of the text."""

    def of(ws: Column) -> Column:
        return let(
            F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            lambda lines: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                count_of(text, SYMBOLS).alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_window_words(ws).alias("n_repeat_words"),
                count_of(text, UPPER).alias("n_upper"),
                count_of(text, "[!]").alias("n_exclaim"),
            ),
        )

    return let(words(text), of)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true. Its bit never changes or is used again."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("word_length", 3, "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("duplicate_lines", 4, "2 * n_dup_lines > n_lines"),
    Rule("upper_case", 5, "10 * n_upper > 4 * word_chars"),
    Rule("exclamations", 6, "2 * n_exclaim > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a document that fails any of them is rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = {r.name: r.bit for r in RULES}
        return reduce(lambda m, name: m | 1 << known[name], self.rules, 0)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {
    p.version: p
    for p in (BASE, Policy("v1", tuple(r.name for r in RULES)), Policy("v0-no-case", tuple(r.name for r in RULES[:5])))
}


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements and ``failure_bits``."""
    measured = docs.select(*[F.col(c) for c in keep], measurements(whole(text_col)).alias("_m"))
    flat = measured.select(*keep, "_m.*")
    return flat.withColumn("failure_bits", failure_bits())


def failure_bits() -> Column:
    """The bits of all rules, from the measurements' columns."""
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES],
    )


def rejected(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, and that only it rejects.

    The ledger shrinks to one row for each pattern of bits (at most 2^rules) before any
    rule is looked at.
    """
    mask = F.lit(policy.mask).cast("long")
    patterns = (
        entries.groupBy(F.col("failure_bits").bitwiseAND(mask).alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n"), F.bit_or("failure_bits").alias("seen"))
    )
    chosen = [r for r in RULES if r.name in policy.rules]
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("flag")) for r in chosen])
    return (
        patterns.select("pattern", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("pattern").bitwiseAND(F.col("r.flag")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("pattern") == F.col("r.flag"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum("n").alias("n_docs"),
        )
    )


def judged(docs: DataFrame, policy: Policy = POLICIES["v1"], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under ``policy``."""
    entries = ledger(docs, text_col, keep)
    base_failed = rejected(F.col("failure_bits"), BASE)
    return entries.withColumn("base_failed", base_failed).withColumn(
        "kept", ~base_failed & ~rejected(F.col("failure_bits"), policy)
    )


def accepted(docs: DataFrame, policy: Policy = POLICIES["v1"], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` and the base rules keep, with their own columns only.

    The row stays in one struct meanwhile, so its columns may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), measurements(whole(text_col)).alias("_m"))
    entries = rows.select("_row", "_m.*").withColumn("failure_bits", failure_bits())
    bits = F.col("failure_bits")
    return entries.where(~rejected(bits, BASE) & ~rejected(bits, policy)).select("_row.*")
