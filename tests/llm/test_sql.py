"""Operators that SQL expresses: the same rows over whole tables and over odd ones."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, alike, rows_of
from weftline.llm import catalogue, chat, exact, quality

DOCS = ("op3_quality_rules", "op4_exact_dedup", "op7_line_dedup")


def same(spark, oracle, name, folder):
    names, found = rows_of(catalogue.queries()[name](spark, folder))
    wanted_names, _, wanted = oracle(catalogue.oracle_sql()[name], folder)
    assert names == wanted_names and alike(found) == alike(wanted)
    return len(found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_small_tables(spark, oracle, name):
    assert same(spark, oracle, name, SMALL) > 0


def test_rules_judge_row_by_row(spark, odd_docs):
    rows = quality.judged(odd_docs.select("doc_id", "text"), keep=("doc_id", "text")).collect()
    assert len(rows) == odd_docs.count()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add((r["n_words"], r["failure_bits"], r["kept"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert by_text[""] == {(0, 1, False)}


@pytest.mark.parametrize("name", DOCS)
def test_odd_documents_with_own_ids(spark, oracle, odd_docs, tmp_path, name):
    """SQL has no rule for null and repeated ids; see the tests of these below."""
    odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, oracle, name, str(tmp_path))


@pytest.mark.parametrize("name", DOCS)
def test_empty_table(spark, no_docs, tmp_path, name):
    no_docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert catalogue.queries()[name](spark, str(tmp_path)).count() == 0


def test_accepted_keeps_all_columns(spark, odd_docs):
    kept = quality.accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    whole = quality.judged(odd_docs.select("doc_id", "text")).where("kept").count()
    assert kept.count() == whole > 0 and kept.where("kept <> 'clash'").count() == 0


def test_ablation_by_hand(spark, odd_docs):
    entries = quality.ledger(odd_docs.select("doc_id", "text"))
    bits = [r[0] for r in entries.select("failure_bits").collect()]
    policy = quality.POLICIES["v1"]
    for r in quality.ablation(entries, policy).collect():
        flag = next(1 << x.bit for x in quality.RULES if x.name == r["rule"])
        assert (r["n_failed"], r["n_only"], r["n_docs"]) == (sum(b & flag > 0 for b in bits), sum(b & policy.mask == flag for b in bits), len(bits))


def test_exact_groups_with_null_and_repeated_ids(spark, odd_docs):
    rows = exact.decisions(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_hash = {}
    for r in rows:
        by_hash.setdefault(r["text_sha256"], []).append(r)
    for group in by_hash.values():
        assert sum(r["kept"] for r in group) == 1 and {r["group_size"] for r in group} == {len(group)}
        best = min(group, key=lambda r: (-r["len"], r["doc_id"] is None, r["doc_id"] or 0))
        assert {r["keep_id"] for r in group} == {best["doc_id"]}
    kept = exact.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(by_hash)
    bare = lambda t: "".join((t or "").split())
    assert len({bare(r["text"]) for r in kept.collect()}) == len(by_hash)


def test_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        draws = rng.integers(0, 2**60, n, dtype=np.uint64)
        parts = [np.concatenate((draws, draws[: n // 2])), draws[n // 3 :]]
        blobs = [exact.cqf_pack(*np.unique(p, return_counts=True), 4) for p in parts if len(p)]
        fps, counts = exact.cqf_merge(blobs)
        want = np.unique(np.concatenate(parts), return_counts=True)
        assert (fps == want[0]).all() and (counts == want[1]).all()


@pytest.fixture(scope="session")
def hot_docs(spark):
    """A third of all rows are one text, a third hold one line; ids repeat and are null."""
    line = "a line that a third of all documents of this table hold somewhere"
    rows = [(i, "one text that a third of all rows have, word for word") for i in range(200)]
    rows += [(i if i % 50 else None, f"{line}\n{'x' * 40}{i % 60}\nbye") for i in range(200, 400)]
    rows += [(i // 2, f"text number {i} and some other words, enough to make a line of it") for i in range(800, 1000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("most_hot", [1, 50, 1 << 30])
def test_hot_groups_by_broadcast_and_by_shuffle(spark, odd_docs, hot_docs, most_hot):
    """Nothing, something and everything counts as hot; results are the same."""
    from weftline.llm import lines

    for docs in (odd_docs, hot_docs):
        want = sorted(map(str, exact.decisions(docs).drop("kept").collect()))
        assert sorted(map(str, exact.decisions(docs, most_hot=most_hot, few=0).drop("kept").collect())) == want
        want = sorted(map(str, lines.deduplicated(docs).collect()))
        assert sorted(map(str, lines.deduplicated(docs, most_hot=most_hot, few=0, shard_keys=3, portion=20).collect())) == want


def plain_lines(docs):
    from collections import defaultdict

    from weftline.llm.lines import NO_DOC, line_key

    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[line_key(line, 40)].add(NO_DOC if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keys = [line_key(x, 40) for x in lines]
        stay = [x for x, k in zip(lines, keys) if k is None or len(held[k]) < 5 or max(held[k]) == (NO_DOC if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay).encode()))
    return sorted(out, key=str)


def test_lines_by_brute_force(spark, odd_docs, hot_docs):
    from weftline.llm import lines

    for docs in (odd_docs, hot_docs):
        found = [(r[0], r[1], r[2], bytes(r[3])) for r in lines.deduplicated(docs).collect()]
        assert sorted(found, key=str) == plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_filters_are_maintained(spark):
    import os

    from weftline.llm import lines

    keys = [os.urandom(16) for _ in range(900)]
    df = lambda some: spark.createDataFrame([(bytearray(k),) for k in some], "key binary")
    before, after = df(keys[:500]), df(keys[300:])
    now = lines.maintained(lines.filters(before, 4), before, after, 4).collect()
    tables = {r["shard"]: lines.Cuckoo.from_bytes(bytes(r["filter"])) for r in now}
    where = {bytes(r["key"]): r["shard"] for r in df(keys).select("key", lines.shard_of(4)).collect()}
    assert all(k in tables[where[k]] for k in keys[300:])
    assert sum(k in tables[where[k]] for k in keys[:300]) < 20


def test_dialogues(spark, oracle, tmp_path):
    rows = [
        (1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 1, "bob", "ho", "x"), (1, 1, "bob", "ho", "x"), (1, None, None, None, "x"), (1, 700, "ann", "late <|im_end|>", "x"),
        (None, 1, "", "nobody's", "x"), (2, 0, "system", "alone", "x"), (3, 5, "eve", "日本 " * 3000, "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert same(spark, oracle, "op9_perspective_rotation", str(tmp_path)) == 6 * 3 + 1 + 1
    whole = chat.rotated(df).where("conv_id = 1 AND perspective = 'ann'").orderBy("seg_start").collect()
    assert [r["seg_start"] for r in whole] == [0, *[r["seg_end"] for r in whole][:-1]]
    assert chat.rotated(df.limit(0)).count() == 0
    assert all((r["mask_start"] is None) == (r["chat_role"] != "assistant") for r in whole)


def test_no_python_in_native_plans(spark):
    for name in ("op3_quality_rules", "op9_perspective_rotation"):
        plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_lines_can_be_taken_back(spark, odd_docs):
    from weftline.llm import lines

    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    some, more = docs.where("doc_id < 13"), docs.where("doc_id >= 13")
    state = lines.inserted(some).union(lines.inserted(more)).union(lines.deleted(more))
    back = {(bytes(r["key"]), r["doc_id"]) for r in lines.compacted(state).collect()}
    assert back == {(bytes(r["key"]), r["doc_id"]) for r in lines.references(some).collect()}
    table = lines.compacted(lines.inserted(docs)).drop("sign")
    one = sorted(map(str, lines.deduplicated(docs, refs=table).collect()))
    assert one == sorted(map(str, lines.deduplicated(docs).collect()))
    assert lines.deduplicated(odd_docs).where("n_dropped > 0").count() == 4


def test_cuckoo_filter():
    import os

    from weftline.llm.lines import Cuckoo

    keys = [os.urandom(16) for _ in range(5000)]
    made = Cuckoo.from_bytes(Cuckoo.of(keys).to_bytes())
    assert all(k in made for k in keys)
    assert sum(os.urandom(16) in made for _ in range(5000)) < 50
    assert all(made.delete(k) for k in keys) and not made.tags.any()


def test_line_keys_fold_ascii_only(spark):
    from weftline.llm import lines

    assert lines.line_key("\x0b" + "Ä" * 40, 40) != lines.line_key("ä" * 40, 40)
    assert lines.line_key("A" * 40 + "\r", 40) == lines.line_key("a" * 40, 40)
    assert lines.line_key("a" * 39, 40) is None and F is not None
