"""Near copies against Jaccard similarity of all with all."""

import random
from fractions import Fraction

import pytest

from weftline.llm import nearcopies


def shingle_set(text, n=5):
    ws = text.lower().split()
    return {" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def plain_groups(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5):
                links += sets[a] != sets[b]
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(docs):
        least[find(n)] = min(i, least.get(find(n), i))
    return {i: least[find(n)] for n, (i, _) in enumerate(docs)}, links


@pytest.fixture(scope="module")
def edited():
    """Texts of 6 to 400 words, each with copies of some words changed, at similarities around 0.8 and above."""
    rng = random.Random(11)
    docs = []
    for size in (6, 9, 14, 30, 60, 120, 240, 400) * 6:
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        docs.append(base)
        for share in (0.004, 0.008, 0.012, 0.018, 0.024, 0.03):
            copy = list(base)
            for k in rng.sample(range(size), max(1, round(share * size))):
                copy[k] = f"x{rng.randrange(3000)}"
            docs.append(copy)
        docs.append(base + ["one", "more"])
    rng.shuffle(docs)
    return [(i, " ".join(ws)) for i, ws in enumerate(docs)]


def test_recall_against_brute_force(spark, edited):
    want, links = plain_groups(edited)
    df = spark.createDataFrame(edited, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.grouped(df).collect()}
    assert links > 300 and found == want
    kept = {r["doc_id"] for r in nearcopies.deduplicated(df).collect()}
    assert kept == set(want.values()) and len(kept) < len(edited)


def test_pipeline_stage_removes_edited_copies(spark, edited):
    import corpus_pipeline

    want, _ = plain_groups(edited)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r["doc_id"] for r in stage(spark, spark.createDataFrame(edited, "doc_id long, text string"), "").collect()}
    assert kept == set(want.values())


def test_candidates_are_all_pairs_within_the_radius(spark, edited):
    """SimHash alone makes candidates: all with all gives the same pairs, whatever the blocks and tiles."""
    import numpy as np

    rng = np.random.default_rng(7)
    sets = {nearcopies.sign(h): h for h in (nearcopies.shingles(t.encode()) for _, t in edited)}
    rows = [(node, len(h), *np.frombuffer(nearcopies.bits_of(h), np.int64).tolist()) for node, h in sets.items()]
    for node in range(60):  # fingerprints without a common text, near ones and complements among them
        flips = np.packbits(rng.permutation(256) < (node % 4) * 64 + node // 30)
        rows.append((node, 40, *(np.frombuffer(flips.tobytes(), np.int64)).tolist()))
    bits = [np.array(r[2:], np.int64).view(np.uint64) for r in rows]
    want = set()
    for i, r in enumerate(rows):
        for j, o in enumerate(rows[:i]):
            near = int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= nearcopies.RADIUS
            if near and min(r[1], o[1]) >= 0.8 * max(r[1], o[1]) - 1e-9:
                want.add((min(r[0], o[0]), max(r[0], o[0])))
    names = "node long, n long, bits0 long, bits1 long, bits2 long, bits3 long"
    for tile in (16, 2048):
        placed = nearcopies.blocks(spark.createDataFrame(rows, names), tile).selectExpr("*", "node AS label")
        found = nearcopies.candidates(placed, nearcopies.cells(placed), tile=tile, few=len(rows)).collect()
        assert len(found) == len(want) > 700 and {(r["a"], r["b"]) for r in found} == want


def test_small_tiles_and_places_lose_nothing(spark, edited):
    some = edited[:120]
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    for n in range(60):  # one large group
        copy = list(base)
        copy[n * 3] = f"y{n}"
        some = [*some, (1000 + n, " ".join(copy))]
    df = spark.createDataFrame(some, "doc_id long, text string")
    want = plain_groups(some)[0]
    for hashes in (2000, nearcopies.HASHES):
        found = {r["doc_id"]: r["component_id"] for r in nearcopies.grouped(df, tile=16, few=0, hashes=hashes).collect()}
        assert found == want


def test_islands_of_a_family_stay_apart(spark):
    """Copies of one base that differ in more than a fifth link only where sets say so."""
    rng = random.Random(5)
    base = [f"w{n}" for n in range(150)]
    some = []
    for island in range(6):
        root = list(base)
        for k in rng.sample(range(150), 5):
            root[k] = f"i{island}_{k}"
        for n in range(25):
            copy = list(root)
            for k in rng.sample(range(150), rng.choice((1, 2, 3))):
                copy[k] = f"y{rng.randrange(3000)}"
            some.append((island * 25 + n, " ".join(copy)))
    want, _ = plain_groups(some)
    df = spark.createDataFrame(some, "doc_id long, text string")
    for few in (0, nearcopies.FEW):
        found = {r["doc_id"]: r["component_id"] for r in nearcopies.grouped(df, tile=32, few=few).collect()}
        assert found == want
    assert 1 < len(set(want.values())) < len(some)


def test_common_counts():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, size).astype(np.int64)) for size in (0, 1, 50, 5000, 8000, 8000)]
    found = nearcopies._common(sets)
    assert all(found[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_pipeline_whole(spark, oracle, tokenizer):
    """The whole pipeline against a plain version, with near copies by Jaccard similarity."""
    import corpus_pipeline
    from conftest import SMALL
    from llm.test_search import WORD
    from llm.test_tokens import check_packing
    from weftline.llm import catalogue, secrets

    names, _, judged = oracle(catalogue.oracle_sql()["op3_quality_rules"], SMALL)
    good = {r[names.index("doc_id")] for r in judged if r[names.index("kept")]}
    groups = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").collect():
        if r["doc_id"] in good:
            groups.setdefault("".join(WORD.findall(r["text"])), []).append((-len(r["text"]), r["doc_id"], r["text"]))
    rest = [(i, t) for _, i, t in (min(g) for g in groups.values())]
    least, _ = plain_groups(rest)
    want = {i: secrets.redacted(t, secrets.spans_of(t)[1]) for i, t in rest if least[i] == i}
    assert len(want) < len(rest)
    tokenizer.encode_special_tokens = False
    check_packing(list(want.items()), corpus_pipeline.run(spark, SMALL).collect(), tokenizer, 0.05)
