"""SimHash, secrets and toxicity against plain versions; the whole pipeline."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from conftest import SMALL
from weftline.llm import catalogue, secrets, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    ws = WORD.findall(low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + shingle]) for i in range(len(ws) - shingle + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(docs, radius=2):
    """``doc_id -> smallest reachable id`` by comparing all with all."""
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    bits = np.array([f for _, f in fps], np.uint64)
    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(bits[a + 1 :] ^ bits[a]) <= radius):
            root[find(a + 1 + int(b))] = find(a)
    least = {}
    for n, (i, _) in enumerate(fps):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, f"{f:016x}", least.get(find(n))) for n, (i, f) in enumerate(fps)]


def test_simhash_by_brute_force(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = catalogue.queries()["op6_simhash_near_dedup"](spark, folder).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, rows)) == sorted(plain_components(docs))


def test_simhash_odd(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()]
    rows = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()]
    assert sorted(rows, key=str) == sorted(plain_components(docs), key=str)
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({(c, f if c is None else "") for _, f, c in rows})
    assert simhash.near_duplicates(no_docs).count() == simhash.deduplicated(no_docs).count() == 0


def test_many_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (40, 2))} | {int(b) ^ (0xF << 60) for b in base}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = simhash.links(df, tile=8).collect()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert all(near(r["a"], r["b"]) for r in found)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = find(r["a"] & (1 << 64) - 1), find(r["b"] & (1 << 64) - 1)
        root[max(a, b)] = min(a, b)
    every = sorted(fps)
    assert all(find(a) == find(b) for k, a in enumerate(every) for b in every[k + 1 :] if near(a, b))


def plain_base(text):
    kinds = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20),
        ("hex", r"([0-9a-f]+)", 24),
    ]
    spans = [(m.start(), n, k, m.end()) for n, (k, p, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[1]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


def check_secrets(rows, docs):
    want = sorted(((i, hashlib.sha256(",".join(plain_base(t)).encode()).hexdigest()) for i, t in docs), key=str)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in rows), key=str) == want
    for r in rows:
        spans = [s for s in r["spans"].split(",") if s]
        for kind in secrets.KINDS:
            assert sum(s.startswith(kind + ":") for s in spans) == r[f"n_{kind}"]


def test_secrets(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_secrets(catalogue.queries()["op1_secret_scan"](spark, SMALL).collect(), docs)
    check_secrets(secrets.scanned(odd_docs).collect(), [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()])
    assert secrets.scanned(no_docs).count() == 0
    clean = secrets.without_secrets(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "hunter2" not in texts[11] and "AKIA" not in texts[11] and texts[8] == "a b" and texts[1] is None


def test_randomness():
    import base64
    import random

    rng = random.Random(5)
    hits = 0
    for _ in range(200):
        key = base64.b64encode(bytes(rng.randrange(256) for _ in range(30))).decode()
        hits += bool(secrets.random_runs(f"call it {key} and go on"))
    assert hits >= 180
    words = ["internationalisation2024", "aaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "snake_case_name_of_version_10", "00000000000000000000000000000001", "https-example-com-2024-01-31-report"]
    for w in words:
        assert not secrets.random_runs(f"see {w} there"), w
    assert secrets.random_runs("x " + "0123456789abcdef" * 20_000) == []  # a very long run that is no draw


def test_toxicity_on_held_out_rows(spark):
    folder = SMALL.replace("0.001", "0.1")
    found = catalogue.queries()["op2_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL")
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad = [r["score"] for r in rows if r["toxic"] == 1]
    good = [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    recall, precision = hit / len(bad), hit / max(1, sum(r["predicted"] for r in rows))
    print(f"auc {auc:.4f} recall {recall:.3f} precision {precision:.3f} of {len(bad)}")
    assert auc > 0.95 and recall > 0.85 and precision > 0.85


def test_folding_and_exceptions():
    assert toxicity.folded("Ｉd1оt, sh3 th1nk$!") == " idiot sh think "  # signs at a word's end are no letters
    lexicon = toxicity.Lexicon(((" idiot", 2.0), (" scrap", 1.0)), (" idiotic idea ", " scrapbook"))
    x = toxicity.features("an 1d1ot with a scrapbook, an idiotic idea", lexicon)
    assert x[0] == 2.0 and x[4] == 1.0
    assert toxicity.features("", lexicon)[0] == 0.0


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.scored(odd_docs, toxicity.trained(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.trained(no_docs, labels)
    assert not model.learned and toxicity.scored(no_docs, model).count() == 0


def test_pipeline_odd(spark, odd_docs, no_docs):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() > 0) == (docs is odd_docs)


def test_components_of_long_chains(spark):
    from weftline.operators.components import components

    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.range(500, 520).selectExpr("id AS a", "500L AS b"))
    for most_hot, few in ((1 << 14, 1 << 16), (1 << 14, 0), (4, 0)):  # in one task; by rounds; the star's centre by broadcast
        found = {r["node"]: r["least"] for r in components(edges, most_hot=most_hot, few=few).collect()}
        assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 520), 500)}


