"""Token operators against the libraries, and round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from weftline.llm import bpe, catalogue, packing, pfor
from weftline.llm.tokens import vocabulary

RANKS, JSON = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")
TEXTS = st.text(st.characters(codec="utf-8"), max_size=60) | st.lists(st.sampled_from([" ", "  ", "\n", "the", " The", "'ll", "1234", "!!", "é", "日", "🙂", "\t"])).map("".join)


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def docs_of(spark, folder):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def bpe_rows(texts, tik):
    out = []
    for i, t in texts:
        ids = tik.encode_ordinary(t)
        out.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(tik.decode_bytes(ids))))
    return sorted(out, key=str)


def test_bpe_small(spark, tik):
    rows = catalogue.queries()["op8_byte_bpe"](spark, SMALL).collect()
    assert sorted([tuple(r)[:4] for r in rows], key=str) == bpe_rows(docs_of(spark, SMALL), tik)
    assert all(r["round_trip"] for r in rows)


def test_bpe_odd(spark, odd_docs, no_docs, tik):
    rows = bpe.coded(odd_docs, RANKS).collect()
    assert sorted([tuple(r)[:4] for r in rows], key=str) == bpe_rows([(r["doc_id"], r["text"] or "") for r in odd_docs.collect()], tik)
    assert bpe.coded(no_docs, RANKS).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_transducer_equals_library(text):
    import public_tokenizers
    import tiktoken

    global _TIK
    try:
        tik = _TIK
    except NameError:
        tik = _TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    cache, decoder, _ = bpe.codec(RANKS)
    ids = np.frombuffer(cache.encode([text])[0], "<u4")
    assert ids.tolist() == tik.encode_ordinary(text)
    for step in (1, 3):
        out = [decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)]
        for part in out:
            part.decode()  # never half a character
        rest, whole = decoder.close()
        assert whole and b"".join(out) + rest == text.encode()


def test_decoder_reports_broken_utf8():
    _, decoder, _ = bpe.codec(RANKS)
    ranks = bpe.read_ranks(RANKS)
    decoder.feed(np.array([ranks[b"\xe2"]]))
    assert decoder.close() == (b"\xe2", False)
    decoder.feed(np.array([ranks[b"\xe2"], ranks[b"a"]]))
    assert decoder.close()[1] is False


def check_packing(texts, rows, tokenizer, most_padding):
    from llm.conftest import crc

    want = {}
    for i, t in texts:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.setdefault((i, len(ids)), []).append(ids)
    got, seqs = {}, {}
    for r in rows:
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, docs in want.items():
        pieces = sorted(got.pop(key))
        assert sum(n for _, n, _ in pieces) == key[1] * len(docs)
        known = {(s, n, crc(ids[s : s + n])) for ids in docs for s, n, _ in pieces}
        assert set(pieces) <= known
        covered = sorted((s, s + n) for s, n, _ in pieces)
        assert covered[0][0] == 0 and covered[-1][1] == key[1]
    assert not got
    for pieces in seqs.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    used = sum(n for p in seqs.values() for _, n in p)
    assert used >= (1 - most_padding) * 2048 * len(seqs)


def test_packing_small(spark, tokenizer):
    check_packing(docs_of(spark, SMALL), catalogue.queries()["op5_harmonic_packing"](spark, SMALL).collect(), tokenizer, 0.03)


def test_packing_odd(spark, odd_docs, no_docs, tokenizer):
    tokenizer.encode_special_tokens = False
    check_packing([(r["doc_id"], r["text"] or "") for r in odd_docs.collect()], packing.packed(odd_docs, JSON).collect(), tokenizer, 0.2)
    assert packing.packed(no_docs, JSON).count() == 0


def test_largest_pieces():
    largest = packing.largest_pieces(2048)
    sizes = {2048 // k for k in range(1, 2049)}
    for n in range(1, 2048):
        assert largest[n] == max(s for s in sizes if s <= n)


def check_files(rows, texts, tokenizer):
    from llm.conftest import crc

    rows = sorted(rows, key=lambda r: r["start"])
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append([*tokenizer.encode(t, add_special_tokens=False).ids, 2])
    at = 0
    for r in rows:
        mine = next(x for x in ids[r["doc_id"]] if (len(x), crc(x)) == (r["n_tokens"], r["ids_crc32"]))
        ids[r["doc_id"]].remove(mine)
        assert r["start"] == at
        at += len(mine)
    assert not any(ids.values())
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))


def test_files_small(spark, tokenizer):
    check_files(catalogue.queries()["op10_pfor_files"](spark, SMALL).collect(), docs_of(spark, SMALL), tokenizer)


def test_files_odd(spark, odd_docs, no_docs, tokenizer):
    folder = pfor.new_folder(spark)
    rows = pfor.read(spark, folder, pfor.written(odd_docs, JSON, folder)).collect()
    check_files(rows, [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()], tokenizer)
    folder = pfor.new_folder(spark)
    assert pfor.read(spark, folder, pfor.written(no_docs, JSON, folder)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    blobs, starts = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(memoryview(b"".join(blobs)), starts, len(ids)) == ids).all()
    for n in range(len(blobs)):  # any block alone
        part = pfor.decode_blocks(memoryview(blobs[n]), np.array([0]), min(pfor.BLOCK, len(ids) - n * pfor.BLOCK))
        assert (part == ids[n * pfor.BLOCK : (n + 1) * pfor.BLOCK]).all()
