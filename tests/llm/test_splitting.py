"""Words and ids on every code point, against both libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from weftline.llm import bpe, splitting, wordcache
from weftline.llm.tokens import encoder, vocabulary

POINTS = [*range(0xD800), *range(0xE000, 0x110000)]
FORMS = (lambda c: f"{c}'s", lambda c: f"a{c}b", lambda c: f" {c}")
ODD = ["'s", "'re", "'ll", "'l", "'", " '", "''", "a", "B", "é", "日", "1", "٣", "!", "?", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "　", "\x00", "\x1c", "🙂"]


@pytest.fixture(scope="module")
def libraries():
    ranks = bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return (
        (bpe.codec(vocabulary("byte_bpe_50k.tiktoken"))[0], tik.encode_ordinary),
        (encoder(vocabulary("byte_bpe_50k.json")), lambda t: whole.encode(t, add_special_tokens=False).ids),
    )


def same(libraries, texts):
    for ours, theirs in libraries:
        for text, ids in zip(texts, ours.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == theirs(text), ascii(text[:80])


@pytest.mark.parametrize("form", FORMS)
def test_every_code_point(libraries, form):
    lines = [form(chr(c)) for c in POINTS]
    same(libraries, ["\n".join(lines[i : i + 4096]) for i in range(0, len(lines), 4096)])


def test_odd_neighbours(libraries):
    draw = random.Random(7)
    same(libraries, ["".join(draw.choices(ODD, k=draw.randrange(15))) for _ in range(20_000)])
    same(libraries, ["<|endoftext|>a <|endoftext|>", "", "a" * 20_000, "\n" * 5000, " " * 5000 + "a"])


def test_long_texts_are_cut_between_words(libraries, monkeypatch):
    monkeypatch.setattr(splitting, "TOGETHER", 40)
    monkeypatch.setattr(wordcache, "TOGETHER", 40)
    draw = random.Random(8)
    same(libraries, ["".join(draw.choices(ODD, k=draw.randrange(30, 200))) for _ in range(2000)])
    same(libraries, ["a" * 300, " " * 300])


def _id_of(word):
    return zlib.crc32(word.encode()).to_bytes(4, "little")


def test_many_known_words_are_not_encoded_again():
    calls = []
    cache = wordcache.WordCache(splitting.tokenizers_classes(), lambda w: calls.append(w) or _id_of(w))
    words = [f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17_576 % 26)}{'é' * (i // 456_976)}" for i in range(900_000)]
    texts = ["".join(words[i : i + 100_000]) for i in range(0, len(words), 100_000)]
    assert b"".join(cache.encode(texts)) == b"".join(map(_id_of, words))
    assert sorted(calls) == sorted(words)
    calls.clear()
    assert b"".join(cache.encode(texts)) == b"".join(map(_id_of, words))
    assert len(calls) < len(words) // 5


@pytest.mark.parametrize("limit", (1, 2, 30, 300))
def test_words_that_are_pushed_out(libraries, limit):
    ours, theirs = libraries[1]
    cache = wordcache.WordCache(splitting.tokenizers_classes(), ours.encode_word, limit=limit)
    draw = random.Random(limit)
    letters = "abcdefghij éß日🙂\x00\n'0123 .,"
    for _ in range(200):
        same([(cache, theirs)], ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(draw.randrange(30))])
    same([(cache, theirs)], ["\x00", "\x00\x00", "a" * 15, "a" * 16, "a" * 15 + "\x00", " " + "é" * 7, "é" * 8, "a" * 8, "a" * 8 + "\x00", ""])
