from __future__ import annotations

import random
import sys

import public_tokenizers
import pytest

from carryover.llm import token_counts as T

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(NAME))


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def odd_texts():
    draw = random.Random(5)
    letters = "aAbBeEhHnNtTzZ0129 '.,!-\t\n"
    out = ["", " ", "don't I'LL we've 'S", "aaaa" * 50, "ab" * 3000, "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>", "<|EndOfText|>",
           "é éé İΣ Σσ ẞ", "a b\u0085c d\x1ce\x0bf", "你好 한국어", "\U0001f600\U0001f468‍\U0001f469", "1234 12a34",
           "한", "̈́x", "The quick brown fox" * 20]
    for _ in range(300):
        out.append("".join(draw.choice(letters) for _ in range(draw.randint(1, 80))))
    for _ in range(200):
        out.append("".join(chr(draw.choice([draw.randint(0x20, 0x250), draw.randint(0x250, 0xD7FF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(draw.randint(1, 30))))
    return out


def test_every_character_against_the_library(library):
    vocab = T.Vocabulary(public_tokenizers.path(NAME))
    for start in range(1, sys.maxunicode, 4096):
        chars = [chr(c) for c in range(start, min(start + 4096, sys.maxunicode)) if not 0xD800 <= c <= 0xDFFF]
        if start < 0x3000:
            for c in chars[:: 1 if start < 0x400 else 7]:
                assert vocab.count([f"a{c}b {c}".encode()]) == [count(library, f"a{c}b {c}")], hex(ord(c))
        text = " ".join(chars[::5])
        assert vocab.count([text.encode()]) == [count(library, text)]


def test_table_against_the_library(spark, library, monkeypatch):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (1, None), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted((i is None, i or 0, len((t or "").encode()), count(library, t or ""), count(library, t or "") > 20) for i, t in rows)
    got = T.token_counts(docs, limit=20).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_long_texts_and_a_small_memory(library, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 50)
    monkeypatch.setattr(T, "WORDS_KEPT", 20)
    monkeypatch.setattr(T, "SYMBOLS_AT_ONCE", 30)
    vocab = T.Vocabulary(public_tokenizers.path(NAME))
    for text in odd_texts()[:200]:
        assert sum(vocab.count([p])[0] for p in T._pieces(text.encode())) == count(library, text)


def test_out_of_order_vocabulary_merges_one_by_one(library):
    vocab = T.Vocabulary(public_tokenizers.path(NAME))
    vocab.in_order = False
    for text in odd_texts()[:120]:
        assert vocab.count([text.encode()]) == [count(library, text)]


def test_empty_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, n_tokens int, n_bytes string"
    assert T.token_counts(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in T.token_counts(spark.createDataFrame([(4, "Hi there", 9, "x")], schema)).collect()] == [(4, 8, 2, False)]
