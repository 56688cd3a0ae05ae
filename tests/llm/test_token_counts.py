import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ordermill.llm import token_counts as tc

PIECES = ["'", "s", "re", "ve", "ll", "l", "r", "don", " ", "\n", "1", "23", "!", "...", "é", "É",
          "ß", "İ", "Σ", "ΑΣ", "中", "😀", "<|endoftext|>", "<|", "|>", "́", "ing", "believ",
          "able", "Q", "_", "٣", "Ⅷ", " ", "​"]


@pytest.fixture(scope="module")
def library(word_bpe):
    return Tokenizer.from_file(word_bpe)


@pytest.fixture(scope="module")
def counter(word_bpe):
    return tc.TokenCounter(word_bpe)


def expected(library, texts):
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_equal_the_library(spark, library, given, word_bpe):
    got = {r.doc_id: r for r in tc.count_tokens(given("documents"), word_bpe).collect()}
    for r in given("documents").select("doc_id", "text").collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        row = got.pop(r.doc_id)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(r.text.encode()), n > 2048)
    assert not got


def test_random_texts(library, counter):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdeinorst", k=rng.randint(1, 60))) for _ in range(1000)]
    assert counter(texts).tolist() == expected(library, texts)


def test_texts_beyond_a_block_and_a_chunk(library, counter, monkeypatch):
    monkeypatch.setattr(tc, "BLOCK", 1 << 12)
    rng = random.Random(2)
    texts = ["".join(rng.choices(PIECES, k=9000)), "x" * 5000, "don't 'll " * 3000]
    assert counter(texts).tolist() == expected(library, texts)


def test_forgetting_states_changes_nothing(library, word_bpe, monkeypatch):
    monkeypatch.setattr(tc, "KEPT_TRANSITIONS", 50)
    monkeypatch.setattr(tc, "KEPT_WORDS", 5)
    texts = ["unbelievable internationalisation of tokenizers " * 3, "the quick brown fox"]
    assert tc.TokenCounter(word_bpe)(texts).tolist() == expected(library, texts)


def test_scan_composes_maps_in_order():
    maps = np.random.default_rng(3).integers(0, 7, (13, 7)).astype(np.uint8)
    state = np.arange(7)
    for own, scanned in zip(maps, tc.compose(maps), strict=True):
        state = own[state]
        assert (scanned == state).all()


def test_odd_rows(library, odd_documents, word_bpe):
    got = tc.count_tokens(odd_documents, word_bpe)
    rows = {(r.doc_id, r.n_bytes): r.n_tokens for r in got.collect()}
    assert got.count() == 9
    assert rows[1, 0] == rows[2, 0] == 0
    for r in odd_documents.filter("text IS NOT NULL").collect():
        assert rows[r.doc_id, len(r.text.encode())] == expected(library, [r.text])[0]
    assert tc.count_tokens(odd_documents.limit(0), word_bpe).count() == 0


def test_every_letter_counts_as_in_the_library(library, counter, word_bpe):
    points = [*range(0x80, 0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200)]
    texts = [f"it's{chr(p)}ab {chr(p)}! {chr(p)}1" for p in points]
    wanted = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert counter(texts).tolist() == wanted
    *_, odd = tc.library_letters(word_bpe)
    assert 0 < len(odd) < 200
    texts = [f"x {c} y Q{c.upper()}" for c in odd]
    assert counter(texts).tolist() == expected(library, texts)
