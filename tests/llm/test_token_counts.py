"""Compiled token counts against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = (
    "a e s t ' 1 23 ! ? ... 's 're 'll 've 'd é ß 日 本 語 Ⅷ ² ٣ 'S _ == \x00 ǅ हि ไทย Ω r l v rel thing the ing "
    "<|endoftext|> <|endoftext 😀 aaaa"
).split(" ") + [" ", "  ", "\n", "\t", "\r\n", "　", "\xa0", "\x1c", "\x85", "​"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.compiled(PATH))


def library(texts):
    encoder = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(counter):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(12)) for _ in range(2000)]
    assert counter.counts(texts).tolist() == library(texts)


def test_long_words_windows_and_full_tables(counter, monkeypatch):
    rng = random.Random(6)
    texts = ["a" * 5000, " " * 3000 + "x", "ab" * 2000, "".join(rng.choice("etaoin") for _ in range(9000)), None, ""]
    texts.append(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(4000)))
    monkeypatch.setattr(token_counts, "WINDOW", 2000)
    monkeypatch.setattr(token_counts, "ENTRIES", 500)
    assert counter.counts(texts).tolist() == library(texts)
    assert len(counter.pairs.steps) <= 501


def test_chunk_maps_compose_to_the_sequential_run(counter):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 12, 5000).astype(np.uint8)
    codes[-1] = token_counts.END
    after, marks = token_counts.cutter_tables()
    state, begins = token_counts.START, set()
    for k, c in enumerate(codes.tolist()):
        mark = marks[state * 16 + c]
        begins |= {k} if mark & token_counts.HERE else set()
        begins |= {k - 1} if mark & token_counts.BEFORE else set()
        state = after[state * 16 + c]
    assert counter.cutter.starts(codes).tolist() == sorted(begins)


def test_frame(spark):
    rows = [(1, None, 7), (2, "", 7), (2, "two words", 7), (2, "two words", 7), (None, "x " * 600, 7), (4, "ß<|endoftext|>", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = token_counts.token_counts(docs, PATH)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(k, len((t or "").encode()), n, n > 512) for (k, t, _), n in zip(rows, library([t for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.compiled(public_tokenizers.path("word_bpe_49k.json"))
