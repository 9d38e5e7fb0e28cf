"""Packing, token files, sampled pieces: against the tokenizers and exact round trips."""

from __future__ import annotations

import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import packing, sampling, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

TEXTS = [
    (1, "Plain words, twice. Plain words, twice."), (2, None), (3, ""), (4, "  two  blanks \n\n and\ttabs \r\n"),
    (5, "naïve café ▁ \U0001f600 中文 \x00 end"), (6, "word " * 3000), (7, "x" * 5000), (8, "\n\n a"), (9, " a b\nc\n d "),
    (9, "same key"), (None, "no key"), (10, "<|endoftext|> [CLS] </s>"),
]


def expected(path: str, end: int) -> list[tuple[int | None, np.ndarray]]:
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return [(k, np.array(tool.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for k, t in TEXTS]


def frame(spark):
    return spark.createDataFrame([(k, t, 0, "x") for k, t in TEXTS], "doc_id long, text string, length int, slice string")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=20))
def test_places(counts):
    capacity = 60
    runs = packing.place(counts, capacity)
    bins, done = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, per, offset in runs:
        for r in range(lo, hi):
            bins[first + (r - lo) // per].append((offset + (r - lo) % per * length, length))
            done[length].append(r)
    assert {k: sorted(v) for k, v in done.items()} == {k: list(range(n)) for k, n in counts.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in pieces) <= 2
    total = sum(k * n for k, n in counts.items())
    assert len(bins) <= 1.5 * max(-(-total // capacity), sum(n for k, n in counts.items() if 2 * k > capacity)) + 1


def test_packing(spark):
    got = packing.pack_documents(frame(spark), BYTES, end_id=2).collect()
    want = []
    for k, ids in expected(BYTES, 2):
        first = (len(ids) - 1) % 1024 + 1
        at = [0, *range(first, len(ids) + 1, 1024)]
        want += [(k, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(frame(spark).limit(0), BYTES, end_id=2).count() == 0


def test_token_files(spark):
    got = token_files.round_trip(frame(spark), WORDS, end_id=1).collect()
    want = sorted(str((k, len(ids), zlib.crc32(ids.tobytes()))) for k, ids in expected(WORDS, 1))
    assert want == sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == [None, *sorted(k for k in keys if k is not None)]
    assert token_files.round_trip(frame(spark).limit(0), WORDS, end_id=1).count() == 0


def test_small_token_files(spark, tmp_path):
    whole = token_files.round_trip(frame(spark), WORDS, end_id=1)
    manifest = token_files.write(frame(spark), str(tmp_path / "f"), WORDS, 1, file_ids=50)
    assert manifest.count() > 3
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    small = token_files.read(spark, str(tmp_path / "f"), manifest)
    assert sorted(map(str, small.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_sampled_pieces(spark):
    docs = frame(spark)
    got = sampling.encode(docs, PIECES).collect()
    assert all(r["lossless"] for r in got)
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t in TEXTS)
    again = sampling.encode(docs.repartition(5), PIECES).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = sampling.encode(docs, PIECES, seed=1).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))
    assert sampling.digests(sampling.encode(docs.limit(0), PIECES)).count() == 0


def test_a_memo_holds_no_more_than_asked_for():
    """The pipeline's packing keeps few chunks, since its workers stand beside a large JVM."""
    from corpus_pipeline import MEMO
    from factloom.llm import tokens

    assert MEMO < tokens.MEMO
    tool = tokens.encoder(BYTES, "byte", 50)
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(40))
        assert np.array_equal(np.frombuffer(tool.encode([text])[0], tool.dtype), tool.ids(text))
        assert len(tool.memo) <= 50 + 1 + 40
    assert tokens.encoder(BYTES, "byte").memo is not tool.memo


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_memory_back_after_a_task():
    """Freed blocks between blocks in use stay with the allocator unless it is told to return them."""
    from factloom.llm.common import tidy

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") // 1_000_000

    held, seen = [], []

    def run(batches):
        blocks = [bytes(1000) for _ in range(200_000)]
        held.extend(blocks[::100])
        del blocks
        seen.append(resident())
        yield from batches

    assert list(tidy(run)(iter([1, 2]))) == [1, 2]
    assert resident() < seen[0] - 80


def test_digests_are_taken_where_the_texts_are_encoded(spark, tmp_path):
    """One Python worker a task: ids and decoded texts of a batch are not held by a second one and the JVM."""
    from factloom.llm.queries import op6_sentencepiece

    docs = spark.createDataFrame(TEXTS * 3, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_sentencepiece(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two_steps = sampling.digests(sampling.encode(docs, PIECES))
    assert got.columns == two_steps.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, two_steps.collect()))


def test_a_draw_stays_at_its_position(monkeypatch):
    """The greatest random number, added to a position, rounds up to the next one."""
    monkeypatch.setattr(sampling, "mix", lambda x: np.full(len(x), (1 << 64) - 1, np.uint64))
    tool, text = sampling.lattices(PIECES, sampling.THETA), "then one more word, and then another"
    (ids,) = tool.sample([text], np.zeros(1, np.uint64))
    assert tool.decode(ids) == text


def test_samples_have_the_probabilities_of_their_ways():
    """Of a short word all ways are listed; the shares of many samples come near their weights."""
    import sentencepiece

    tool, model = sampling.lattices(PIECES, sampling.THETA), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    word = sampling.SPACE + "then"
    ways: dict[tuple, float] = {}

    def walk(at: int, ids: tuple, score: float) -> None:
        if at == len(word):
            ways[ids] = np.exp(sampling.THETA * score)
            return
        for end in range(at + 1, len(word) + 1):
            i = model.piece_to_id(word[at:end])
            if i != model.unk_id() and model.id_to_piece(i) == word[at:end]:
                walk(end, (*ids, i), score + model.get_score(i))

    walk(0, (), 0.0)
    n = 20_000
    seeds = sampling.mix(np.arange(n, dtype=np.uint64))
    found = defaultdict(int)
    for ids in tool.sample(["then"] * n, seeds):
        found[tuple(int(i) for i in ids)] += 1
    assert set(found) <= set(ways)
    total = sum(ways.values())
    for ids, weight in ways.items():
        p = weight / total
        assert abs(found[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


@pytest.mark.parametrize("size", [0, 1, 5, 3000])
def test_packing_of_many(size):
    rng = random.Random(size)
    counts = defaultdict(int)
    for _ in range(size):
        counts[min(1024, int(rng.paretovariate(0.6) * 20))] += 1
    runs = packing.place(counts, 1024)
    assert sum(hi - lo for _, lo, hi, *_ in runs) == size
