"""Trie of rebuilt conversations against tuples of whole turns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from factloom.llm import prefix_trie

COLUMNS = "conv_id long, turn int, role string, text string, f1 int, depth int"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = (len(nodes[path]) - 1) * words + sum(saved[p] for p in below)
    return sorted(
        (
            min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), len(children.get(path, [])), leaves[path],
            saved[path], hashlib.sha256(",".join(map(str, sorted(c for c in convs if full[c] == path))).encode()).hexdigest(),
        )
        for path, convs in nodes.items()
    )


def found(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS).repartition(3)
    return sorted(map(tuple, prefix_trie.prefix_trie(frame).collect()))


def key(rows):
    return sorted(rows, key=repr)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(90), 60):
        for turn in range(rng.randrange(0, 6)):
            text = rng.choice([None, "", "a b", " a b ", "hello\tthere you", "x"])
            rows.append((c, None if turn == 0 and rng.random() < 0.5 else turn, rng.choice([None, "user", "bot"]), text))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert key(found(spark, rows)) == key(brute(rows))


def test_chain_of_growing_prefixes_and_many_copies(spark):
    rows = [(c, t, "user", f"t{t} w") for c in range(100, 130) for t in range(c - 99)]
    rows += [(c, t, "user", "same") for c in range(200, 400) for t in range(5)]
    assert key(found(spark, rows)) == key(brute(rows))


def test_one_long_conversation_is_carried_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "IDS", 8)
    rows = [(7, t, "user", f"turn {t}") for t in range(900)] + [(27, t, "user", f"turn {t}") for t in range(500)] + [(0, 0, "user", "turn 0")]
    assert key(found(spark, rows)) == key(brute(rows))


def test_clashing_hashes_are_seen_and_all_is_done_again(spark, monkeypatch):
    honest = prefix_trie.references

    def weak(conversations, seed):
        out = honest(conversations, seed)
        return out.withColumns({"d1": F.lit(1).cast("long"), "d2": F.lit(1).cast("long")}) if seed == 0 else out

    monkeypatch.setattr(prefix_trie, "references", weak)
    rows = made(3)
    assert key(found(spark, rows)) == key(brute(rows))


def test_defined_cases(spark):
    assert found(spark, []) == []
    rows = [(None, 1, "user", "x"), (41, 1, "user", "one"), (41, 1, "user", "one"), (41, 2, "user", "w " * 50_000)]
    assert key(found(spark, rows)) == key(brute(rows))
    # 41 alone has no base: where its head is longer than itself, it has no turns and is a member of the root.
    lone = next(c for c in range(21, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1)
    assert found(spark, [(lone, 1, "user", "gone")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
