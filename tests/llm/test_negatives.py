"""Hard negatives against all pairs; bounds against exact scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q int, norm string, v int"


def brute(rows):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = ([math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][0], kept[b][0], strict=False))
    out = []
    for a in (i for i in kept if i % 100 == 0):
        every = sorted(((-score(a, b), b) for b in kept if b != a))
        for p, i in [(p, i) for p, i in every if kept[i][1] == kept[a][1]][:5]:
            fit = [(s, b) for s, b in every if kept[b][1] != kept[a][1] and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a, i, k, b, -p, -s) for k, (s, b) in enumerate(fit[:10], 1)]
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    out = negatives.hard_negatives(frame, is_anchor=F.col("id") % 100 == 0, relabel=negatives.SHIFTED)
    return sorted(map(tuple, out.collect()))


def made(seed, n=330, size=6, copies=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    rows = [(i, (centres[rng.integers(5)] + 0.4 * rng.normal(size=size)).tolist(), int(rng.integers(3))) for i in range(n)]
    if copies:
        rows = [(i, rows[0][1] if i % 3 else v, label) for i, v, label in rows]
    return rows


def test_against_all_pairs(spark):
    for rows in (made(1), made(2, copies=True)):
        assert found(spark, rows) == brute(rows)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "CLASSES", 50)
    rows = made(3, n=520)
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    assert found(spark, []) == []
    rows = made(4, n=210) + [
        (None, [1.0] * 6, 1), (300, None, 1), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (302, [float("nan")] * 6, 1), (303, [1.0] * 6, None),
        (400, [0.0] * 6, 2), (401, [0.0] * 6, 2), (402, [0.0] * 6, 1), (500, [1.0], 2), (100, made(4)[100][1], made(4)[100][2]),
    ]
    assert found(spark, rows) == brute(rows)


def test_bounds_hold_and_rule_pairs_out():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 300
    v = np.floor(centres[rng.integers(20, size=4000)] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    units = centres[:16] / np.linalg.norm(centres[:16], axis=1, keepdims=True)
    norm = np.linalg.norm(v, axis=1)
    angles = np.arccos(np.clip(v @ units.T / norm[:, None], -1, 1))
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
    batch = pa.RecordBatch.from_pydict({
        "label": np.zeros(4000, dtype=np.int64), "v": lists(v), "norm": norm, "angles": lists(angles), "ids": lists(np.arange(4000)[:, None]),
    })
    scored = 0
    for a in range(40):
        least, most = negatives.score_bounds(norm[a], angles[a], norm, angles)
        exact = v @ v[a]
        assert (least <= exact).all() and (exact <= most).all()
        best = negatives.Best(int(exact.max() * 0.3), int(exact.max() * 0.9), 10)
        scored += negatives.look([(a, 1, v[a], norm[a], angles[a], {0: best})], batch, same=False)
        fit = exact[(exact >= best.low) & (exact <= best.high)]
        assert best.scores.tolist() == sorted(fit.tolist(), reverse=True)[:10]
    assert scored < 0.5 * 40 * 4000
