"""Exact top-k search by integer inner product, in three phases with a uniform threshold.

The components of a vector are dealt to two lists, each of which gives a part of
the score. Queries and candidates meet in blocks; a task computes the parts.

1. Each block takes its best entries of each list and sends the best of their
   full scores. The k-th best score gathered for a query is its cutoff: at
   least k candidates reach it.
2. The cutoff goes back with the query. A candidate whose score reaches it has a
   part of at least half of it, so only entries of a list at that threshold count.
3. The missing part of those entries is added, and the scores that reach the
   cutoff are sent and ranked.

Equal vectors are one candidate, for which the k + 1 smallest ids are kept (one
may be the query's own row), and equal queries are one query: a vector that
very many rows share costs one row. Scores are exact: the sums are formed in
doubles while they stay under 2**53, in 64-bit integers else.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as filled up with zeros; a row without id takes
no part; equal scores go by the smaller id; rows that repeat an
id and its vector are one row; an id with several vectors is a query for each of
them, and none of them is its candidate; fewer candidates than k give fewer rows; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import fixed
from factloom.llm.minhash import runs

#: Rows of a block of queries and of candidates, queries scored at a time, and entries
#: that a block looks at per list in phase 1.
QUERIES, CANDIDATES, TILE, DEPTH = 2_048, 8_192, 256, 64
LOWEST = -(1 << 62)


def quantized(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v) of the rows that take part; v holds floor(scale * x), all of one length."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & good).select(
        F.col(key).cast("long").alias("id"), whole.alias("v")
    )
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    filler = F.array_repeat(F.lit(0).cast("long"), longest - F.size("v"))
    return fixed(kept.select("id", F.concat("v", filler).alias("v")))


def _parts(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both lists' parts of the scores."""
    most = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(candidates).max(initial=0)))
    half = queries.shape[1] // 2
    if most * max(1, queries.shape[1]) < 1 << 53:
        q, c = queries.astype(np.float64), candidates.astype(np.float64)
        return (q[:, :half] @ c[:, :half].T).astype(np.int64), (q[:, half:] @ c[:, half:].T).astype(np.int64)
    return queries[:, :half] @ candidates[:, :half].T, queries[:, half:] @ candidates[:, half:].T


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n highest scores of each row, in any order."""
    if scores.shape[1] <= n:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(scores, scores.shape[1] - n, axis=1)[:, -n:]


def gathered(first: np.ndarray, second: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Phase 1: for each query, the candidates with the best full scores among each list's best."""
    tops = np.concatenate([_best(first, max(k, DEPTH)), _best(second, max(k, DEPTH))], axis=1)
    for q in range(len(first)):
        cols = np.unique(tops[q])
        full = first[q, cols] + second[q, cols]
        yield q, cols[np.argsort(-full, kind="stable")[:k]]


def sufficient(first: np.ndarray, second: np.ndarray, cutoffs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Phases 2 and 3: entries of a list at half the cutoff, then full scores at the cutoff."""
    least = -(-cutoffs // 2)[:, None]
    rows, cols = np.nonzero((first >= least) | (second >= least))
    full = first[rows, cols] + second[rows, cols]
    reached = full >= cutoffs[rows]
    rows, cols = rows[reached], cols[reached]
    for q, part in zip(np.unique(rows), np.split(cols, np.flatnonzero(np.diff(rows)) + 1), strict=False):
        yield int(q), part


def scored(queries: DataFrame, candidates: DataFrame, k: int, final: bool) -> DataFrame:
    """(query, candidate, score) from blocks of queries (rep, v, cutoff) and candidates (rep, v)."""
    rows = max(1, -(-queries.count() // QUERIES)), max(1, -(-candidates.count() // CANDIDATES))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    here = queries.select(own(rows[0]).alias("i"), every(rows[1]).alias("j"), F.lit(0).alias("side"), "rep", "v", "cutoff")
    there = candidates.select(every(rows[0]).alias("i"), own(rows[1]).alias("j"), F.lit(1).alias("side"), "rep", "v", F.lit(0).cast("long"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs(batches, 2):
            side, rep, cutoff = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (2, 3, 5))
            v = np.concatenate([p.column(4).flatten().to_numpy() for p in parts]).reshape(len(rep), -1)
            q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(q) or not len(c):
                continue
            for at in range(0, len(q), TILE):
                tile = q[at : at + TILE]
                first, second = _parts(v[tile], v[c])
                found = sufficient(first, second, cutoff[tile]) if final else gathered(first, second, k)
                pairs = [(np.full(len(cols), x), cols) for x, cols in found]
                if pairs:
                    x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {"query": rep[tile][x], "candidate": rep[c][y], "score": first[x, y] + second[x, y]}
                    )

    return (
        here.union(there).repartition("i", "j").sortWithinPartitions("i", "j", "side", "rep")
        .mapInArrow(score, "query long, candidate long, score long")
    )


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query; ``is_query`` is a condition on ``id``."""
    valid = quantized(rows, key, vector, scale)
    first = valid.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = fixed(classes.select(F.element_at("ids", 1).alias("rep"), "ids", "v"))
    asked = fixed(valid.where(is_query).join(classes.select("rep", "v"), "v").select(F.col("id").alias("query_id"), "rep").distinct())
    candidates = classes.select("rep", "v")
    wanted = asked.select("rep").distinct()
    queries = fixed(candidates.join(wanted, "rep", "left_semi").withColumn("cutoff", F.lit(LOWEST)))
    # Phase 1.
    seen = scored(queries, candidates, k + 1, final=False)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))
    cutoffs = seen.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("query").agg(
        F.when(F.count("*") == k + 1, F.min("score")).otherwise(LOWEST).alias("cutoff")
    )
    # Phases 2 and 3.
    again = fixed(queries.drop("cutoff").join(cutoffs, F.col("rep") == F.col("query")).select("rep", "v", "cutoff"))
    best = scored(again, candidates, k + 1, final=True).withColumn("n", rank).where(F.col("n") <= k + 1)
    named = best.join(classes.select(F.col("rep").alias("candidate"), "ids"), "candidate").select(
        "query", "score", F.explode("ids").alias("vec_id")
    )
    out = asked.join(named, F.col("rep") == F.col("query")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "rep").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
