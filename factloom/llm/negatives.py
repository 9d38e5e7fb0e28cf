"""Hard negatives by angular triangle filtering, exact.

Rows are vectors of integers. Every row stores its angles to a few reference
directions. The angle between two rows lies between the largest difference and
the least sum of their angles to one direction; the cosines of both, times the
norms, bound the score (the integer inner product), with room for rounding.

1. Rows of one label and vector are one class, for which the smallest ids are kept.
2. Anchors meet the classes of their label in blocks. Rows of a batch are taken
   in the order of their upper bounds and scored as integers, until no bound
   reaches the last of the best scores found; these go on to the next batch.
3. A positive's score gives a window of scores for its negatives. Anchors meet
   all classes; a class of another label is scored only if its interval meets a
   window above the last of the best scores found for it.

Blocks are of bounded size, whatever the label; anchors with one vector and
label are asked once; a block's rows pass through its task as a stream.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; shorter vectors count as filled up with zeros; a vector
of zeros scores 0 with all; equal scores go by the smaller id; rows that repeat
an id, label and vector are one row; no row with an anchor's id is its positive;
an anchor whose id has several vectors is asked with each; a pair without any
negative gives no row; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import fixed
from factloom.llm.prefix_trie import look_up

#: Reference directions, rows of the sample they are chosen from, anchors and classes of a
#: block, and classes scored between two looks at the bounds.
DIRECTIONS, SAMPLE, ANCHORS, CLASSES, STEP = 16, 2_048, 1_024, 262_144, 512
#: Room for rounding, in radians and as a share of the product of the norms.
ANGLE, SHARE = 1e-6, 1e-9
#: For labels given by a rule of the id.
SHIFTED = "IF(id % 7 = 0, (label + 1) % 10, label)"


def integer_rows(rows: DataFrame, key: str, vector: str, label: str, scale: int, relabel: str) -> DataFrame:
    """(id, label, v) of the rows that take part, once each; v holds floor(scale * x), all of one length."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    present = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.col(label).isNotNull()
    kept = rows.where(present & good).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    filler = F.array_repeat(F.lit(0).cast("long"), longest - F.size("v"))
    return fixed(kept.select("id", F.expr(relabel).cast("long").alias("label"), F.concat("v", filler).alias("v")))


def directions(classes: DataFrame) -> np.ndarray:
    """Unit vectors, each the row of a hashed sample that is farthest from those before."""
    rows = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    sample = np.asarray([r[0] for r in rows], dtype=np.float64)
    norms = np.linalg.norm(sample, axis=1) if len(rows) else np.zeros(0)
    sample = sample[norms > 0] / norms[norms > 0, None] if len(rows) else np.zeros((0, 0))
    chosen: list[np.ndarray] = []
    near = np.full(len(sample), -2.0)
    while len(chosen) < DIRECTIONS and len(sample) and near.min() < 1 - 1e-9:
        chosen.append(sample[int(near.argmin())])
        near = np.maximum(near, sample @ chosen[-1])
    return np.asarray(chosen).reshape(len(chosen), sample.shape[1] if len(sample) else 0)


def _matrix(column: pa.ChunkedArray | pa.Array, n: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def with_angles(classes: DataFrame, units: np.ndarray) -> DataFrame:
    """The classes with their norm and their angles to the reference directions."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), b.num_rows, np.float64)
            norm = np.linalg.norm(v, axis=1)
            cosine = (v @ units.T) / np.where(norm > 0, norm, 1)[:, None] if len(units) else np.zeros((len(v), 0))
            angles = np.arccos(np.clip(cosine, -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(units)), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm), lists], names=[*b.schema.names, "norm", "angles"])

    return fixed(classes.mapInArrow(go, "label long, v array<long>, ids array<long>, norm double, angles array<double>"))


def score_bounds(norm: float, angles: np.ndarray, norms: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible scores of a row with others, from angles to the same directions."""
    least, most = np.zeros(len(norms)), np.full(len(norms), np.pi)
    if len(angles):
        least = np.abs(others - angles).max(axis=1)
        total = others + angles
        most = np.minimum(total, 2 * np.pi - total).min(axis=1)
    size = norm * norms
    room = 1 + SHARE * size
    return size * np.cos(np.minimum(most + ANGLE, np.pi)) - room, size * np.cos(np.maximum(least - ANGLE, 0)) + room


class Best:
    """The best classes of one anchor in one window of scores, by score and smallest id."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.firsts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids: list = []

    def needed(self) -> int:
        """Least score that still counts."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def take(self, scores: np.ndarray, firsts: np.ndarray, ids: pa.Array, rows: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.needed()) & (scores <= self.high))
        if not len(fit):
            return
        best = fit[np.lexsort((firsts[fit], -scores[fit]))[: self.k]]
        both, first = np.concatenate([self.scores, scores[best]]), np.concatenate([self.firsts, firsts[best]])
        lists = self.ids + [ids[int(r)].as_py() for r in rows[best]]
        order = np.lexsort((first, -both))[: self.k]
        self.scores, self.firsts, self.ids = both[order], first[order], [lists[k] for k in order]


def exact_scores(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(one).max(initial=0)) * max(1, len(one))
    if most < 1 << 53:
        return (rows.astype(np.float64) @ one.astype(np.float64)).astype(np.int64)
    return rows @ one


def look(held: list[tuple], rows: pa.RecordBatch, same: bool) -> int:
    """Take the classes of a batch that count for the anchors of a block; how many pairs were scored."""
    scored = 0
    n = rows.num_rows
    v, angles = _matrix(rows.column("v"), n, np.int64), _matrix(rows.column("angles"), n, np.float64)
    norms, labels, ids = rows.column("norm").to_numpy(), rows.column("label").to_numpy(), rows.column("ids")
    firsts = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
    for _, label, one, norm, own, best in held:
        least, most = score_bounds(norm, own, norms, angles)
        usable = np.flatnonzero(labels == label if same else labels != label)
        order = usable[np.argsort(-most[usable], kind="stable")]
        for at in range(0, len(order), STEP):
            rest = order[at : at + STEP]
            needed = {w: w.needed() for w in best.values()}
            if most[rest[0]] < min(needed.values(), default=np.inf):
                break
            overlap = np.zeros(len(rest), dtype=bool)
            for w, low in needed.items():
                overlap |= (most[rest] >= low) & (least[rest] <= w.high)
            rest = rest[overlap]
            scores = exact_scores(v[rest], one)
            scored += len(rest)
            for w in best.values():
                w.take(scores, firsts[rest], ids, rest)
    return scored


def meet(anchors: DataFrame, classes: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, window, score, ids): the k best classes of each anchor's windows, by block.

    Anchors hold q, label, v, norm, angles and their windows (tag, low, high). Labels are
    equal in a block of ``same``; else every block has all labels and equal ones are left out.
    """
    group = F.col("label") if same else F.lit(0).cast("long")
    asked, all_classes = anchors.withColumn("part", group), classes.withColumn("part", group)
    width = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    sizes = asked.groupBy("part").agg(F.count("*").alias("n_asked")).join(
        all_classes.groupBy("part").agg(F.count("*").alias("n_classes")), "part"
    ).select("part", width("n_asked", ANCHORS).alias("ni"), width("n_classes", CLASSES).alias("nj"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    common = ["label", "v", "norm", "angles"]
    no_windows = F.array().cast("array<struct<tag:long,low:long,high:long>>")
    here = look_up(asked, sizes, ["part"], F.col("q")).where("ni is not null").select(
        "part", F.pmod(F.xxhash64("q"), "ni").alias("i"), every("nj").alias("j"), F.lit(0).alias("side"), "q", *common,
        F.array().cast("array<long>").alias("ids"), "windows",
    )
    there = look_up(all_classes, sizes, ["part"], F.col("v")).where("ni is not null").select(
        "part", every("ni").alias("i"), F.pmod(F.xxhash64("v"), "nj").alias("j"), F.lit(1), F.lit(0).cast("long"), *common, "ids",
        no_windows,
    )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "i", "j", "side")])
            cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                own, rows = tuple(keys[:3, a]), batch.slice(a, b - a)
                if own != block:
                    yield from results(held)
                    held, block = [], own
                if keys[3, a] == 0:
                    held += [asked_row(rows, k) for k in range(rows.num_rows)]
                elif held:
                    look(held, rows, same)
        yield from results(held)

    def asked_row(rows: pa.RecordBatch, at: int) -> tuple:
        value = lambda c: rows.column(c)[at].as_py()
        best = {w["tag"]: Best(w["low"], w["high"], k) for w in value("windows")}
        return value("q"), value("label"), np.asarray(value("v"), dtype=np.int64), value("norm"), np.asarray(value("angles")), best

    def results(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = [(q, tag, s, i) for q, *_, best in held for tag, w in best.items() for s, i in zip(w.scores.tolist(), w.ids, strict=True)]
        if out:
            q, tag, score, ids = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(tag), pa.array(score), pa.array(ids, pa.list_(pa.int64()))], names=["q", "tag", "score", "ids"])

    order = ["part", "i", "j", "side"]
    return here.union(there).repartition("part", "i", "j").sortWithinPartitions(*order).mapInArrow(
        go, "q long, tag long, score long, ids array<long>"
    )


def first_rows(found: DataFrame, k: int, name: str) -> DataFrame:
    """(q, tag, name): the k first (score, id) of what all blocks found for a window, in order."""
    rank = lambda *o: F.row_number().over(Window.partitionBy("q", "tag").orderBy(F.desc("score"), *o))
    rows = found.withColumn("n", rank(F.get("ids", F.lit(0)))).where(F.col("n") <= k).select("q", "tag", "score", F.explode("ids").alias("id"))
    rows = rows.distinct().withColumn("n", rank("id")).where(F.col("n") <= k)
    return rows.groupBy("q", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias(name))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, relabel: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``; ``relabel`` an expression of ``id`` and ``label``;
    a negative's score is from ``low`` to ``high`` percent of the positive's.
    """
    valid = integer_rows(rows, key, vector, label, scale, relabel)
    kept = max(positives + 1, negatives)
    smallest = F.dense_rank().over(Window.partitionBy("label", "v").orderBy("id"))
    classes = fixed(valid.withColumn("n", smallest).where(F.col("n") <= kept).groupBy("label", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    classes = with_angles(classes, directions(classes))
    anchors = fixed(valid.where(is_anchor).distinct())
    numbered = fixed(
        classes.join(anchors.select("label", "v").distinct(), ["label", "v"], "left_semi").withColumn("q", F.monotonically_increasing_id())
        .select("q", "label", "v", "norm", "angles")
    )
    asked = fixed(look_up(anchors, numbered.select("label", "v", "q"), ["label", "v"], F.col("id")).select(F.col("id").alias("anchor_id"), "q"))
    window = lambda tag, least, most: F.struct(tag.alias("tag"), least.alias("low"), most.alias("high"))
    end = F.lit(1 << 62)
    everything = numbered.withColumn("windows", F.array(window(F.lit(0).cast("long"), -end, end)))
    best = fixed(first_rows(meet(everything, classes, positives + 1, same=True), positives + 1, "best").drop("tag"))
    ps = F.array_distinct(F.transform("best", lambda x: x["score"]))
    # ceil and floor of a percent of the positive's score, for scores of 0 or more; below 0 no score fits.
    windows = F.transform(F.filter(ps, lambda p: p >= 0), lambda p: window(
        p, F.call_function("div", p * low + 99, F.lit(100)), F.call_function("div", p * high, F.lit(100))
    ))
    searching = fixed(numbered.join(best.select("q", windows.alias("windows")), "q").where(F.size("windows") > 0))
    found = fixed(first_rows(meet(searching, classes, negatives, same=False), negatives, "found"))
    pairs = look_up(asked, best, ["q"], F.col("anchor_id")).where("best is not null").select(
        "anchor_id", "q", F.explode(F.slice(F.filter("best", lambda x: x["id"] != F.col("anchor_id")), 1, positives)).alias("p")
    ).select("anchor_id", "q", F.col("p.id").alias("positive_id"), F.col("p.score").alias("tag"))
    return look_up(pairs, found, ["q", "tag"], F.col("anchor_id")).where("found is not null").select(
        "anchor_id", "positive_id", F.col("tag").alias("positive_score"), F.posexplode("found").alias("at", "f")
    ).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("negative_id"), "positive_score",
        F.col("f.score").alias("negative_score"),
    )


HARD_NEGATIVES_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""
