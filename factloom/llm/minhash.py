"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts makes, per document, the size and a 128-bit digest of
   its set of word shingles, the keys of its bands of minima, and the low bits
   of all minima, packed.
2. Equal digests are one class; its smallest document stands for it.
3. Documents that share a band are candidates. In each bucket a scan keeps
   leaders: a document close to one (by its corrected estimate) joins it, any
   other becomes a leader; a document is tied to every leader that could have a
   partner of it. The estimate counts equal packed values by bit operations and
   takes off the chance agreement of b bits. Jaccard distance is a metric, so a
   pair at the threshold always shares a leader, and comparing with leaders
   instead of each other needs no pairs within a bucket.
4. Each group of tied documents is checked on full sets: blocks of bounded size
   meet in tasks, estimates rule out most pairs, sizes others, and the rest are
   counted exactly unless both are already connected. Only a spanning set of
   confirmed links leaves a task.
5. Components of the confirmed links give the result.

Bands are many and short, so that a pair at the threshold is missed with a
probability under 3e-7. Leaders and estimates have a margin of four standard
deviations or more.

Defined cases: texts without words (or null) have an empty set and are linked
with nothing; a row without ``doc_id`` is linked with nothing, has no
``component_id`` and is kept; repeated rows of one document share its component;
rows of one ``doc_id`` with different texts are judged by their texts; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fixed, mix, text_groups, tidy, word_hashes
from factloom.llm.components import components

#: Words in a shingle; bands, minima in a band, and bits kept of each minimum.
WORDS, BANDS, ROWS, BITS = 5, 32, 6, 4
HASHES = BANDS * ROWS
#: Documents of a bucket that one scan takes; shingles of one block of the exact step.
SCAN, BLOCK = 4_096, 400_000
#: UTF-8 bytes, about, that are hashed together; a byte takes some 50 bytes of arrays.
GROUP = 1 << 20
#: Margin of estimates, in similarity: four standard deviations at 192 minima of 4 bits.
MARGIN = 0.12
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))
_PLACES = mix(np.arange(2001, 2002 + WORDS, dtype=np.uint64)) | np.uint64(1)
_ONES = np.uint64(0x1111111111111111)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct word shingles of each text."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    sums = np.zeros(max(n - words + 1, 0), dtype=np.uint64)
    for k in range(words if len(sums) else 0):
        sums += hashes[k : n - words + 1 + k] * _PLACES[k]
    sums = mix(sums)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(sums[at : at + count - words + 1]))
        elif count:
            parts = np.append(hashes[at : at + count], np.uint64(count)) * np.append(_PLACES[:count], _PLACES[words])
            out.append(mix(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += count
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] ^ _OFFSETS
        part *= _FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 to a 64-bit number."""
    low = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from packed minima, chance agreement taken off."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    equal = 1 - np.bitwise_count(x & _ONES).sum(axis=1) / HASHES
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (two numbers), bands and packed minima of each text."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("minima", pa.binary()),
    ])
    bands = np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, group in text_groups((t.as_py() for t in batch.column(1)), GROUP):
                rows = []
                for found in shingle_sets(group):
                    digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                    if len(found):
                        least = minima(found)
                        lines = mix(least.reshape(BANDS, ROWS) + bands * np.arange(1, ROWS + 1, dtype=np.uint64))
                        keyed = mix((lines * _PLACES[:1]).cumsum(axis=1, dtype=np.uint64)[:, -1] + bands[:, 0])
                        rows.append((len(found), *digest, keyed.view(np.int64), packed(least).tobytes()))
                    else:
                        rows.append((0, *digest, None, None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([
                    keys.slice(first, len(group)),
                    *[pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True)],
                ], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        tidy(sign), "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, minima binary"
    )


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal first columns, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            own = tuple(c[a] for c in columns)
            if held and own != name:
                yield name, held
                held = []
            name = own
            held.append(batch.slice(a, b - a))
    if held:
        yield name, held


def _joined(parts: list[pa.RecordBatch], column: int) -> pa.Array:
    return pa.concat_arrays([p.column(column) for p in parts])


def _matrix(parts: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.frombuffer(b"".join(_joined(parts, column).to_pylist()), np.uint64).reshape(-1, HASHES * BITS // 64)


class Union:
    """Disjoint sets of a task's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


def tied(signs: np.ndarray, threshold: float) -> np.ndarray:
    """For the documents of a bucket, the row that stands for each one's tied group.

    Leaders: a document at least ``threshold`` close to a leader adds none. If x
    and y are a pair, x has a leader l with d(x, l) <= 1 - threshold (or is one),
    so d(y, l) <= 2 (1 - threshold): y is tied to every leader so close.
    """
    n = len(signs)
    label, leaders = np.arange(n), np.zeros(n, dtype=np.int64)
    count, loose = 0, 1 - 2 * (1 - threshold) - 2 * MARGIN
    for k in range(n):
        there = leaders[:count]
        close = similarity(signs[k], signs[there])
        met = np.unique(label[there[close >= loose]])
        if len(met):
            label[k] = met[0]
        for other in met[1:]:
            label[: k + 1][label[: k + 1] == other] = met[0]
        if not count or close.max() < threshold:
            leaders[count] = k
            count += 1
    return label


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect, at least, all documents similar at the threshold."""
    spread = reps.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1")
    members = (
        spread.join(buckets, "bucket")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), 1 + F.floor(F.col("n") / SCAN)))
        .join(reps.select("doc_id", "minima"), "doc_id")
        .select("bucket", "salt", "doc_id", "minima", "lead", (F.col("n") > SCAN).alias("split"))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs(batches, 2):
            ids = _joined(parts, 2).to_numpy()
            root = tied(_matrix(parts, 3), threshold)
            a, b = ids, ids[root]
            if parts[0].column(5)[0].as_py():  # the scans of one bucket are tied by their groups' first rows
                heads = ids[np.unique(root)]
                a, b = np.append(a, heads), np.append(b, np.full(len(heads), parts[0].column(4)[0].as_py()))
            different = a != b
            yield pa.RecordBatch.from_pydict({"a": a[different], "b": b[different]})

    return (
        members.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "doc_id")
        .mapInArrow(tidy(scan), "a long, b long")
    )


def linked(
    ids: np.ndarray, sets: list[np.ndarray], signs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """A spanning set of the pairs, one of ``left`` and one of ``right``, that reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.ravel()
    mark = np.zeros(len(values), dtype=np.int32)
    groups, out = Union(len(ids)), []
    roots = groups.roots()
    within = left is right
    for at, x in enumerate(left.tolist()):
        others = right[at + 1 :] if within else right
        others = others[(roots[others] != roots[x]) & (ids[others] != ids[x])]
        small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[100 * small >= percent * large]
        if len(others):
            others = others[similarity(signs[x], signs[others]) >= percent / 100 - MARGIN]
        if not len(others):
            continue
        own = codes[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        if 8 * len(others) < len(ids):
            common = np.array([mark[codes[starts[y] : starts[y] + sizes[y]]].sum() for y in others])
        else:
            common = np.add.reduceat(mark[codes], starts)[others]
        mark[own] = 0
        hits = others[100 * common >= percent * (sizes[x] + sizes[others] - common)]
        for y in hits.tolist():
            if groups.join(x, y):
                out.append((int(ids[x]), int(ids[y])))
        if len(hits):
            roots = groups.roots()
    return out


def confirmed(docs: DataFrame, reps: DataFrame, groups: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """Links (a, b) on full sets, enough to connect all documents that reach the threshold."""
    sizes = reps.join(groups, F.col("doc_id") == F.col("node"))
    blocks = sizes.groupBy("root").agg((1 + F.floor(F.sum("n_shingles") / BLOCK)).alias("blocks"))
    wanted = sizes.join(blocks, "root").select("doc_id", "digest_a", "digest_b", "minima", "root", "blocks")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in text_groups((t.as_py() for t in batch.column("text")), GROUP):
                part = batch.slice(first, len(group))
                data = [s.tobytes() for s in shingle_sets(group)]
                digests = [hashlib.blake2b(d, digest_size=16).digest() for d in data]
                own = [np.frombuffer(d, np.int64).tolist() for d in digests]
                given = zip(part.column("digest_a").to_pylist(), part.column("digest_b").to_pylist(), strict=True)
                same = pa.array([a == list(b) for a, b in zip(own, given, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("root", "blocks", "doc_id", "minima")] + [pa.array(data, pa.binary())],
                    names=["root", "blocks", "doc_id", "minima", "shingles"],
                ).filter(same)

    sets = texts.join(wanted, "doc_id").select("root", "blocks", "doc_id", "minima", "text", "digest_a", "digest_b")
    sets = sets.mapInArrow(tidy(hashed), "root long, blocks long, doc_id long, minima binary, shingles binary")
    block = F.pmod(F.xxhash64("doc_id"), "blocks")
    pairs = (
        sets.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "doc_id", "block", "minima", "shingles")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), parts in runs(batches, 3):
            ids, block = _joined(parts, 3).to_numpy(), _joined(parts, 4).to_numpy()
            own = [np.frombuffer(s, np.uint64) for s in _joined(parts, 6).to_pylist()]
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            found = linked(ids, own, _matrix(parts, 5), left, left if i == j else right, percent)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())
            })

    return (
        pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "doc_id")
        .mapInArrow(tidy(link), "a long, b long")
    )


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets.
    """
    signed = fixed(signatures(docs, key, text))
    digest = ["n_shingles", "digest_a", "digest_b"]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    reps = fixed(
        usable.join(classes, digest).where("doc_id = rep").drop("rep").dropDuplicates(["doc_id", *digest])
    )
    tie = components(candidates(reps, percent / 100))
    links = components(confirmed(docs, reps, tie, percent, key, text))
    rooted = classes.join(links, F.col("rep") == F.col("node"), "left").select(
        *digest, F.coalesce("root", "rep").alias("component")
    )
    has_set = F.col("n_shingles") > 0
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(has_set, F.col("component")), F.col("doc_id")))
    return signed.select("doc_id", *digest).join(rooted, digest, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def unique(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest key, with all its columns.

    Rows that share a key are one document, of which one row stays; rows without key all stay.
    """
    kept = near_duplicates(docs, percent, key, text).where("kept and doc_id is not null").select(
        F.col("doc_id").alias(key)
    ).distinct()
    named = docs.where(F.col(key).isNotNull())
    return named.join(kept, key, "left_semi").dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))
