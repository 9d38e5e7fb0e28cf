"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenized once, in tasks. A document longer than a sequence is
cut into full pieces, of which the first may be shorter. Only the number of
pieces of each length is gathered, at most ``capacity`` numbers at any input
size, and packed as a whole:

1. Pieces over one third of the capacity go at most two to a sequence. Pieces
   over one half open a sequence each; from the tightest gap on, every such
   sequence takes the longest piece over one third that still fits (a maximum
   matching, since what fits a tight gap fits every wider one). Those left pair
   among themselves, longest first.
2. Shorter pieces, longest first, go to the tightest gap that holds them, and
   open a sequence where none does.

The plan lists runs "pieces of this length, ranks from a to b, go to sequences
from s on, at this offset". Its size depends on the capacity alone, so it is
broadcast; each piece finds its place by its rank among the pieces of its
length. Ranks are counted in slices of a length, hence a length that many
pieces share is not one task's work.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` is
packed like any other; repeated rows are packed once each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import fixed, tidy
from factloom.llm.tokens import MEMO, encoder

#: Tokens of a sequence.
CAPACITY = 1024
#: Pieces of one length that are ranked together.
SLICE = 50_000
#: UTF-8 bytes, about, that are tokenized at a time.
GROUP = 2_000_000


def place(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from rank, to rank, first sequence, pieces per sequence, offset).

    The piece of rank r in a run goes to sequence ``first + (r - from) // per``, at
    ``offset + (r - from) % per * length``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: list[int] = []  # gaps for which there are sequences, ascending
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    fresh = 0

    def offer(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not open_at[gap]:
                insort(gaps, gap)
            open_at[gap].append((first, n))

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, per, offset))
        used[length] += n

    def fill(length: int, n: int, first: int, there: int, gap: int, most: int) -> int:
        """Puts up to n pieces into sequences with this gap; returns how many."""
        per = min(gap // length, most)
        n = min(n, per * there)
        full, rest = divmod(n, per)
        put(length, n, first, per, capacity - gap)
        offer(gap - per * length, first, full)
        if rest:
            offer(gap - rest * length, first + full, 1)
        offer(gap, first + full + bool(rest), there - full - bool(rest))
        return n

    def take(k: int) -> tuple[int, int, int]:
        gap = gaps[k]
        first, n = open_at[gap].pop()
        if not open_at[gap]:
            del gaps[k]
        return gap, first, n

    left = {length: n for length, n in counts.items() if n > 0}
    halves = sorted(x for x in left if 2 * x > capacity)
    thirds = sorted(x for x in left if 2 * x <= capacity < 3 * x)
    small = sorted((x for x in left if 3 * x <= capacity), reverse=True)
    for length in reversed(halves):
        n, gap = left[length], capacity - length
        put(length, n, fresh, 1, 0)
        first, fresh = fresh, fresh + n
        while n:
            k = bisect_left(thirds, gap + 1) - 1
            if k < 0:
                break
            other = thirds[k]
            m = min(n, left[other])
            put(other, m, first, 1, length)
            offer(gap - other, first, m)
            first, n, left[other] = first + m, n - m, left[other] - m
            if not left[other]:
                del thirds[k]
        offer(gap, first, n)
    waiting = 0  # length of a piece over one third that is alone in its sequence
    for length in reversed(thirds):
        n = left[length]
        if waiting:
            put(length, 1, fresh - 1, 1, waiting)
            offer(capacity - waiting - length, fresh - 1, 1)
            n, waiting = n - 1, 0
        pairs, single = divmod(n, 2)
        if pairs:
            put(length, 2 * pairs, fresh, 2, 0)
            offer(capacity - 2 * length, fresh, pairs)
            fresh += pairs
        if single:
            put(length, 1, fresh, 1, 0)
            fresh, waiting = fresh + 1, length
    if waiting:
        offer(capacity - waiting, fresh - 1, 1)
    for length in small:
        n = left[length]
        while n:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap, first, there = take(k)
            else:
                gap, first = capacity, fresh
                there = -(-n // (capacity // length))
                fresh += there
            n -= fill(length, n, first, there, gap, capacity)
    return runs


def pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id",
    text: str = "text", kind: str = "byte", keep_ids: bool = False,
    memo: int = MEMO,
) -> DataFrame:
    """Tokenized pieces: key, piece, start, length, ids_crc32 and, if asked for, ids.

    ``memo`` is how many text chunks a worker keeps the ids of.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else []),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, kind, memo)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.maximum(np.diff(np.cumsum([0] + [len(t.as_buffer()) if t.is_valid else 0 for t in texts])), 1)
            part = np.cumsum(size) // GROUP
            for g in np.unique(part):
                lo, hi = np.searchsorted(part, [g, g + 1])
                encoded = tool.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                # All ids of the group in one array, each document's closed by the end id.
                end = np.asarray([end_id], dtype=tool.dtype).tobytes()
                ids = np.frombuffer(end.join(encoded) + end, dtype=tool.dtype).astype("<u4")
                n = np.asarray([len(data) // tool.dtype.itemsize + 1 for data in encoded])
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                stop = ((n - 1) % capacity + 1)[doc] + piece * capacity
                start = np.where(piece == 0, 0, stop - capacity)
                at = (np.cumsum(n) - n)[doc]
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((at + start).tolist(), (at + stop).tolist(), strict=True)]
                kept = [pa.ListArray.from_arrays(np.append(at + start, len(ids)).astype(np.int32), ids.astype(np.int32))] if keep_ids else []
                names = pa.array(keys[lo:hi], pa.int64()).take(pa.array(doc))
                columns = [names, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(stop - start, pa.int64()), pa.array(crc, pa.int64()), *kept]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(tidy(cut), ddl)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, piece, length and ids_crc32."""
    spark = cut.sparkSession
    cut = fixed(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        place(counts, capacity), "length long, lo long, hi long, first long, per long, base long"
    )
    slices = spark.createDataFrame(
        [(k, 1 + n // SLICE) for k, n in counts.items()], "length long, slices long"
    )
    sliced = cut.join(F.broadcast(slices), "length").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "slices")
    )
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy("length", "slice").agg(F.count("*").alias("n")).select(
        "length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    ranked = (
        sliced.withColumn("place", F.row_number().over(inside) - 1)
        .join(before, ["length", "slice"])
        .withColumn("rank", F.col("place") + F.col("before"))
    )
    at = F.col("rank") - F.col("lo")
    return (
        ranked.join(F.broadcast(runs.withColumnRenamed("length", "run_length")),
                    (F.col("length") == F.col("run_length")) & (at >= 0) & (F.col("rank") < F.col("hi")))
        .select(
            *cut.columns, (F.col("first") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
            (F.col("base") + at % F.col("per") * F.col("length")).alias("offset"),
        )
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id",
    text: str = "text", keep_ids: bool = False, memo: int = MEMO,
) -> DataFrame:
    """Pieces of the documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, vocabulary, end_id, capacity, key, text, keep_ids=keep_ids, memo=memo), capacity)
