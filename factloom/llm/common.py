"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir

#: White space between words: space and the control characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Drop the shuffle files of a step when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, clean: bool = False) -> DataFrame:
    """The frame, written once as Parquet to the shared checkpoint folder; for tables of many small rows.

    With ``clean`` the shuffle files of this step go at its end, not when the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    if clean:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are finished."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return the memory that this worker has freed to the system; both allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The work of a task, after which its worker, which waits for the next one, holds no more than its caches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return work


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd base and its inverse modulo 2**64, for hashes of byte ranges by prefix sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(name: str, base: int, n: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << max(n - 1, 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        known = _POWERS[name] = np.cumprod(step, dtype=np.uint64)
    return known


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of code * base**position before each position, for ``range_hashes``."""
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n)[:n], dtype=np.uint64, out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of codes; equal ranges have equal hashes wherever they stand.

    The difference of two prefix sums is moved to position 0 by the inverse of
    the base, then mixed with the length.
    """
    moved = (sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(sums))[starts]
    return mix(moved ^ (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of several UTF-8 texts, and words per text.

    Only A-Z are lower-cased. A word's hash depends on its bytes alone.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    joined = _LOWER[joined]
    blank = _BLANK[joined]
    inside = ~blank
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    hashes = range_hashes(prefix_sums(joined), starts, ends)
    limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    per_text = np.diff(np.searchsorted(starts, limits), prepend=0)
    return hashes, per_text


def text_groups(texts: Iterable[str | None], most: int = 2 << 20):
    """Ranges of texts of about ``most`` bytes, as UTF-8; a longer text is a range of its own."""
    group, size, first = [], 0, 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if group and size + len(data) > most:
            yield first, group
            group, size, first = [], 0, k
        group.append(data)
        size += len(data)
    if group:
        yield first, group
