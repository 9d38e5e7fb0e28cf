"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents as one array of 16- or 32-bit
little-endian numbers. Where each document ends, and its key, are two
non-decreasing sequences; each is stored as Elias-Fano: of n numbers up to u,
the lower log2(u/n) bits as they are, the upper ones in unary in a bit vector of
about 2n bits. A sample of the places of set bits lets ``select`` find the i-th
number without a table of 64-bit offsets.

Documents are dealt out by ranges of the key, so tasks write files whose names
sort as the keys do. A task writes under a name of its own and then renames, so
that a task that runs twice leaves one file. Only the manifest, a row per file,
carries the ids before a file.

Defined cases: a null or empty text is the end id alone; documents with a null
key come first; documents with equal keys follow one another in the order of
their texts, repeated rows next to each other; an empty table writes no file
and gives an empty result; a text longer than a file makes a file of its own;
other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import fixed
from factloom.llm.tokens import encoder
from factloom.session import ensure_checkpoint_dir

MAGIC = b"EFTOKEN1"
#: Ids after which a task begins another file.
FILE_IDS = 4_000_000
#: Every so many set bits, their place is kept.
SAMPLE = 256
#: UTF-8 bytes, about, that are tokenized at a time.
GROUP = 2_000_000
_HEAD = struct.Struct("<8sBQQq")  # magic, bytes per id, documents with a key, documents without, first key
_EF = struct.Struct("<QBII")  # numbers, low bits, bytes of high bits, samples


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        k = max(0, (most // max(n, 1)).bit_length() - 1)
        shifts = np.arange(k, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(k)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        return EliasFano(n, k, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _EF.pack(self.n, self.low_bits, len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @staticmethod
    def read(data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, k, high, samples = _EF.unpack_from(data, at)
        at += _EF.size
        low = (n * k + 7) // 8
        parts = [np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low)]
        at += low + high
        return EliasFano(n, k, *parts, np.frombuffer(data, "<u4", samples, at)), at + 4 * samples

    def _lows(self, first: int, n: int) -> np.ndarray:
        a, b = first * self.low_bits, (first + n) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(n, self.low_bits).astype(np.uint64) @ weights if self.low_bits else np.zeros(n, np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        wanted, byte = i % SAMPLE, start // 8
        ones = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        ones[: start % 8] = 0
        while (found := int(ones.sum())) <= wanted:
            wanted -= found
            byte += 1
            ones = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        place = byte * 8 + int(np.flatnonzero(ones)[wanted])
        return (place - i << self.low_bits) | int(self._lows(i, 1)[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        upper = (places - np.arange(self.n)).astype(np.uint64)
        return (upper << np.uint64(self.low_bits)) | self._lows(0, self.n)


class TokenFile:
    """One file, as bytes: the ids of any document without reading the others."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, keyed, self.unkeyed, self.first_key = _HEAD.unpack_from(view, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.read(view, _HEAD.size)
        self.keys, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, f"<u{self.width}", offset=at)

    def __len__(self) -> int:
        return self.ends.n

    def key(self, i: int) -> int | None:
        return None if i < self.unkeyed else self.first_key + self.keys.select(i - self.unkeyed)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def to_file(keys: list[int | None], documents: list[np.ndarray], width: int) -> bytes:
    """A file of documents in ascending order of their keys, null keys first."""
    known = [k for k in keys if k is not None]
    first = known[0] if known else 0
    ends = np.cumsum([len(d) for d in documents])
    coded = [EliasFano.of(ends), EliasFano.of(np.array([k - first for k in known], dtype=np.uint64))]
    head = _HEAD.pack(MAGIC, width, len(known), len(keys) - len(known), first)
    return b"".join([head, *[c.to_bytes() for c in coded], *[d.astype(f"<u{width}").tobytes() for d in documents]])


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that every executor sees."""
    return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and folder[6:7] != "/" else folder)


def write(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
    kind: str = "word", file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the files; returns the manifest: file, n_docs, n_ids and ids_before."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary, kind)
        width = max(tool.dtype.itemsize, 2 if end_id < 1 << 16 else 4)
        part, made = TaskContext.get().partitionId(), 0
        store, root = _store(folder)
        keys: list[int | None] = []
        documents: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            name = f"part-{part:08d}-{made:06d}.tokens"
            own = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(to_file(keys, documents, width))
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict(
                {"file": [name], "part": [part], "n_docs": [len(keys)], "n_ids": [sum(map(len, documents))]}
            )
            made += 1
            keys.clear(), documents.clear()
            return row

        held = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts]) // GROUP
            for g in np.unique(size):
                lo, hi = np.searchsorted(size, [g, g + 1])
                encoded = tool.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                for k, data in zip(names[lo:hi], encoded, strict=True):
                    ids = np.append(np.frombuffer(data, tool.dtype).astype(f"<u{width}"), np.array(end_id, f"<u{width}"))
                    if held and held + len(ids) > file_ids:
                        yield flush()
                        held = 0
                    keys.append(k), documents.append(ids)
                    held += len(ids)
        if keys:
            yield flush()

    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    sorted_docs = (
        docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
        .repartitionByRange(*order).sortWithinPartitions(*order, "t")
    )
    manifest = fixed(sorted_docs.mapInArrow(put, "file string, part long, n_docs long, n_ids long"))
    span = F.floor(F.col("part") / 1000)
    whole = manifest.groupBy(span.alias("span")).agg(F.sum("n_ids").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = whole.select("span", F.coalesce(F.sum("n").over(earlier(Window.orderBy("span"))), F.lit(0)).alias("base"))
    inner = F.sum("n_ids").over(earlier(Window.partitionBy("span").orderBy("file")))
    return (
        manifest.withColumn("span", span).withColumn("inner", F.coalesce(inner, F.lit(0)))
        .join(spans, "span").select("file", "n_docs", "n_ids", (F.col("base") + F.col("inner")).alias("ids_before"))
    )


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens and ids_crc32 of 32-bit ids."""
    schema = pa.schema([
        ("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = TokenFile(content.as_buffer())
                ends = data.ends.all().astype(np.int64)
                starts = np.append(0, ends[:-1])
                keys = [None] * data.unkeyed + (data.keys.all().astype(np.int64) + data.first_key).tolist()
                ids = data.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(starts),
                    pa.array(ends - starts), pa.array(crc, pa.int64()),
                ], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(
        take, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return found.join(manifest.select("file", "ids_before"), "file").select(
        "doc_id", (F.col("ids_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(
    docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", kind: str = "word"
) -> DataFrame:
    """Writes the token files of the documents to the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(spark, folder, write(docs, folder, vocabulary, end_id, key, text, kind))
