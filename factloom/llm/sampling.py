"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

All ways to cut a text into pieces of the vocabulary form a lattice. A way has
probability proportional to exp(THETA * sum of piece scores). Forward filtering
sums up, for each position, the weights of all ways that lead there; backward
sampling draws the last piece, then the one before it, and so on, so that ways
come out with their exact probabilities. The random numbers are a hash of the
row's key and the position, so a row's segmentation is the same in every run,
whatever rows are around it.

Pieces hold the space mark only at their front. The lattice of a text is thus a
chain of lattices of its words, and those of the distinct words of some texts are
filtered together, as arrays. A character outside the vocabulary, and the space mark
itself, is spelled in byte pieces; hence decoding gives back every text.

Defined cases: a null or empty text has no pieces and is decoded as an empty
text; rows without key share one seed; repeated rows get equal pieces; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import mix, prefix_sums, range_hashes

#: Sharpness of the distribution; scores of this vocabulary are ranks, down to -32,000.
THETA = 0.0005
#: Score of a character spelled in bytes.
SPELLED = -40_000.0
#: Characters that are sampled together; their lattice takes up to some 300 bytes each.
GROUP = 1_000_000
SPACE = "▁"
#: Stands for a space mark of the text; no valid text holds it.
_OWN_MARK = "\udfff"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Lattices:
    """Piece lattices of words, as arrays of edges sorted by the position where they end."""

    def __init__(self, path: str, theta: float = THETA):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.theta = theta
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.spelling: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelling.append(bytes([int(piece[3:5], 16)]))
            else:
                self.spelling.append(piece.replace(SPACE, " ").encode() if plain else b"")
            if plain and SPACE not in piece.lstrip(SPACE):
                self.pieces[piece] = (i, theta * model.get_score(i))
        self.longest = max(map(len, self.pieces))
        self.table = [self._of_length(n) for n in range(self.longest + 1)]

    def _of_length(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, ids and weights of the pieces of n characters, by hash, and which upper 16 bits the hashes have."""
        own = [p for p in self.pieces if len(p) == n]
        at = np.arange(len(own)) * n
        hashes = range_hashes(prefix_sums(self._codes("".join(own))), at, at + n)
        order = np.argsort(hashes)
        ids, weights = (np.array([self.pieces[p][k] for p in own]) for k in (0, 1))
        begun = np.zeros(1 << 16, dtype=bool)
        begun[hashes >> np.uint64(48)] = True
        return hashes[order], ids[order], weights[order], begun

    def _codes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lattices of distinct words: edges sorted by the position where they end, then by their start.

        Returns the start in the word and the piece (or minus one minus the character) of each edge, and a
        number that grows over all edges: the position among all characters plus the running
        probability of the edges that end there.
        """
        codes = self._codes("".join(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sums = prefix_sums(codes)
        ends, lengths, pieces, scores = [], [], [], []
        single = np.zeros(len(codes), dtype=bool)
        for length in range(min(self.longest, int(sizes.max(initial=0))), 0, -1):
            hashes, ids, weights, begun = self.table[length]
            if not len(hashes):
                continue
            end = np.flatnonzero(within >= length - 1)
            own = range_hashes(sums, end + 1 - length, end + 1)
            # Most ranges are no piece, and the upper bits of their hashes tell
            maybe = np.flatnonzero(begun[own >> np.uint64(48)])
            end, own = end[maybe], own[maybe]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[at] == own
            ends.append(end[hit]), pieces.append(ids[at[hit]]), scores.append(weights[at[hit]])
            lengths.append(np.full(int(hit.sum()), length))
            if length == 1:
                single[end[hit]] = True
        spelled = np.flatnonzero(~single)
        ends.append(spelled), pieces.append(-1 - codes[spelled].astype(np.int64))
        lengths.append(np.ones(len(spelled), np.int64)), scores.append(np.full(len(spelled), self.theta * SPELLED))
        end, length, piece, score = (np.concatenate(x) for x in (ends, lengths, pieces, scores))
        order = np.argsort(end * 64 + 63 - np.minimum(length, 63), kind="stable")
        end, length, piece, score = end[order], length[order], piece[order], score[order]
        start = within[end] + 1 - length
        # Forward filtering, over all words at once, one position after another.
        forward, chance = np.zeros(len(codes)), np.zeros(len(end))
        levels = within[end]
        # Numpy sorts 16-bit numbers by radix; longer words are rare
        short = len(levels) and int(levels.max()) < 1 << 15
        by_level = np.argsort(levels.astype(np.int16) if short else levels, kind="stable")
        limits = np.searchsorted(levels[by_level], np.arange(int(levels.max(initial=-1)) + 2))
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            e = by_level[a:b]
            to = end[e]
            weight = np.where(start[e] > 0, forward[to - length[e]], 0.0) + score[e]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            count = np.diff(np.append(first, len(to)))
            most = np.maximum.reduceat(weight, first)
            part = np.exp(weight - np.repeat(most, count))
            total = np.add.reduceat(part, first)
            forward[to[first]] = most + np.log(total)
            chance[e] = part / np.repeat(total, count)
        running = np.cumsum(chance)
        last = np.flatnonzero(np.diff(end, append=-1))
        before = np.append(0.0, running[last[:-1]])
        count = np.diff(np.append(-1, last))
        bound = end + np.clip(running - np.repeat(before, count), 0.0, 1.0)
        bound[last] = end[last] + 1.0
        return start, piece, bound

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text; ``seeds`` are unsigned 64-bit numbers."""
        marked = [(" " + t if t else "").replace(SPACE, _OWN_MARK).replace(" ", SPACE) for t in texts]
        words = [_WORD.findall(m) for m in marked]
        index = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        order = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64)
        if not len(order):
            return [np.zeros(0, np.int32) for _ in texts]
        start, piece, bound = self.edges(list(index))
        sizes = np.fromiter(map(len, index), np.int64, len(index))
        base = np.append(0, np.cumsum(sizes)[:-1])  # positions before each distinct word
        opened = np.searchsorted(bound, np.arange(int(sizes.sum())), side="right")  # first edge of each position
        # Where each word stands: in its text, and among all characters.
        lengths = sizes[order]
        ends = np.cumsum(lengths)
        text_size = np.array([len(m) for m in marked])
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        text_start = np.cumsum(text_size) - text_size
        begin = ends - lengths
        drawn = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
        live, at = np.arange(len(order)), lengths.copy()
        while len(live):
            place = begin[live] + at[live]
            here = (place - text_start[owner[live]]).astype(np.uint64)
            noise = mix(seeds[owner[live]] + here * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
            node = base[order[live]] + at[live] - 1
            # The few edges of a position one by one; the sum may round up to the next position, which is no edge of it
            mark = np.minimum(node + noise.astype(np.float64) / (1 << 53), np.nextafter(node + 1.0, 0.0))
            edge = opened[node]
            beyond = np.flatnonzero(bound[edge] <= mark)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[bound[edge[beyond]] <= mark[beyond]]
            drawn[place] = piece[edge] + (1 << 32)
            at[live] = start[edge]
            live = live[at[live] > 0]
        places = np.flatnonzero(drawn)
        ids = (drawn[places] - (1 << 32)).astype(np.int64)
        limits = np.searchsorted(places, text_start + text_size, side="right")
        parts = np.split(ids, limits[:-1])
        return [self.spelled(p) for p in parts]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Characters outside the vocabulary as byte pieces."""
        if not len(ids) or ids.min() >= 0:
            return ids.astype(np.int32)
        codes = -1 - ids[ids < 0]
        if codes.max() < 128:
            ids = ids.copy()
            ids[ids < 0] = np.array(self.bytes)[codes]
            return ids.astype(np.int32)
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                char = SPACE if chr(-1 - i) == _OWN_MARK else chr(-1 - i)
                out.extend(self.bytes[b] for b in char.encode("utf-8", "replace"))
        return np.array(out, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelling.__getitem__, ids.tolist())).decode("utf-8")[1:]


@lru_cache(maxsize=2)
def lattices(path: str, theta: float) -> Lattices:
    """One per worker and vocabulary."""
    return Lattices(path, theta)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("lossless", pa.bool_())])
_DIGESTED = pa.schema([
    ("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()),
    ("lossless", pa.bool_()),
])
_ENCODED_DDL = "doc_id long, ids array<int>, decoded string, lossless boolean"
_DIGESTED_DDL = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean"


def _encode(batches: Iterator[pa.RecordBatch], model: str, theta: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Keys and texts to keys, ids, decoded texts and whether these equal the texts."""
    tool = lattices(model, theta)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        keys = batch.column(0)
        seeds = mix(np.nan_to_num(keys.fill_null(-1).to_numpy()).astype(np.int64).view(np.uint64) + np.uint64(seed))
        size = np.cumsum([len(t) for t in texts]) // GROUP
        for g in np.unique(size):
            lo, hi = np.searchsorted(size, [g, g + 1])
            ids = tool.sample(texts[lo:hi], seeds[lo:hi])
            back = [tool.decode(i) for i in ids]
            offsets = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                keys.slice(lo, hi - lo),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())),
                pa.array(back, pa.string()),
                pa.array([a == b for a, b in zip(back, texts[lo:hi], strict=True)], pa.bool_()),
            ], schema=_ENCODED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded rows to their digests."""
    for b in batches:
        ids, n = b.column(1), b.num_rows
        crc = [zlib.crc32(ids[k].values.to_numpy().astype("<u4").tobytes()) for k in range(n)]
        text = [zlib.crc32((t or "").encode()) for t in b.column(2).to_pylist()]
        sizes = [len(ids[k]) for k in range(n)]
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(text, pa.int64()), b.column(3)
        ], schema=_DIGESTED)


def encode(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", theta: float = THETA, seed: int = 0
) -> DataFrame:
    """doc_id, ids, decoded text and whether it equals the text, of each row."""
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        lambda batches: _encode(batches, model, theta, seed), _ENCODED_DDL
    )


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, number and crc32 of the ids, crc32 of the decoded text, and whether it equals the text."""
    return encoded.mapInArrow(_digest, _DIGESTED_DDL)


def encode_digests(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", theta: float = THETA, seed: int = 0
) -> DataFrame:
    """The digests of what ``encode`` gives, taken in the task that encodes: ids and texts never leave it."""
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        lambda batches: _digest(_encode(batches, model, theta, seed)), _DIGESTED_DDL
    )
