"""Katz backoff language model over words, with Good-Turing discounts.

A text's tokens are its words and one end. With c the training counts,

    p(w | h) = d2(c(h, w)) * c(h, w) / c(h)        for pairs in the model,
               alpha(h) * p(w)                     for all others,
    p(w)     = d1(c(w)) * c(w) / N                 for known words,
    p(other) = 1 - sum of p(w)                     for all unknown words together,

where d1 and d2 are Good-Turing discounts for counts up to ``DISCOUNTED``, and
alpha(h) makes the probabilities after h sum to exactly one. The first word's
history is a start mark. All pairs are in the model, those seen once too.

Words are 64-bit hashes. Texts are stored once as groups of tokens, each with
the words it holds. Two shuffles count: a group sends its distinct words by word,
then its distinct pairs by history, with its own counts; the bucket that has all
groups' parts of a key adds them up and answers each group in the order in which
it asked. The answer on a history has what alpha(h) needs. The group then scores
its own texts. So no table of pairs is written, joined or shuffled again, and what
goes over the disk grows with the distinct pairs of groups.

A history with at least a ``WIDE``-th part of all tokens is spread over
``SPREAD`` parts by word. There are at most ``WIDE`` of them; their sums go to the
groups by way of the driver.

Defined cases: null or empty texts are one end token; a row without key is
scored but not learned from; repeated rows count as often as they stand there and
score alike; with nothing to learn from (as in an empty table) all tokens are
unknown and have probability one in the model; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import mix, shuffle_width, stored, text_groups, word_hashes
from factloom.llm.minhash import runs

#: Highest count that is discounted; least count of a pair in the model: all pairs are in it, none is filtered.
DISCOUNTED, LEAST_PAIR = 5, 1
#: Tokens of a group; tokens a bucket; part of all tokens from which a history is spread, and over how many parts.
GATHER, BUCKET, WIDE, SPREAD = 2_000_000, 4_000_000, 2048, 32
END, START = (mix(np.array([x], dtype=np.uint64))[0] for x in (5001, 5002))
_PAIR = mix(np.array([5003], dtype=np.uint64))[0] | np.uint64(1)
#: A text of a group: key and its presence, held out, learned from, tokens.
_FACTS = np.dtype([("doc", "<i8"), ("keyed", "?"), ("held", "?"), ("train", "?"), ("n", "<u4")])
#: Of a history: its pairs of each discounted count, its words of each, tokens of its other words.
_SUMS = 2 * DISCOUNTED + 1
#: Rows between steps: group, kind, bucket, and arrays of that kind.
_GROUP, _WORDS, _PAIRS, _TOTALS = range(4)
_ROW = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("b", pa.int32()), *((x, pa.binary()) for x in "xyzuvw")])
_ROWS = "g long, kind int, b int, x binary, y binary, z binary, u binary, v binary, w binary"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories, tokens and number of tokens of each text."""
    words, counts = word_hashes(texts)
    sizes = counts + 1
    last = np.cumsum(sizes) - 1
    token = np.empty(int(sizes.sum()), dtype=np.uint64)
    inner = np.ones(len(token), dtype=bool)
    inner[last] = False
    token[inner], token[last] = words, END
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[last - counts] = START
    return history, token, sizes


def pair_keys(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(history * _PAIR) ^ token)


def discounts(counts_of_counts: dict[int, int], k: int = DISCOUNTED) -> list[float]:
    """Good-Turing discount factor of each count from 0 to k; 1 where the formula leaves (0, 1]."""
    n = lambda r: counts_of_counts.get(r, 0)
    factors = [1.0] * (k + 1)
    common = (k + 1) * n(k + 1) / n(1) if n(1) else 1.0
    for r in range(1, k + 1):
        if n(r) and common < 1:
            d = ((r + 1) * n(r + 1) / (r * n(r)) - common) / (1 - common)
            if 0 < d <= 1:
                factors[r] = d
    return factors


def _discounted(c: np.ndarray, factors: list[float]) -> np.ndarray:
    return c * np.append(factors, 1.0)[np.minimum(c, len(factors))]


@dataclass(frozen=True)
class Totals:
    """Numbers of the training tokens: all and distinct; discounts of words; mass of unknown words."""

    tokens: int
    distinct: int
    discounts: list[float]
    unknown: float

    @classmethod
    def of(cls, tokens: int, distinct: int, counts_of_counts: dict[int, int]) -> Totals:
        factors = discounts(counts_of_counts)
        taken = sum((1 - factors[r]) * r * counts_of_counts.get(r, 0) for r in range(1, len(factors)))
        if not tokens:
            return cls(tokens, distinct, factors, 1.0)
        # If no word was discounted: take half a count for the unknown.
        return cls(tokens, distinct, factors, (taken or 0.5) / tokens)

    @property
    def wide(self) -> int:
        """Least count of a history that is spread."""
        return max(1, -(-self.tokens // WIDE))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def word(self, c: np.ndarray) -> np.ndarray:
        """p of words with count c; of all unknown words for 0."""
        return np.where(c > 0, _discounted(c, self.discounts) / max(self.tokens, 1), self.unknown)

    def backoff(self, c: np.ndarray, sums: np.ndarray, factors: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """alpha(h) and the number that counts of pairs are shares of, for histories with count c and their sums."""
        one, two, others = sums[:DISCOUNTED], sums[DISCOUNTED:-1], sums[-1]
        weights = np.arange(1, DISCOUNTED + 1)
        # Each of a history's tokens is in one pair.
        taken = (weights * (1 - np.array(factors[1:]))) @ one
        # Where no pair of a history is discounted, one count more leaves mass for the others.
        total = c + (taken < 1e-9)
        lower = (others + (weights * np.array(self.discounts[1:])) @ two) / max(self.tokens, 1)
        # A history that all known words follow leaves its mass to the unknown ones.
        alpha = (1 - (c - taken) / np.maximum(total, 1)) / np.maximum(1 - lower, self.unknown)
        return np.where(c > 0, alpha, 1.0), np.maximum(total, 1)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by place of their bytes, so that those of small ones take little room."""
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes(), 1)


def _unpacked(data: pa.Scalar, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(data.as_buffer()), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """Hashes that ascend over long stretches, by their differences modulo 2**64."""
    return _packed(np.diff(hashes, prepend=np.uint64(0)))


def _hashes(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _row(g: int, kind: int, b: int, *arrays: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip([g, kind, b, *arrays, *[None] * (6 - len(arrays))], _ROW.types, strict=True)], schema=_ROW
    )


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges of equal values in a sorted array: value, first, end."""
    at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(bucket[a]), a, b


def token_groups(docs: DataFrame, gather: int) -> DataFrame:
    """Rows (any number that grows, key, held out, learned from, text) as groups of about ``gather`` tokens.

    A group has its distinct words, frequent ones first, the start mark last, and
    each token as a position among them; in the place of a bucket is the number of tokens.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        first, size = 0, 0

        def group() -> pa.RecordBatch:
            facts = np.concatenate([f for f, _ in held])
            words, code = np.unique(np.concatenate([t for _, t in held]), return_inverse=True)
            held.clear()
            order = np.argsort(-np.bincount(code), kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            words, code = np.append(words[order], START), place[code]
            learned = code[np.repeat(facts["train"], facts["n"])]
            counts = np.bincount(learned, minlength=len(words))
            counts[-1] = facts["train"].sum()
            return _row(first, _GROUP, len(code), zlib.compress(facts.tobytes(), 1), _packed_hashes(words), _packed(counts.astype("<u4")), _packed(code.astype("<u4")))

        for batch in batches:
            for start, texts in text_groups(batch.column(4).to_pylist()):
                _, token, sizes = tokens(texts)
                facts = np.zeros(len(texts), dtype=_FACTS)
                keys, out, learn = (batch.column(k).slice(start, len(texts)) for k in (1, 2, 3))
                facts["doc"], facts["keyed"] = keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
                facts["held"], facts["train"] = (x.to_numpy(zero_copy_only=False) for x in (out, learn))
                facts["n"] = sizes
                if not held:
                    first, size = batch.column(0)[start].as_py(), 0
                held.append((facts, token))
                size += len(token)
                if size >= gather:
                    yield group()
        if held:
            yield group()

    return docs.mapInArrow(gathered, _ROWS)


def word_answers(groups: DataFrame, buckets: int) -> DataFrame:
    """The training counts of each group's words, by bucket; the totals of each bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts = _hashes(batch.column("y")[k]), _unpacked(batch.column("z")[k], "<u4")
                order, bucket = _word_order(words, buckets)
                for b, i, j in _cuts(bucket):
                    yield _row(batch.column("g")[k].as_py(), _WORDS, b, _packed_hashes(words[order[i:j]]), _packed(counts[order[i:j]]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b,), found in runs((x.select(["b", "g", "x", "y"]) for x in batches), 1):
            asked = [(x.column(1)[k].as_py(), _hashes(x.column(2)[k]), _unpacked(x.column(3)[k], "<u4")) for x in found for k in range(x.num_rows)]
            words, place = np.unique(np.concatenate([w for _, w, _ in asked]), return_inverse=True)
            c = np.bincount(place, weights=np.concatenate([n for _, _, n in asked])).astype("<i8")
            at = 0
            for g, own, _ in asked:
                yield _row(g, _WORDS, int(b), _packed(c[place[at : at + len(own)]]))
                at += len(own)
            c = c[(words != START) & (c > 0)]
            few = np.bincount(c[c <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
            yield _row(-1, _TOTALS, int(b), np.append([c.sum(), len(c)], few[1:]).astype("<i8").tobytes())

    return groups.select("g", "y", "z").mapInArrow(ask, _ROWS).repartitionById(buckets, "b").sortWithinPartitions("b", "g").mapInArrow(count, _ROWS)


def _word_order(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by bucket, and their buckets in it."""
    bucket = (words % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


class _Group:
    """A group with the counts of its words: its distinct pairs and what it asks about them.

    Asked is for pairs of two known words, ``pairs`` and in ``order`` by bucket, and
    for known histories: ``runs`` are bucket, history and number of asked pairs.
    """

    def __init__(self, row: tuple[pa.RecordBatch, int], answers: list[tuple[pa.RecordBatch, int]], totals: Totals, buckets: int):
        batch, k = row
        self.facts = np.frombuffer(zlib.decompress(batch.column("x")[k].as_buffer()), _FACTS)
        self.words, self.code = _hashes(batch.column("y")[k]), _unpacked(batch.column("u")[k], "<u4")
        self.c = np.zeros(len(self.words), dtype=np.int64)
        self.c[_word_order(self.words, buckets)[0]] = np.concatenate([_unpacked(a.column("x")[i], "<i8") for a, i in answers])
        size = len(self.words)
        both = np.empty(len(self.code), dtype=np.int64)
        both[1:] = self.code[:-1]
        both[np.cumsum(self.facts["n"]) - self.facts["n"]] = size - 1
        both *= size
        both += self.code
        pairs, pair = np.unique(both, return_inverse=True)
        self.pair = pair.astype("<u4")
        del both, pair
        self.h, self.w = np.divmod(pairs, size)
        self.wide = self.c >= totals.wide
        known = self.c[self.w] > 0
        asked = np.flatnonzero((self.c[self.h] > 0) & (known | ~self.wide[self.h]))
        h, w = self.h[asked], self.words[self.w[asked]]
        part = np.where(self.wide[h], (w & np.uint64(SPREAD - 1)) + np.uint64(1), np.uint64(0))
        bucket = (mix(self.words[h] + part * _PAIR) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        asked, h, bucket, known = asked[order], h[order], bucket[order], known[asked[order]]
        new = np.flatnonzero((np.diff(h, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
        self.runs = bucket[new], h[new], np.add.reduceat(known, new, dtype=np.int64) if len(new) else new
        self.pairs = asked[known]

    def learned(self) -> np.ndarray:
        return np.bincount(self.pair[np.repeat(self.facts["train"], self.facts["n"])], minlength=len(self.h))


def _by_group(batches: Iterator[pa.RecordBatch], totals: Totals, buckets: int) -> Iterator[tuple[int, _Group, list[tuple[pa.RecordBatch, int]]]]:
    """Each group with the answers on its pairs, from rows sorted by group, kind and bucket."""
    for (g,), found in runs(batches, 1):
        kinds: list[list[tuple[pa.RecordBatch, int]]] = [[], [], []]
        for batch in found:
            for k in range(batch.num_rows):
                kinds[batch.column("kind")[k].as_py()].append((batch, k))
        yield int(g), _Group(kinds[_GROUP][0], kinds[_WORDS], totals, buckets), kinds[_PAIRS]


def _together(rows: DataFrame, buckets: int) -> DataFrame:
    # More parts than groups, so that few have two or more: Arrow sends a part's rows at once.
    return rows.repartition(4 * buckets, "g").sortWithinPartitions("g", "kind", "b")


def pair_answers(groups: DataFrame, answers: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """The training counts of each group's pairs and the sums of its histories, by bucket; the totals of each bucket."""

    def of_group(g: int, group: _Group) -> list[pa.RecordBatch]:
        bucket, h, sizes = group.runs
        ends = np.append(0, np.cumsum(sizes))
        word, learned = group.w[group.pairs], group.learned()[group.pairs].astype("<u4")
        out = []
        for b, i, j in _cuts(bucket):
            own = slice(ends[i], ends[j])
            words, place = np.unique(word[own], return_inverse=True)
            out.append(_row(
                g, _PAIRS, b, _packed_hashes(group.words[h[i:j]]), _packed((2 * sizes[i:j] + group.wide[h[i:j]]).astype("<u4")),
                _packed_hashes(group.words[words]), _packed(group.c[words]), _packed(place.astype("<u4")), _packed(learned[own]),
            ))
        return out

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, group, _ in _by_group(batches, totals, buckets):
            out = of_group(g, group)
            del group  # before the next group is made
            yield from out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b,), found in runs((x.select(["b", "g", *"xyzuvw"]) for x in batches), 1):
            rows = [(x, k) for x in found for k in range(x.num_rows)]
            of = lambda name, read, *kind: [read(x.column(name)[k], *kind) for x, k in rows]
            h, sizes, own = of("x", _hashes), of("y", _unpacked, "<u4"), of("v", _unpacked, "<u4")
            wide = [x % 2 > 0 for x in sizes]
            w, cw = (np.concatenate([x[at] for x, at in zip(xs, own, strict=True)]) for xs in (of("z", _hashes), of("u", _unpacked, "<i8")))
            histories, place = np.unique(np.concatenate(h), return_inverse=True)
            owner = np.repeat(place, np.concatenate(sizes) // 2)
            _, first, pair = np.unique(pair_keys(histories[owner], w), return_index=True, return_inverse=True)
            c = np.bincount(pair, weights=np.concatenate(of("w", _unpacked, "<u4")), minlength=len(first)).astype("<u4")
            learned = first[c > 0]
            sums = np.zeros((_SUMS, len(histories)), dtype=np.int64)
            for k, counts in ((0, c[c > 0]), (DISCOUNTED, cw[learned])):
                for r in range(DISCOUNTED):
                    sums[k + r] = np.bincount(owner[learned[counts == r + 1]], minlength=len(histories))
            sums[-1] = np.bincount(owner[learned], weights=np.where(cw[learned] > DISCOUNTED, cw[learned], 0), minlength=len(histories))
            at = over = 0
            for (x, k), spread, words in zip(rows, wide, own, strict=True):
                kept = sums[:, place[at : at + len(spread)][~spread]]
                yield _row(
                    x.column("g")[k].as_py(), _PAIRS, int(b), _packed(c[pair[over : over + len(words)]]),
                    _packed(kept[:-1].ravel().astype("<u4")), _packed(kept[-1]),
                )
                at, over = at + len(spread), over + len(words)
            spread = np.unique(place[np.concatenate(wide)])
            few = np.bincount(c[c <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)
            yield _row(-1, _TOTALS, int(b), few.astype("<i8").tobytes(), histories[spread].tobytes(), sums[:, spread].astype("<i8").tobytes())

    asked = _together(groups.union(answers), buckets).mapInArrow(ask, _ROWS)
    return asked.repartitionById(buckets, "b").sortWithinPartitions("b", "g").mapInArrow(count, _ROWS)


def text_scores(rows: DataFrame, totals: Totals, factors: list[float], wide: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """The scores of every text from the groups and all answers."""
    spread, spread_sums = wide

    def of_group(group: _Group, found: list[tuple[pa.RecordBatch, int]]) -> pa.RecordBatch:
        c = np.zeros(len(group.h), dtype=np.int64)
        sums = np.zeros((_SUMS, len(group.words)), dtype=np.int64)
        if found:
            c[group.pairs] = np.concatenate([_unpacked(a.column("x")[k], "<u4") for a, k in found])
            h = group.runs[1]
            h = h[~group.wide[h]]
            sums[:-1, h] = np.concatenate([_unpacked(a.column("y")[k], "<u4").reshape(_SUMS - 1, -1) for a, k in found], axis=1)
            sums[-1, h] = np.concatenate([_unpacked(a.column("z")[k], "<i8") for a, k in found])
        h = np.flatnonzero(group.wide)
        at = np.searchsorted(spread, group.words[h])
        hit = np.flatnonzero(at < len(spread))
        hit = hit[spread[at[hit]] == group.words[h[hit]]]
        sums[:, h[hit]] = spread_sums[:, at[hit]]
        alpha, total = totals.backoff(group.c, sums, factors)
        own = _discounted(c, factors) / total[group.h]
        p = np.log10(np.where(c > 0, own, alpha[group.h] * totals.word(group.c)[group.w]))
        n = len(group.facts)
        doc = np.repeat(np.arange(n), group.facts["n"])
        texts = lambda x, at: np.bincount(doc, weights=x[at], minlength=n)
        return pa.RecordBatch.from_arrays([
            pa.array(group.facts["doc"], mask=~group.facts["keyed"]), pa.array(group.facts["held"]),
            pa.array(group.facts["n"].astype(np.int64)),
            pa.array(texts(group.c > 0, group.code).astype(np.int64)), pa.array(texts(totals.base(group.c), group.code)),
            pa.array(texts(p, group.pair)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, found in _by_group(batches, totals, buckets):
            out = of_group(group, found)
            del group, found  # before the next group is made
            yield out

    return _together(rows, buckets).mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def pair_counts(train: DataFrame, buckets: int) -> DataFrame:
    """(h, w, c) of all pairs of a frame of texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_groups(batch.column(0).to_pylist()):
                h, w, _ = tokens(texts)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "w": w.view(np.int64)})

    return train.mapInArrow(send, "h long, w long").repartition(buckets, "h", "w").groupBy("h", "w").agg(F.count(F.lit(1)).alias("c"))


def score(docs: DataFrame, held_out: Column, train: Column, key: str = "doc_id", text: str = "text", gather: int = GATHER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``train`` is the condition on a row to learn from; ``held_out`` is only returned.
    """
    spark = docs.sparkSession
    no = F.lit(False)
    groups = stored(token_groups(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long"),
        F.coalesce(held_out, no), F.coalesce(train, no), F.col(text),
    ), gather), clean=True)
    buckets = max(shuffle_width(spark), -(-(groups.agg(F.sum("b")).first()[0] or 0) // BUCKET))
    # Counts of words.
    words = stored(word_answers(groups, buckets), clean=True)
    found = sum((np.frombuffer(r["x"], "<i8") for r in words.where(F.col("kind") == _TOTALS).select("x").collect()), np.zeros(DISCOUNTED + 3, np.int64))
    n, v = int(found[0]), int(found[1])
    totals = Totals.of(n, v, {r: int(found[r + 1]) for r in range(1, DISCOUNTED + 2)})
    words = words.where(F.col("kind") == _WORDS)
    # Counts of pairs and sums of histories.
    pairs = stored(pair_answers(groups, words, totals, buckets), clean=True)
    few, sums = np.zeros(DISCOUNTED + 2, np.int64), {}
    for r in pairs.where(F.col("kind") == _TOTALS).select("x", "y", "z").collect():
        few += np.frombuffer(r["x"], "<i8")
        spread = np.frombuffer(r["y"], "<u8")
        for h, s in zip(spread.tolist(), np.frombuffer(r["z"], "<i8").reshape(_SUMS, len(spread)).T, strict=True):
            sums[h] = sums[h] + s if h in sums else s
    factors = discounts({r: int(few[r]) for r in range(1, DISCOUNTED + 2)})
    keys = sorted(sums)
    wide = np.array(keys, dtype=np.uint64), np.array([sums[h] for h in keys], dtype=np.int64).reshape(len(keys), _SUMS).T
    rows = groups.union(words).union(pairs.where(F.col("kind") == _PAIRS))
    return text_scores(rows, totals, factors, wide, buckets).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
