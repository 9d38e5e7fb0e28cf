"""Trie of the shared prefixes of rebuilt conversations, from composable fingerprints.

A conversation is rebuilt as the first turns of its base conversation and its own
turns behind as many of its own. Rebuilt texts are never formed. The fingerprint
of a sequence of turns is an element of a monoid, (length, sum of turn hashes
times powers of a base), twice with independent hashes; the product of two
sequences' elements is the element of both in a row, and a prefix can be taken
off again. So the element of every rebuilt prefix comes from three elements: the
base's head, the own turns so far, and the own turns left out.

1. Turns become references: two hashes of role and text, and a number of words.
   A range sort spreads them; running products go through each partition and are
   carried on by one element per partition, so a long conversation is not a task.
2. Each conversation gets the elements of both heads, each of its rebuilt
   prefixes one row (conversation, depth, fingerprint, parent's fingerprint, reference).
3. Rows of one depth and fingerprint are a node. They must agree in the parent's
   fingerprint and in the reference, and turns with one reference in role and
   text; if any do not, all is done again with other hashes.
4. The smallest member owns a node; what a conversation owns is one stretch of
   its path, from some depth to its end. Sums over a subtree are therefore sums
   over a node's members of what each owns below, without walking the tree.
5. The hash of the ids that end at a node runs over blocks of sorted ids, joined
   to text by other tasks before; only the blocks of a node stream through one.

Defined cases: null role or text is empty; rows without conv_id take no part; a
null turn comes first; rows of one conversation with equal turn stand in the
order of a hash of role and text, and repeated rows are turns of their own; an
empty table gives an empty result, any other has a root; ``%`` of a negative id
is Spark's; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BLANKS, fixed, mix, shuffle_width, stored

#: Rows of one conversation that meet in a join, shares of a hot key, ids in a block of text.
BLOCK, SALTS, IDS = 4_096, 64, 4_096
#: Bases of both fingerprints, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
NODE = ["depth", "f1", "f2"]


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64, for exponents of 0 or more."""
    out = np.ones(len(exponents), dtype=np.uint64)
    square, left = np.uint64(base), exponents.astype(np.uint64)
    while left.any():
        out[(left & np.uint64(1)).astype(bool)] *= square
        left >>= np.uint64(1)
        with np.errstate(over="ignore"):
            square = square * square
    return out


def _u(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def _i(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def look_up(left: DataFrame, right: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Left join with a frame of unique keys; a hot key of the left side meets it in ``SALTS`` shares."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    shares = salted.select(*keys, "_salt").distinct().join(right, keys)
    return salted.join(shares, [*keys, "_salt"], "left").drop("_salt")


def references(conversations: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, role, text, both hashes and the number of words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(2 * seed), role, text).alias("d1"), F.xxhash64(F.lit(2 * seed + 1), role, text).alias("d2"),
        F.size(F.filter(F.split(text, BLANKS), lambda w: w != "")).cast("long").alias("words"),
    )


def clashes(turns: DataFrame) -> bool:
    """Whether turns with one reference differ in role or text."""
    contents = turns.select("d1", "d2", "role", "text").distinct().groupBy("d1", "d2").count()
    return bool(contents.where("count > 1").limit(1).count())


class Running:
    """Running products of the turns of a partition that is sorted by conversation."""

    def __init__(self, conv: int | None = None, n: int = 0, f: tuple[int, int] = (0, 0), words: int = 0):
        self.conv, self.n, self.f, self.words = conv, n, f, words

    def take(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Positions and running products of the next rows; the last row's are kept for what follows."""
        conv = batch.column("conv_id").to_numpy()
        new = np.ones(len(conv), dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = conv[0] != self.conv
        first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        going = first < 0  # rows of the conversation that came before
        first = np.maximum(first, 0)
        pos = np.arange(len(conv)) - first + 1 + going * self.n
        out = {"pos": pos}
        for k, base in enumerate(BASES, 1):
            terms = (mix(_u(batch, f"d{k}") ^ np.uint64(k)) | np.uint64(1)) * powers(base, pos - 1)
            total = np.cumsum(terms, dtype=np.uint64)
            out[f"f{k}"] = total - (total - terms)[first] + going * np.uint64(self.f[k - 1])
            out[f"p{k}"] = out[f"f{k}"] - terms
        words = batch.column("words").to_numpy()
        total = np.cumsum(words)
        out["upto"] = total - (total - words)[first] + going * self.words
        self.conv, self.n, self.words = int(conv[-1]), int(pos[-1]), int(out["upto"][-1])
        self.f = int(out["f1"][-1]), int(out["f2"][-1])
        return out


def running_products(turns: DataFrame) -> DataFrame:
    """Every turn with its place, the products up to it (f) and before it (p), and the words up to it."""
    order = ["conv_id", "turn", "d1", "d2"]
    placed = fixed(
        turns.select(*order, "words").repartitionByRange(shuffle_width(turns.sparkSession), *order)
        .sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part, conv = Running(), None, None
        for batch in batches:
            if batch.num_rows:
                conv = batch.column("conv_id")[0].as_py() if part is None else conv
                part = batch.column("part")[0].as_py()
                state.take(batch)
        if part is not None:
            row = [part, conv == state.conv, state.conv, state.n, *np.asarray(state.f, dtype=np.uint64).view(np.int64).tolist(), state.words]
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "one", "conv", "n", "f1", "f2", "words"), ([x] for x in row), strict=True)))

    # One row per partition: what a partition hands on of the conversation at its end.
    handed: dict[int, tuple] = {}
    last: tuple = (None, 0, (0, 0), 0)
    summary = placed.mapInArrow(ends, "part long, one boolean, conv long, n long, f1 long, f2 long, words long")
    for part, one, conv, n, f1, f2, words in sorted(map(tuple, summary.collect())):
        handed[part] = last
        own = (f1 % (1 << 64), f2 % (1 << 64))
        if one and conv == last[0]:
            own = tuple((a + pow(b, last[1], 1 << 64) * x) % (1 << 64) for a, b, x in zip(last[2], BASES, own, strict=True))
            n, words = n + last[1], words + last[3]
        last = (conv, n, own, words)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = state or Running(*handed[batch.column("part")[0].as_py()])
                out = state.take(batch)
                kept = {c: batch.column(c) for c in ("conv_id", "d1", "d2", "words")}
                yield pa.RecordBatch.from_pydict(kept | {c: _i(v) for c, v in out.items()})

    columns = ("conv_id", "d1", "d2", "words", "pos", "f1", "p1", "f2", "p2", "upto")
    return stored(placed.mapInArrow(go, ", ".join(f"{c} long" for c in columns)))


def heads(rows: DataFrame, block: int, most: int) -> DataFrame:
    """Per conversation: lengths of its parts, elements of both heads, words, and its base's first turns."""
    def first(name: str) -> Column:
        at = [F.max(F.when(F.col("pos") == k, F.col(name))) for k in range(1, most + 1)]
        return F.array(F.lit(0).cast("long"), *at).alias(name)

    names = ["f1", "p1", "f2", "p2", "d1", "d2", "words", "upto"]
    own = fixed(rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("upto").alias("total"), *map(first, names)))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[F.col(c).alias(f"b_{c}") for c in names])
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", asked.cast("int"))
    both = both.join(base, "base", "left").withColumn("hh", F.least("h", F.coalesce("base_n", F.lit(0)).cast("int")))
    skipped = F.least("h", F.col("n").cast("int"))
    at = lambda c, k: F.coalesce(F.get(c, k), F.lit(0)).alias
    wb, ws = F.coalesce(F.get("b_upto", "hh"), F.lit(0)), F.get("upto", skipped)
    return both.select(
        "conv_id", "n", "h", "hh", *[at(f, skipped)(f"s_{f}") for f in ("f1", "f2")], ws.alias("s_w"),
        *[at(f"b_{f}", F.col("hh"))(f"h_{f}") for f in ("f1", "f2")], wb.alias("h_w"),
        (F.col("hh") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), (wb + F.col("total") - ws).alias("all_words"),
        *[f"b_{c}" for c in names],
    )


def in_blocks(frame: DataFrame, length: str) -> DataFrame:
    """Each conversation's row once for each block of its rows."""
    return frame.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest({length} - 1, 0) div {BLOCK}"))))


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, fingerprint, parent's fingerprint, reference, words, words before, and the conversation's length."""
    columns = [*NODE, "p1", "p2", "d1", "d2", "words", "before"]
    depth = F.explode(F.sequence(F.lit(1), F.col("hh"))).alias("depth")
    head = convs.where("hh > 0").select("conv_id", "len", *[c for c in convs.columns if c.startswith("b_")], depth).select(
        "conv_id", "len", F.col("depth").cast("long"), *[F.get(f"b_{c}", "depth").alias(c) for c in columns[1:-1]],
        (F.get("b_upto", "depth") - F.get("b_words", "depth")).alias("before"),
    )
    near = in_blocks(convs.where("n > h").select("conv_id", "n", "len", "h", "hh", "s_f1", "s_f2", "s_w", "h_f1", "h_f2", "h_w"), "n")
    joined = rows.withColumn("block", F.expr(f"(pos - 1) div {BLOCK}")).join(near, ["conv_id", "block"]).where("pos > h")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, hh = b.column("h").to_numpy(), b.column("hh").to_numpy()
            out = {c: b.column(c) for c in ("conv_id", "len", "d1", "d2", "words")}
            out["depth"] = pa.array(b.column("pos").to_numpy() - h + hh)
            for k, inverse in enumerate(INVERSES, 1):
                shift = powers(inverse, h - hh)
                for to, of in ((f"f{k}", f"f{k}"), (f"p{k}", f"p{k}")):
                    out[to] = _i(_u(b, f"h_f{k}") + shift * (_u(b, of) - _u(b, f"s_f{k}")))
            upto = pc.subtract(b.column("upto"), b.column("words"))
            out["before"] = pc.add(pc.subtract(upto, b.column("s_w")), b.column("h_w"))
            yield pa.RecordBatch.from_pydict({c: out[c] for c in ("conv_id", "len", *columns)})

    body = joined.mapInArrow(compose, ", ".join(f"{c} long" for c in ("conv_id", "len", *columns)))
    return stored(head.unionByName(body))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined ids that end at each node."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in NODE])
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            starts = np.flatnonzero(new)
            starts = np.concatenate([np.arange(a, b, IDS) for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True)])
            ids = batch.column("conv_id").to_numpy()
            text = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
            yield pa.RecordBatch.from_pydict({c: pa.array(k[starts]) for c, k in zip(NODE, keys, strict=True)} | {"first": pa.array(ids[starts]), "ids": text})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != held:
                    if held is not None:
                        done.append((*held, running.hexdigest()))
                    held, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), zip(*done, strict=True), strict=True)))
        if held is not None:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip((*NODE, "ends_sha256"), (*held, running.hexdigest()), strict=True)})

    order = [*NODE, "conv_id"]
    kind = "depth long, f1 long, f2 long"
    texts = ends.select(*order).repartitionByRange(shuffle_width(ends.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(join, f"{kind}, first long, ids string")
    return texts.repartition(shuffle_width(ends.sparkSession), *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{kind}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 20, most: int = 3) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The base of conversation c is c - c % block; its head has crc32(c) % (most + 1) turns.
    """
    for seed in numbers():
        turns = references(conversations, seed)
        if clashes(turns):
            continue
        rows = running_products(turns)
        convs = fixed(heads(rows, block, most))
        members = prefixes(rows, convs)
        alike = [F.min(c) == F.max(c) for c in ("p1", "p2", "d1", "d2")]
        nodes = fixed(members.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.max("len").alias("longest"), F.min("before").alias("before"),
            (alike[0] & alike[1] & alike[2] & alike[3]).alias("verified"),
        ))
        if not nodes.where("not verified").limit(1).count():
            break
    owned = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.min("before").alias("shared"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf")
    )
    stretch = fixed(convs.select("conv_id", "len", "all_words").join(owned, "conv_id", "left").select(
        "conv_id", "len", F.coalesce("top", F.col("len") + 1).alias("top"), F.coalesce("shared", "all_words").alias("shared"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    ))
    below = members.withColumn("block", F.expr(f"(depth - 1) div {BLOCK}")).join(
        in_blocks(stretch.where("len > 0"), "len").drop("len"), ["conv_id", "block"]
    )
    sums = [
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.sum(((F.col("len") > F.col("depth")) & (F.col("top") <= F.col("depth") + 1)).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    ]
    inner = below.groupBy(*NODE).agg(*sums, F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max(F.col("top") == F.col("depth")).alias("on_top"))
    none = F.lit(0).cast("long")
    root = (
        stretch.withColumn("depth", none).withColumn("before", none).groupBy("depth").agg(*sums)
        .withColumn("n_leaves", F.greatest("n_leaves", F.lit(1)))
        .select("depth", none.alias("f1"), none.alias("f2"), "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    )
    inner, root = fixed(inner), fixed(root)
    # A node below its owner's stretch hangs on the owner; the first of a stretch on another's.
    places = inner.select(*NODE, "conv_id").unionByName(root.select(*NODE, "conv_id"))
    parents = places.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tops = look_up(inner.where("on_top"), parents, ["depth", "p1", "p2"], F.col("conv_id"))
    rest = inner.where("not on_top").withColumn("parent_conv_id", F.col("conv_id"))
    columns = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = tops.select(*columns).unionByName(rest.select(*columns)).unionByName(
        root.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    )
    ends = members.where("depth = len").select(*NODE, "conv_id").unionByName(
        stretch.where("len = 0").select(none.alias("depth"), none.alias("f1"), none.alias("f2"), "conv_id")
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(ends_hashes(ends), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


PREFIX_TRIE_SQL = """
WITH c AS (
    SELECT DISTINCT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda a, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)), 4294967295), 4294967295) % 4 AS h
    FROM conversations WHERE conv_id IS NOT NULL),
t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
r AS (
    SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
q AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, dense_rank() OVER (ORDER BY role, text) AS ref,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM r),
s AS (SELECT conv_id, d, list(ref) OVER (PARTITION BY conv_id ORDER BY d) AS path, words FROM q
      UNION ALL SELECT conv_id, 0, CAST([] AS BIGINT[]), 0 FROM c),
l AS (SELECT conv_id, max(d) AS n FROM s GROUP BY conv_id),
nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, max(n) = d AS leaf,
           sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM s JOIN l USING (conv_id) GROUP BY path, d),
up AS (SELECT unnest(range(d + 1)) AS lvl, path, d, n_convs, words, leaf FROM nodes),
sums AS (
    SELECT list_slice(path, 1, lvl) AS path, CAST(count(*) FILTER (WHERE d = lvl + 1) AS BIGINT) AS n_children,
           CAST(count(*) FILTER (WHERE leaf) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
    FROM up GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN nodes p ON n.d > 0 AND p.path = list_slice(n.path, 1, n.d - 1)
"""
