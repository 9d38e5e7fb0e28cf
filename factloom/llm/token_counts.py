"""Token counts by compiled finite-state transducers; no text is tokenized.

A byte-level BPE tokenizer is compiled, from its file, into two deterministic
transducers whose transitions carry counts:

- ``Cutter`` reads characters by class and says at each step how many pieces
  begin (the pre-tokenizer's expression with its look-ahead, as 13 states). A
  batch of texts is one array cut into chunks of equal length. Each chunk's map
  from every start state to its end state is formed for all chunks at once, the
  maps are composed by a parallel prefix scan, and with the start states known a
  second run marks where pieces begin.
- ``PairCounter`` reads the bytes of a piece; a transition carries by how much the
  number of tokens changes. Its states are found when met: a state holds the
  places from which a token may still reach further, each with its node in the
  tree of tokens, the last token before it and its count relative to now. From
  each place a step looks for the one token that ends here and is stable behind
  the token before it; two tokens are stable when no merge joins their edges
  during the life of both. In a vocabulary whose merges come after those that
  make their parts, a sequence of tokens is the tokenizer's exactly if all its
  neighbours are stable, so the counts are the tokenizer's.

Counts of pieces met before are kept. Both tables are bounded in entries and
start anew when full, so memory does not grow with the data.

Special strings of the tokenizer's file are one token each and cut the text, as
in the library by default. Classes of characters are read off from the
pre-tokenizer itself, once on the driver, and sent as a table of ranges.

Defined cases: null counts as an empty text, with 0 bytes and 0 tokens; rows are
judged one by one, so repeated rows, ties and a null ``doc_id`` stay as they
are; an empty table gives an empty result; a very long text is cut where every
state agrees on a new piece; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

#: Characters read at a time, characters of a chunk, entries of each table.
WINDOW, CHUNK, ENTRIES = 1 << 20, 256, 400_000

# Classes of characters. The letters that can follow an apostrophe stand alone.
SPACE, BLANK, DIGIT, OTHER, QUOTE, S, R, V, L, E, LETTER, END = range(12)
LETTERS = (S, R, V, L, E, LETTER)
# States: at an end, inside letters, digits or others, behind an apostrophe that
# begins a piece (and r, v or l behind it), behind a contraction, and behind a
# run of blanks: its last is a space or not, and it is the only one or not.
START, IN_LETTERS, IN_DIGITS, IN_OTHERS, AT_QUOTE, AT_R, AT_V, AT_L, CONTRACTED, SPACE_1, SPACE_2, BLANK_1, BLANK_2 = range(13)
STATES = 13
#: Marks on a transition: a piece begins at this character, at the one before.
HERE, BEFORE = 1, 2


def cutter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by state * 16 + class."""
    after = np.zeros(STATES * 16, dtype=np.uint8)
    marks = np.zeros(STATES * 16, dtype=np.uint8)

    def rule(state: int, cls: int, to: int, mark: int = 0) -> None:
        after[state * 16 + cls], marks[state * 16 + cls] = to, mark

    fresh = {DIGIT: IN_DIGITS, OTHER: IN_OTHERS, QUOTE: AT_QUOTE, SPACE: SPACE_1, BLANK: BLANK_1} | dict.fromkeys(LETTERS, IN_LETTERS)
    joined = fresh | {QUOTE: IN_OTHERS}
    for state in range(STATES):
        for cls, to in fresh.items():
            rule(state, cls, to, HERE)
        rule(state, END, START)
    for cls in LETTERS:
        rule(IN_LETTERS, cls, IN_LETTERS)
    rule(IN_DIGITS, DIGIT, IN_DIGITS)
    for state in (IN_OTHERS, AT_QUOTE):
        rule(state, OTHER, IN_OTHERS)
        rule(state, QUOTE, IN_OTHERS)
    rule(AT_QUOTE, S, CONTRACTED)
    for first, state in ((R, AT_R), (V, AT_V), (L, AT_L)):
        rule(AT_QUOTE, first, state)
    # An r, v or l that no contraction takes is the first letter of a word.
    for state, second in ((AT_R, E), (AT_V, E), (AT_L, L)):
        for cls, to in fresh.items():
            rule(state, cls, to, BEFORE | (0 if cls in LETTERS else HERE))
        rule(state, second, CONTRACTED)
        rule(state, END, START, BEFORE)
    # Blanks go together, but the last before something else stands apart; a space joins what follows.
    for state in (SPACE_1, SPACE_2, BLANK_1, BLANK_2):
        rule(state, SPACE, SPACE_2)
        rule(state, BLANK, BLANK_2)
    for cls, to in joined.items():
        if cls not in (SPACE, BLANK):
            rule(SPACE_1, cls, to)
            rule(SPACE_2, cls, to, BEFORE)
            rule(BLANK_1, cls, fresh[cls], HERE)
            rule(BLANK_2, cls, fresh[cls], BEFORE | HERE)
    return after, marks


def class_ranges() -> tuple[list[int], list[int]]:
    """First code point and class of each run of code points of one class, as the pre-tokenizer cuts them.

    Categories of Python's Unicode tables are tried first, a run of code points
    at a time; a run that the pre-tokenizer cuts is asked again sign by sign: a
    letter stays in one piece with letters around it, and likewise a digit; of
    two equal blanks between other signs each stands alone; all else is OTHER.
    """
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    points = np.asarray([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    guess = np.asarray([{"L": LETTER, "N": DIGIT}.get(category(chr(c))[0], OTHER) for c in points.tolist()], dtype=np.uint8)
    found = np.full(0x110000, OTHER, dtype=np.uint8)
    for run in np.split(points, np.flatnonzero(np.diff(guess)) + 1):
        cls = guess[np.searchsorted(points, run[0])]
        sign = {LETTER: "z", DIGIT: "1", OTHER: "!"}[int(cls)]
        if len(cut.pre_tokenize_str(sign + "".join(map(chr, run.tolist())) + sign)) == 1:
            found[run] = cls
            continue
        for cls, frame, at, size in ((LETTER, "z{}z\n", 0, 3), (DIGIT, "1{}1\n", 0, 3), (BLANK, "!{0}{0}!\n", 1, 1)):
            width = len(frame.format("x"))
            pieces = cut.pre_tokenize_str("".join(frame.format(chr(c)) for c in run.tolist()))
            first, last = np.asarray([place for _, place in pieces]).T
            found[run[first[(first % width == at) & (last - first == size)] // width]] = cls
    found[ord(" ")], found[ord("'")] = SPACE, QUOTE
    for cls, signs in ((S, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
        found[[ord(x) for x in signs]] = cls
    first = np.flatnonzero(np.diff(found, prepend=255))
    return first.tolist(), found[first].tolist()


class Cutter:
    """Where the pieces of texts begin."""

    def __init__(self, firsts: list[int], classes: list[int]):
        self.classes = np.repeat(np.asarray(classes, dtype=np.uint8), np.diff(np.append(firsts, 0x110000)))
        self.after, self.marks = cutter_tables()

    def maps(self, chunks: np.ndarray) -> np.ndarray:
        """End state of each chunk (column) for each start state (row)."""
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks.shape[1], axis=1)
        for k in range(len(chunks)):
            maps = self.after[(maps.astype(np.uint16) << 4) + chunks[k]]
            if k % 16 == 15 and len(maps) > 1 and (maps == maps[0]).all():
                maps = maps[:1]  # all start states have met
        return np.broadcast_to(maps, (STATES, chunks.shape[1])).copy()

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Places where a piece begins, in texts that stand one behind another, each closed by a code of class END."""
        n = len(codes)
        width = -(-n // CHUNK)
        chunks = np.full(width * CHUNK, END, dtype=np.uint8)
        chunks[:n] = codes
        chunks = np.ascontiguousarray(chunks.reshape(width, CHUNK).T)
        maps = self.maps(chunks)
        # Parallel prefix scan: map j then leads from the very start through chunk j.
        step = 1
        while step < width:
            maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
            step *= 2
        state = np.append(np.uint8(START), maps[START, :-1])
        marks = np.empty(chunks.shape, dtype=np.uint8)
        for k in range(CHUNK):
            at = (state.astype(np.uint16) << 4) + chunks[k]
            marks[k] = self.marks[at]
            state = self.after[at]
        flat = marks.T.reshape(-1)[:n]
        begins = (flat & HERE).astype(bool)
        begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return np.flatnonzero(begins)


class PairCounter:
    """Number of BPE tokens of a piece, by a transducer over its bytes."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int, int] | None] = [None] * 256
        self.known: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        dead = set()
        for rank, (a, b) in enumerate(merges):
            x, y = ids[a], ids[b]
            self.rank[x, y] = rank
            if a + b in ids:
                continue  # another way to a token that exists; the earlier one makes it
            ids[a + b] = len(self.parts)
            self.parts.append((x, y, rank))
            # A token that its own merges never reach is never given.
            if x in dead or y in dead or self._joined(x, y, rank):
                dead.add(ids[a + b])
        self.children: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for text, token in ids.items():
            if token in dead:
                continue
            node = 0
            for b in text:
                self.inner[node] = True
                to = self.children.get(node << 8 | b)
                if to is None:
                    to = self.children[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = token
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.pieces: dict[str, int] = {}

    def _edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """Tokens that stand at one edge while the token is made, with the rank of the merge that takes each."""
        known = self.edges[side].get(token)
        if known is None:
            made = self.parts[token]
            inner = () if made is None else ((made[side], made[2]), *self._edge(made[side], side)[1:])
            known = self.edges[side][token] = ((token, 1 << 60), *inner)
        return known

    def _joined(self, first: int, second: int, before: int = 1 << 59) -> bool:
        """Whether a merge of lower rank than ``before`` joins the touching edges of two tokens.

        Equal merges go from left to right: one inside the first token comes
        before the same one across the edge, one inside the second after it.
        """
        left = self._edge(second, 0)
        for x, x_ends in self._edge(first, 1):
            for y, y_ends in left:
                rank = self.rank.get((x, y))
                if rank is not None and rank < before and rank < x_ends and rank <= y_ends:
                    return True
        return False

    def stable(self, first: int, second: int) -> bool:
        if first < 0:
            return True
        key = (first, second)
        out = self.known.get(key)
        if out is None:
            if len(self.known) > ENTRIES:
                self.known.clear()
            out = self.known[key] = not self._joined(first, second)
        return out

    def _step(self, state: int, b: int) -> tuple[int, int]:
        """The state behind a byte, and the change of the count."""
        reach, last, change = [], -1, 0
        for node, before, count in self.states[state]:
            to = self.children.get(node << 8 | b)
            if to is None:
                continue
            token = self.token[to]
            if token >= 0 and last < 0 and self.stable(before, token):
                last, change = token, count + 1
            if self.inner[to]:
                reach.append((to, before, count))
        found = tuple([(node, before, count - change) for node, before, count in reach] + [(0, last, 0)])
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.states)
            self.states.append(found)
        self.steps[state << 8 | b] = number, change
        return number, change

    def count(self, piece: str) -> int:
        known = self.pieces.get(piece)
        if known is not None:
            return known
        state, total, steps = 0, 0, self.steps
        for b in piece.encode("utf-8", "replace"):
            step = steps.get(state << 8 | b)
            if step is None:
                if len(steps) > ENTRIES:
                    keep = self.states[state]
                    self._clear()
                    steps = self.steps
                    state = self.numbers.setdefault(keep, len(self.states))
                    if state == len(self.states):
                        self.states.append(keep)
                step = self._step(state, b)
            state, change = step
            total += change
        if len(piece) <= 64:
            if len(self.pieces) > ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = total
        return total


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in files of byte-level tokenizers."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def compiled(path: str) -> dict:
    """What workers need of a tokenizer's file: merges in bytes, special strings, classes of characters."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, cut = data["model"], data["pre_tokenizer"]
    plain = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk")
    if (
        model["type"] != "BPE" or any(model.get(x) for x in plain) or data["normalizer"] is not None
        or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]
        or any(t[x] for t in data["added_tokens"] for x in ("single_word", "lstrip", "rstrip"))
    ):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    signs = byte_signs()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    raw = [tuple(bytes(signs[c] for c in part) for part in m) for m in merges]
    special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
    return {"merges": raw, "special": special, "classes": class_ranges()}


class Counter:
    """Token counts of texts; one per worker and tokenizer."""

    def __init__(self, plan: dict):
        self.cutter = Cutter(*plan["classes"])
        self.pairs = PairCounter(plan["merges"])
        self.special = re.compile("|".join(map(re.escape, plan["special"]))) if plan["special"] else None

    def windows(self, texts: list[str | None]) -> Iterator[tuple[int, str]]:
        """(text, part): parts without special strings, cut before a space between visible characters."""
        for k, text in enumerate(texts):
            for part in self.special.split(text or "") if self.special else [text or ""]:
                at = 0
                while len(part) - at > WINDOW:
                    cut = _SAFE.search(part, at + WINDOW)
                    if cut is None:
                        break
                    yield k, part[at : cut.start()]
                    at = cut.start()
                if at < len(part):
                    yield k, part[at:] if at else part

    def counts(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts), dtype=np.int64)
        if self.special:
            for k, text in enumerate(texts):
                if text and "<" in text:
                    total[k] = sum(1 for _ in self.special.finditer(text))
        group, size = [], 0
        for k, part in self.windows(texts):
            if group and size + len(part) > WINDOW:
                self._add(group, total)
                group, size = [], 0
            group.append((k, part))
            size += len(part) + 1
        if group:
            self._add(group, total)
        return total

    def _add(self, group: list[tuple[int, str]], total: np.ndarray) -> None:
        text = "\n".join(part for _, part in group) + "\n"
        codes = self.cutter.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        ends = np.cumsum([len(part) + 1 for _, part in group])
        codes[ends - 1] = END
        starts = self.cutter.starts(codes)
        # A piece ends where the next begins or where its text ends.
        owner = np.searchsorted(ends, starts, side="right")
        stops = np.minimum(np.append(starts[1:], len(text)), ends[owner] - 1)
        known, count = self.pairs.pieces, self.pairs.count
        found = []
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            n = known.get(text[a:b])
            if n is None:
                n = count(text[a:b])
                known = self.pairs.pieces
            found.append(n)
        sums = np.bincount(owner, weights=np.asarray(found, dtype=np.float64), minlength=len(group)).astype(np.int64)
        np.add.at(total, [k for k, _ in group], sums)


_SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
_PLANS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every text, for the byte-level BPE tokenizer of a file."""
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast(compiled(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, plan)
        for batch in batches:
            n = counter.counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=[key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return (
        docs.select(F.col(key), size.alias("n_bytes"), F.col(text))
        .mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def _counter(path: str, plan) -> Counter:
    if path not in _PLANS:
        _PLANS[path] = Counter(plan.value)
    return _PLANS[path]
