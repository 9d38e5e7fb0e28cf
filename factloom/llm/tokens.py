"""Token ids by the tokenizers library, with a bounded memo of text chunks.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so that the
ids of the chunks, put together, are the ids of the whole text. Chunks recur
(Zipf), hence each worker keeps the ids of those it has met; the memo is
emptied when it holds ``MEMO`` chunks (or as many as asked for), so its memory does not grow with the data.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Chunks that a worker keeps, and the longest chunk that it keeps, in characters.
MEMO, LONGEST = 1_000_000, 64

_SPACES = re.compile(r"\s\s|\x00")
#: Byte-level pieces take at most one leading space, and a line feed between two
#: visible characters is a piece of its own. Hence every boundary before a single
#: space or around a single line feed, with visible characters on both sides, is
#: a piece boundary.
_BYTE_CUTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: Stands between words that are encoded together; texts with it are encoded alone.
_MARK = "\ue000"


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once per worker; special tokens in a text are plain text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class Encoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit arrays, in bytes."""

    def __init__(self, path: str, most: int = MEMO):
        self.tokenizer, self.most = load(path), most
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(found, dtype=self.dtype)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text whose ids, put together, are the text's ids."""
        raise NotImplementedError

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk."""
        raise NotImplementedError

    def _remember(self, chunks: list[str], ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> dict[str, bytes]:
        if len(first) != len(chunks) or len(end) != len(chunks):
            return {c: self.ids(c).tobytes() for c in chunks}
        data, w = ids.tobytes(), self.dtype.itemsize
        return {c: data[a * w : b * w] for c, a, b in zip(chunks, first.tolist(), end.tolist(), strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
            memo[""] = b""
        parts = [self.chunks(t) for t in texts]
        # Each chunk is looked up once a call here, however often it occurs.
        missing = [c for c in set().union(*parts) if c not in memo]
        long = {c: self.ids(c).tobytes() for c in missing if len(c) > LONGEST or _MARK in c}
        memo.update(self.learn([c for c in missing if c not in long]))
        if not long:
            return [b"".join(map(memo.__getitem__, p)) for p in parts]
        return [b"".join([memo[c] if c in memo else long[c] for c in p]) for p in parts]


class ByteEncoder(Encoder):
    """For a byte-level tokenizer whose pieces start with at most one space."""

    def __init__(self, path: str, most: int = MEMO):
        super().__init__(path, most)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.feed = self.ids("\n")

    def chunks(self, text: str) -> list[str]:
        if _SPACES.search(text) or text[:1].isspace() or text[-1:].isspace():
            return _BYTE_CUTS.split(text)
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks with one leading space are told apart by it, others by line feeds between them."""
        spaced, plain, rest = [], [], []
        for c in chunks:
            inner = c[1:] if c[0] == " " else c
            to = rest if not inner or any(x.isspace() for x in inner) else spaced if c[0] == " " else plain
            to.append(c)
        out = {c: self.ids(c).tobytes() for c in rest}
        if spaced:
            ids = self.ids("".join(spaced))
            first = np.flatnonzero(self.spaced[ids])
            out |= self._remember(spaced, ids, first, np.append(first[1:], len(ids)))
        if plain:
            ids = self.ids("\n".join(plain))
            at = np.flatnonzero(ids == self.feed[0])
            out |= self._remember(plain, ids, np.append(0, at + 1), np.append(at, len(ids)))
        return out


class WordEncoder(Encoder):
    """For a tokenizer that drops white space, so that any ASCII blank separates chunks."""

    def __init__(self, path: str, most: int = MEMO):
        super().__init__(path, most)
        self.mark = self.ids(_MARK)

    def chunks(self, text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        if not chunks:
            return {}
        ids, m = self.ids(f" {_MARK} ".join(chunks)), len(self.mark)
        hit = np.ones(max(len(ids) - m + 1, 0), dtype=bool)
        for k in range(m):
            hit &= ids[k : len(ids) - m + 1 + k] == self.mark[k]
        at = np.flatnonzero(hit)
        return self._remember(chunks, ids, np.append(0, at + m), np.append(at, len(ids)))


@lru_cache(maxsize=4)
def encoder(path: str, kind: str, most: int = MEMO) -> Encoder:
    """One encoder per worker, tokenizer and size of memo; ``kind`` is ``byte`` or ``word``."""
    return {"byte": ByteEncoder, "word": WordEncoder}[kind](path, most)
