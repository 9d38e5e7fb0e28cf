"""Language identification: averaged hashed subword embeddings, linear softmax, rejection.

A text is the mean embedding of its hashed letter n-grams (with word edges); a
linear softmax over it gives the language. Both are trained in numpy by
stochastic gradient descent on the driver, on a bounded sample: ``PER_LANGUAGE``
labelled texts, about, of each of at most ``LANGUAGES`` languages. A part of the
sample that is kept out of training sets the temperature of the softmax and the
score under which a prediction is rejected.

Mean and linear map commute, so tasks use one table of logits per n-gram bucket;
its size depends on the parameters alone, and it is broadcast. Whole texts are
read.

Defined cases: a null text or one without letters is ``und`` with score 0 and
rejected; so is every text if there is no labelled row (as in an empty table);
null keys and labels are not learned from; repeated rows get equal results;
equal logits go to the language first in order of name; other columns
are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import give_back, mix

UNKNOWN = "und"
BUCKETS, DIMENSION, SIZES = 1 << 15, 16, (2, 3, 4)
#: Sample: labelled texts per language, about, and languages (the most frequent ones).
PER_LANGUAGE, LANGUAGES = 800, 200
EPOCHS, RATE = 4, 0.5
#: A text is rejected under the score that this share of right predictions on the
#: kept-out sample do not reach, but never above ``HIGHEST``.
LOST, HIGHEST = 0.001, 0.5
#: Characters that are hashed together.
GROUP = 250_000
_PLACES = mix(np.arange(3001, 3001 + max(SIZES), dtype=np.uint64)) | np.uint64(1)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of several texts, and the text of each, both by text."""
    data = [(" " + t.lower() + " ").encode("utf-32-le", "surrogatepass") for t in texts]
    chars = np.frombuffer(b"".join(data), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(d) // 4 for d in data])
    letter = _letters()[chars]
    codes = np.where(letter, chars, 0).astype(np.uint64)
    found, whose = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        # Inner characters are letters, and so is one of the outer ones: grams never cross words.
        good = letter[:m] | letter[n - 1 : n - 1 + m]
        for k in range(1, n - 1):
            good &= letter[k : k + m]
        at = np.flatnonzero(good)
        sums = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            sums += codes[at + k] * _PLACES[k]
        sums ^= sums >> np.uint64(31)
        sums *= _PLACES[0]
        found.append((sums >> np.uint64(64 - 15)).astype(np.int32))
        whose.append(owner[at])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(whose)


@dataclass
class Model:
    """Languages, logits per bucket, bias, temperature and the score that is needed."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    needed: float = 0.0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Softmax of each text, and whether it has a letter."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        buckets, owner = ngrams(texts)
        np.add(counts, np.bincount(owner, minlength=len(texts)), out=counts)
        for k in range(len(self.languages)):
            sums[:, k] = np.bincount(owner, weights=self.logits[buckets, k], minlength=len(texts))
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
        return z / np.maximum(z.sum(axis=1, keepdims=True), 1e-300), counts > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, score, np.ones(len(texts), dtype=bool)
        filled, sizes = [t or "" for t in texts], np.cumsum([len(t or "") for t in texts]) // GROUP
        known = np.zeros(len(texts), dtype=bool)
        for g in np.unique(sizes):
            lo, hi = np.searchsorted(sizes, [g, g + 1])
            p, letters = self.scores(filled[lo:hi])
            known[lo:hi], best = letters, p.argmax(axis=1)
            score[lo:hi] = np.where(letters, p[np.arange(hi - lo), best], 0)
            names[lo:hi] = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return names, score, ~known | (score < self.needed)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit on labelled texts; each also gives short runs of its words, since short texts occur too."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    index = {x: k for k, x in enumerate(languages)}
    order = rng.permutation(len(texts))
    held = set(order[: max(1, len(texts) // 5)].tolist()) if len(texts) > 5 else set()
    samples: list[tuple[np.ndarray, np.ndarray, int]] = []
    kept_out: list[tuple[str, int]] = []
    for k in order.tolist():
        words, label = texts[k].split(), index[labels[k]]
        parts = [texts[k]]
        for size in (3, 10, 30):
            at = int(rng.integers(0, max(1, len(words) - size + 1)))
            parts.append(" ".join(words[at : at + size]))
        if k in held:
            kept_out += [(p, label) for p in parts]
            continue
        buckets, owner = ngrams(parts)
        for j in range(len(parts)):
            found, n = np.unique(buckets[owner == j], return_counts=True)
            if len(found):
                samples.append((found, (n / n.sum())[:, None], label))
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights, bias = rng.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            found, share, label = samples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = (table[found] * share).sum(axis=0)
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            # The embedding of a bucket moves by its share of the text; scaled up since shares are small.
            table[found] -= rate * 50 * share * back
    model = Model(languages, (table @ weights).astype(np.float32), bias)
    if kept_out:
        calibrate(model, [t for t, _ in kept_out], np.array([x for _, x in kept_out]))
    return model


def calibrate(model: Model, texts: list[str], labels: np.ndarray) -> None:
    """Temperature of least log loss, then the score that right predictions reach."""
    p, letters = model.scores(texts)
    logits = np.log(np.maximum(p[letters], 1e-30))
    labels = labels[letters]
    if not len(labels):
        return
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 10, 41):
        z = logits / t
        loss = float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), labels]))
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    p, letters = model.scores(texts)
    p = p[letters]
    right = p.argmax(axis=1) == labels
    if right.any():
        model.needed = float(min(HIGHEST, np.quantile(p.max(axis=1)[right], LOST)))


def sample(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Labelled texts for training, about equally many per language, chosen by a hash of the text."""
    known = docs.select(F.col(text).alias("t"), F.col(label).cast("string").alias("l")).where("t is not null and l is not null")
    counts = known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()
    if not counts:
        return [], []
    share = F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.lit(min(1.0, per_language / r["n"])))])
    uniform = F.pmod(F.xxhash64("t"), F.lit(1 << 40)) / (1 << 40)
    rows = (
        known.where(uniform < F.element_at(share, F.col("l")))
        .dropDuplicates(["t", "l"]).limit(2 * per_language * len(counts)).collect()
    )
    rows.sort(key=lambda r: (r["l"], r["t"]))
    return [r["t"] for r in rows], [r["l"] for r in rows]


def predictor(spark: SparkSession, model: Model):
    """A column function: text to struct (lang, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, score, rejected = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        give_back()
        return pd.DataFrame({"lang": names, "score": score, "rejected": rejected})

    return predict


def identify(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", out: str = "language") -> DataFrame:
    """Adds a struct (lang, score, rejected), learned from the rows where ``learn`` holds."""
    model = train(*sample(docs.where(learn), text, label))
    return docs.withColumn(out, predictor(docs.sparkSession, model)(F.col(text)))


def keep(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """The rows whose language is told with a sufficient score, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    packed = docs.select(row, F.col(text).alias("_told"), F.col(label).alias("_label"))
    known = F.col("_label").isNotNull()
    return identify(packed, known, "_told", "_label", "_found").where("not _found.rejected").select("_row.*")
