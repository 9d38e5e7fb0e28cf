"""Near duplicates, language model, quality rules and the pipeline, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from factloom.llm import katz, langid, minhash, quality
from factloom.llm.common import remainder
from factloom.session import ensure_checkpoint_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}x" for _ in range(n)]


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(texts: dict[int, str | None], percent: int) -> dict[int, int]:
    sets = {k: shingles(t) for k, t in texts.items()}
    up = {k: k for k in texts}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def corpus() -> dict[int, str | None]:
    rng = random.Random(3)
    texts: dict[int, str | None] = {}
    for base in range(12):
        original = prose(rng, rng.choice([12, 60, 200]), 5000)
        for copy in range(6):
            changed = list(original)
            for _ in range(copy * len(original) // 60):
                changed[rng.randrange(len(changed))] = f"n{rng.random()}"
            texts[base * 10 + copy] = " ".join(changed)
    texts |= {500: None, 501: "", 502: " \n\t", 503: "one two", 504: "One  TWO", 505: "one", 506: "É a b c d", 507: "é a b c d"}
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in texts.items()], "doc_id long, text string, n_shingles int, rep string")
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs, percent).collect()}
    want = roots(texts, percent)
    assert {k: r["component_id"] for k, r in found.items()} == want
    assert {k: r["n_shingles"] for k, r in found.items()} == {k: len(shingles(t)) for k, t in texts.items()}
    assert all(r["kept"] == (want[k] == k) for k, r in found.items())


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(prose(random.Random(1), 30_000, 100_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (None, long), (3, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (None, None, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def katz_by_hand(texts: list[tuple[int | None, str | None]]) -> dict[int | None, tuple]:
    """The model written out with dictionaries of words."""
    crc = lambda k: None if k is None else zlib.crc32(str(k).encode()) % 5
    seen = [[*words(t), "</s>"] for k, t in texts if crc(k) not in (None, 1)]
    one = Counter(w for s in seen for w in s)
    two = Counter(p for s in seen for p in zip(["<s>", *s[:-1]], s, strict=True))
    n = sum(one.values())
    d1, d2 = (katz.discounts(Counter(c.values())) for c in (one, two))
    cut = lambda c, d: c * d[c] if c < len(d) else c
    p = {w: cut(c, d1) / n for w, c in one.items()}
    unknown = 1 - sum(p.values())
    if unknown <= 0:
        unknown = 0.5 / n
    pairs = {x: c for x, c in two.items() if c >= katz.LEAST_PAIR}
    total, alpha = {}, {}
    for h in {h for h, _ in pairs}:
        own = [(w, c) for (g, w), c in pairs.items() if g == h]
        mass, ch = sum(cut(c, d2) for _, c in own), len(seen) if h == "<s>" else one[h]
        total[h] = ch + 1 if mass > ch - 1e-9 else ch
        alpha[h] = (1 - mass / total[h]) / (1 - sum(p[w] for w, _ in own))
    # After any history, known words and the unknown ones together have probability one.
    for h in [*alpha][:20]:
        every = sum(cut(pairs[h, w], d2) / total[h] if (h, w) in pairs else alpha[h] * p[w] for w in p)
        if abs(unknown + sum(p.values()) - 1) < 1e-9:
            assert every + alpha[h] * unknown == pytest.approx(1)
    out = {}
    for k, t in texts:
        tokens, base, score = [*words(t), "</s>"], 0.0, 0.0
        for h, w in zip(["<s>", *tokens[:-1]], tokens, strict=True):
            base += math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1)))
            if (h, w) in pairs:
                score += math.log10(cut(pairs[h, w], d2) / total[h])
            else:
                score += math.log10(alpha.get(h, 1.0) * p.get(w, unknown))
        out[k] = (crc(k) == 1, len(tokens), sum(one[w] > 0 for w in tokens), n, base, score)
    return out


def test_katz(spark):
    rng = random.Random(5)
    # Each word draws a second one after it, so that pairs tell more than words.
    texts = [(k, " ".join(f"{w} after{w}" for w in prose(rng, rng.randrange(1, 60)))) for k in range(150)]
    texts += [(900, None), (901, ""), (902, "NEVER seen before"), (903, "W1X w1x"), (None, "w1x w2x")]
    docs = spark.createDataFrame([(k, t, 5, 7.0) for k, t in texts], "doc_id long, text string, n int, score double")
    part = remainder("doc_id", 5)
    got = {r["doc_id"]: r for r in katz.score(docs, held_out=part == 1, train=part != 1).collect()}
    want = katz_by_hand(texts)
    assert got.keys() == want.keys()
    for k, (held, n, known, total, base, score) in want.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total), k
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(score, abs=1e-6), k
    better = [r["score"] > r["base_score"] for k, r in got.items() if k is not None and k < 900 and r["held_out"]]
    assert sum(better) > len(better) / 2


def test_katz_keeps_pairs_seen_once(spark):
    """Against a model of all pairs, written without ``LEAST_PAIR``."""
    rng = random.Random(6)
    texts = {k: " ".join(prose(rng, 40)) for k in range(60)} | {70: "only once", 71: "only once more"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    learned = [[*words(t), "</s>"] for k, t in texts.items() if k != 71]
    one, two = Counter(), Counter()
    for s in learned:
        one.update(s)
        two.update(zip(["<s>", *s[:-1]], s, strict=True))
    n, d1, d2 = sum(one.values()), katz.discounts(Counter(one.values())), katz.discounts(Counter(two.values()))
    assert two["only", "once"] == 1 and 0 < d2[1] < 1 and sum(c == 1 for c in two.values()) > len(two) / 2
    p = {w: c * (d1 + [1.0])[min(c, len(d1))] / n for w, c in one.items()}
    unknown = 1 - sum(p.values())

    def after(h: str, w: str) -> float:
        ch = len(learned) if h == "<s>" else one[h]
        own = {v: c * (d2 + [1.0])[min(c, len(d2))] for (g, v), c in two.items() if g == h}
        if not own:
            return p.get(w, unknown)
        ch += sum(own.values()) > ch - 1e-9
        return own[w] / ch if w in own else (1 - sum(own.values()) / ch) / (1 - sum(p[v] for v in own)) * p.get(w, unknown)

    got = {r["doc_id"]: r["score"] for r in katz.score(docs, F.col("doc_id") == 71, F.col("doc_id") != 71).collect()}
    for k, t in texts.items():
        tokens = [*words(t), "</s>"]
        assert got[k] == pytest.approx(sum(math.log10(after(h, w)) for h, w in zip(["<s>", *tokens[:-1]], tokens, strict=True)), abs=1e-6), k


def test_katz_where_all_words_follow_one_history(spark):
    docs = spark.createDataFrame([(1, "a"), (2, ""), (3, "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in katz.score(docs, F.col("doc_id") == 3, F.col("doc_id") != 3).collect()}
    assert len(got) == 3 and all(math.isfinite(x) and x < 0 for x in got.values())


def test_katz_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    part = remainder("doc_id", 5)
    assert katz.score(docs, held_out=part == 1, train=part != 1).count() == 0


def quality_by_hand(text: str | None) -> tuple:
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    repeated = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed)


def test_quality(spark):
    rng = random.Random(9)
    texts = [None, "", " \n ", "a " * 40, "# $ % " * 20, "\n".join(["one line of words"] * 12), "É x \x0b y\x0cz \U0001f600 " * 3]
    texts += [" ".join(prose(rng, n)) + "\n" + " ".join(prose(rng, 9)) for n in (5, 20, 100, 5000)]
    texts += [" ".join((x := prose(rng, 30, 9999)) + x[3:14] + prose(rng, 40, 9999))]
    docs = spark.createDataFrame([(k, t, -1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (*(r[m] for m in quality.MEASURES), r["base_failed"]) == quality_by_hand(text), k
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (r["rejected_by"] is None)
    assert quality.judge(docs.limit(0)).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}


def test_order_of_rules_changes_no_verdict(spark):
    docs = spark.createDataFrame([(k, " ".join(prose(random.Random(k), 30)).upper() * (k % 2) + " a1 $ b" * 20) for k in range(20)], "doc_id long, text string")
    given = quality.rules()
    a, b = ({r["doc_id"]: r["kept"] for r in quality.judge(docs, given=g).collect()} for g in (given, given[::-1]))
    assert a == b


LANGUAGES = {"aa": "lorem ipsum dolor sit amet", "bb": "zwick kratz wurz halm tof", "cc": "nalo vike suro pemi tavu"}


def labelled(n: int) -> list[tuple]:
    rng = random.Random(2)
    return [(k, " ".join(rng.choice(LANGUAGES[x].split()) for _ in range(rng.randrange(5, 40))), x, "s", 1) for k in range(n) for x in [rng.choice([*LANGUAGES])]]


def test_language(spark):
    rows = labelled(400)
    docs = spark.createDataFrame(rows + [(900, None, "aa", "s", 1), (901, "12 34 !", "bb", "s", 1), (902, "lorem dolor", None, "s", 1)], DOCS)
    part = remainder("doc_id", 5)
    got = {r["doc_id"]: r["found"] for r in langid.identify(docs, part != 0, out="found").collect()}
    held = [(k, x) for k, _, x, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k]["lang"] == x for k, x in held) >= 0.98 * len(held)
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert got[900]["lang"] == got[901]["lang"] == "und" and got[900]["rejected"] and got[902]["lang"] == "aa"
    assert langid.keep(docs).columns == docs.columns
    none = langid.identify(docs.limit(0), part != 0, out="found")
    assert none.count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice(LANGUAGES[x].split()) + str(rng.randrange(900)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)) for k in range(60) for x in [rng.choice([*LANGUAGES])]}
    texts |= {100: texts[1], 101: texts[2] + " more", 102: "short text", 103: "12 34 " * 30}
    rows = [(k, t, next((x for x, w in LANGUAGES.items() if t[:3] in w), "aa"), "s", len(t)) for k, t in texts.items()]
    spark.createDataFrame([*rows, (104, None, None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(range(60))
    assert sum(r["length"] for r in got if r["piece"] == 0) > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "best_fit_packing"]


def test_pipeline_without_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dedup_keeps_rows_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z")], "doc_id long, text string, kept string")
    assert sorted(map(str, minhash.unique(docs).select(F.col("kept")).collect())) == ["Row(kept='x')", "Row(kept='z')"]


def test_pair_counts_have_no_cut(spark):
    assert "least" not in katz.pair_counts.__code__.co_varnames
    train = spark.createDataFrame([("a b a b c",), ("a b",)], "t string")
    assert sorted(r.c for r in katz.pair_counts(train, 3).collect()) == [1, 1, 1, 1, 2, 3]


def test_katz_over_many_groups(spark):
    """Histories that are spread and others, asked by many groups, some of held-out texts only."""
    rng = random.Random(9)
    texts = [(k, " ".join(prose(rng, rng.randrange(1, 90), 3000))) for k in range(400)] + [(900, None), (901, "never seen w1x"), (None, "w1x w2x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    part = remainder("doc_id", 5)
    got = {r["doc_id"]: r for r in katz.score(docs, held_out=part == 1, train=part != 1, gather=700).collect()}
    want = katz_by_hand(texts)
    assert got.keys() == want.keys() and katz.Totals.of(next(iter(got.values()))["train_tokens"], 1, {}).wide > 2
    for k, (_, _, known, total, base, score) in want.items():
        assert (got[k]["n_known"], got[k]["train_tokens"]) == (known, total), k
        assert got[k]["base_score"] == pytest.approx(base, abs=1e-6) and got[k]["score"] == pytest.approx(score, abs=1e-6), k


def test_katz_stores_few_bytes_a_token(spark):
    """Hardly a pair comes twice; tables of pairs took 16 bytes a token here, beside their shuffles."""
    rng = random.Random(10)
    texts = [(k, " ".join(f"w{rng.randrange(20_000)}" for _ in range(1000))) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    folder = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before, part = size(), remainder("doc_id", 5)
    rows = katz.score(docs, held_out=part == 1, train=part != 1).agg(F.sum("n_tokens").alias("n")).first()
    assert size() - before < 12 * rows["n"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
