"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition over the words, lines or counts of a text. A bounded
sample of rows gives the seconds that a rule takes and the share of rows that
it rejects; rules run in the order of rejections per second, and a row leaves
the cascade at the first rule that rejects it, so that later rules are not
evaluated for it. The order changes the work and ``rejected_by``, never
``kept``.

Defined cases: a null or empty text, or one of white space only, has no words
and fails the base rule; a null or repeated ``doc_id`` changes nothing, since
each row is judged by its own text; an empty table gives an empty result;
other columns are kept as they are, whatever their names, unless
they are among the names returned, whose columns are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BLANKS, fixed

#: Words in the windows that count as repeated.
WINDOW = 8
#: Base rule: fewest words, and highest share (%) of words in repeated windows.
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: Rows of the sample that orders the rules; it never decides about a row.
SAMPLE_ROWS = 500

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the columns of ``measured``."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    """The production rules. Shares are integer comparisons, so that no rounding decides."""
    words = F.col("n_words")
    with_letter = F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}")))
    shouted = F.size(F.filter("_words", lambda w: w.rlike(r"\p{Lu}{2}")))
    return [
        Rule("few_letters", 100 * with_letter < 80 * words),
        Rule("shouting", 100 * shouted > 50 * words),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 50 * F.col("_n_lines")),
        Rule("long_words", F.col("word_chars") > 40 * words),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of each text, and ``_words`` and ``_n_lines`` for the rules.

    Words that stand in a window of 8 words found at least twice in the text
    are counted once each. Texts without any repeated window, the usual case,
    are told apart by one distinct count over the hashed windows.
    """
    n, start = F.size("_words"), WINDOW - 1
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - start), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, k: F.coalesce(F.get("_placed", k)["h"] == x["h"], F.lit(False))
    repeated = F.sort_array(F.transform(
        F.filter("_placed", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]
    ))
    covered = F.aggregate(
        "_repeated",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    many = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return (
        docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumns({"_words": F.array_remove(F.split("_text", BLANKS), ""), "_lines": lines})
        .withColumn("_windows", windows)
        .withColumn("_placed", F.when(many, placed))
        .withColumn("_repeated", F.when(F.col("_placed").isNotNull(), repeated))
        .withColumns({
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.col("_repeated").isNotNull(), covered), F.lit(0)).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
        })
        .drop("_text", "_lines", "_windows", "_placed", "_repeated")
    )


def order_rules(docs: DataFrame, given: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second, both measured on at most ``rows`` rows."""
    few = fixed(measured(docs.select(F.col(text)).limit(rows), text).drop(text))
    shares = few.agg(*[F.avg(F.coalesce(r.rejects, F.lit(False)).cast("int")).alias(r.name) for r in given]).first()
    gain = {}
    for rule in given:
        start = time.perf_counter()
        few.agg(F.count_if(rule.rejects)).collect()
        gain[rule.name] = (shares[rule.name] or 0.0) / (time.perf_counter() - start)
    return sorted(given, key=lambda r: (-gain[r.name], r.name))


def judge(docs: DataFrame, text: str = "text", given: list[Rule] | None = None) -> DataFrame:
    """Adds the measures, ``base_failed``, ``kept`` and ``rejected_by`` to each row.

    ``rejected_by`` names the base rule or the first rule of the cascade that
    rejects the row, and is null for a row that is kept.
    """
    ordered = order_rules(docs, given if given is not None else rules(), text)
    words = F.col("n_words")
    base = (words < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * words)
    verdict = F.when(base, F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    named = [*MEASURES, "base_failed", "rejected_by", "kept"]
    return (
        measured(docs.drop(*[c for c in docs.columns if c.lower() in named]), text)
        .withColumns({"base_failed": base, "rejected_by": verdict})
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("_words", "_n_lines")
    )


QUALITY_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
           row_number() OVER () AS k
    FROM documents),
w AS (SELECT k, i, array_to_string(words[i:i + 7], ' ') AS part
      FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8)),
r AS (SELECT k, part FROM w GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM w SEMI JOIN r USING (k, part), (SELECT unnest(range(8)) AS j) GROUP BY k),
m AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
           len(lines) AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS with_letter,
           len(list_filter(words, lambda x: regexp_matches(x, '\p{Lu}{2}'))) AS shouted
    FROM t LEFT JOIN c USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * with_letter < 80 * n_words
            OR 100 * shouted > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars > 40 * n_words) AS kept
FROM m
"""


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), F.col(text).alias("_judged"))
    # Filters pass projections, which would write the measures out anew at each use; they stop at the generator.
    verdict = F.explode(F.array("kept")).alias("_stays")
    return judge(packed, "_judged").select("_row", verdict).where("_stays").select("_row.*")
