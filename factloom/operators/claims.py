"""Claim extraction, grounding and validation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.clean import TS_CODE, normalize_ws
from factloom.functions.hashing import struct_hash
from factloom.operators.scaling import spread_join
from factloom.vocab import BUSINESS_STAGES, CLAIM_STATUS, CONCEPT_PLATFORMS, EVIDENCE_STATES, PREDICATES

EXTRACTOR_VERSION = "rules-extractor-0.1.0"


@dataclass(frozen=True)
class Rule:
    """One trigger: business stage, evidence state, case-insensitive pattern."""

    stage: str
    evidence: str
    pattern: str


# Trigger words, in the order they are tried (fixed values)
DEFAULT_RULES = [
    Rule("MASS_PRODUCTION", "PRODUCT_DISCLOSED", "mass production|规模化量产|已?实现量产|批量生产"),
    Rule("SMALL_BATCH", "PRODUCT_DISCLOSED", "small[- ]batch|小批量"),
    Rule("SAMPLE_VALIDATION", "PRODUCT_DISCLOSED", "sample validation|送样|客户验证|样品验证"),
    Rule("PROTOTYPE", "PRODUCT_DISCLOSED", "prototype|样机|原型"),
    Rule("RESEARCH", "PRODUCT_DISCLOSED", "research|研发|研制"),
    Rule("TECHNOLOGY_RESERVE", "PRODUCT_DISCLOSED", "technology reserve|技术储备"),
    Rule("UNKNOWN", "REVENUE_DISCLOSED", "revenue|营业收入|营业收入稳定增长|形成收入"),
    Rule("UNKNOWN", "COMPANY_DENIAL", "denies involvement|否认|未参与|不涉及"),
    Rule("UNKNOWN", "EVIDENCE_INSUFFICIENT", "insufficient evidence|证据不足|暂无明确信息"),
]
# Conditional, planned or future wording (fixed values)
HEDGE_PATTERN = "|".join(
    [
        r"\bif\b", r"\bunless\b", r"\bcondition(al)? on\b", r"\bplans? to\b", r"\bplans\b",
        r"\bplanning\b", r"\bexpects? to\b", r"\bexpected to\b", r"\banticipat(es|ed|ing)\b",
        r"\bis going to\b", r"\baims? to\b", r"\bintends? to\b", r"\bwould\b", r"\bshall\b",
        r"\bwill\b", r"\bscheduled to\b", r"\bupcoming\b", r"\bforthcoming\b", r"\bmight\b",
        r"\bmay\b", r"\bcould\b",
        "计划", "拟", "将于", "即将", "预计", "未来", "尚未", "暂未", "如果", "若", "一旦", "待", "或有望",
    ]
)
# Instructions inside a document are data, never commands (fixed values)
INJECTION_PATTERN = "|".join(
    [
        "ignore (all )?(previous |system )?instructions", "send (an )?email", "访问url",
        "execute .* command", "invoke tool", "忽略(全部)?(之前的?)?(系统)?指令", "发送邮件",
        "执行命令", "访问链接",
    ]
)


REGEX_SYNTAX = re.compile(r"[\\()\[\]?*+.^$|{}]")


def _split_alternatives(pattern: str) -> tuple[list[str], list[str]]:
    """Top-level alternatives of a pattern: plain texts, and real expressions."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(pattern):
        escaped = i > 0 and pattern[i - 1] == "\\"
        if ch in "([" and not escaped:
            depth += 1
        elif ch in ")]" and not escaped:
            depth -= 1
        elif ch == "|" and depth == 0 and not escaped:
            parts.append(pattern[start:i])
            start = i + 1
    parts.append(pattern[start:])
    plain = [p for p in parts if p and not REGEX_SYNTAX.search(p)]
    return plain, [p for p in parts if p not in plain]


def _needed(expression: str) -> str:
    """Longest text that every match of an expression without alternatives holds, in lower case.

    Letters with a partner outside ASCII when case is folded (i, s, k) are left
    out, so that a search in the lowered text misses no match.
    """
    runs, run, depth, i = [], "", 0, 0
    while i < len(expression):
        ch = expression[i]
        after = expression[i + 1 : i + 2]
        plain = depth == 0 and not REGEX_SYNTAX.match(ch) and ch.lower() not in "isk"
        if plain and (ch.isascii() or ch.lower() == ch.upper()) and after not in ("?", "*", "{"):
            run += ch.lower()
        else:
            runs, run = [*runs, run], ""
        if ch == "\\":
            i += 1
        elif ch == "[":
            i = expression.index("]", i + 2)
        elif ch == "{":
            i = expression.index("}", i)
        else:
            depth += (ch == "(") - (ch == ")")
        i += 1
    return max([*runs, run], key=len)


def _matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Case-insensitive search for any alternative of the pattern.

    Plain texts are looked up with ``contains`` on the lowered text (``low``),
    which is far cheaper than an expression; expressions fold case and bound
    words as Unicode does, and are tried where the text holds what they need.
    """
    low = F.lower(text) if low is None else low
    plain, regex = _split_alternatives(pattern)
    found = [F.contains(low, F.lit(p.lower())) for p in plain]
    groups: dict[str, list[str]] = {}
    for part in regex:
        needed = _needed(part)
        groups.setdefault(needed if len(needed) >= 2 else "", []).append(part)
    for needed, parts in groups.items():
        joined = "|".join(parts)
        flags = "iuU" if "\\" in "|".join(regex) else "iu"
        hit = text.rlike(f"(?{flags})({joined})")
        found.append(F.contains(low, F.lit(needed)) & hit if needed else hit)
    return reduce(lambda a, b: a | b, found)


def screen_injection(
    fragments: DataFrame, pattern: str = INJECTION_PATTERN
) -> tuple[DataFrame, DataFrame]:
    """Fragments without, and with, instruction-like text."""
    hit = _matches(F.col("quote_text"), pattern, F.col("_low") if "_low" in fragments.columns else None)
    notes = fragments.filter(hit).withColumn(
        "note", F.concat(F.lit("injection content treated as data: "), F.substring("checksum", 1, 12))
    )
    return fragments.filter(~hit), notes


def hedge(df: DataFrame, pattern: str = HEDGE_PATTERN) -> DataFrame:
    """Hedged wording halves the trust in a claim."""
    hedged = _matches(F.col("quote_text"), pattern)
    return df.withColumn("hedged", hedged).withColumn(
        "confidence", F.when(F.col("hedged"), 0.5).otherwise(0.85)
    )


def choose_predicate(df: DataFrame) -> DataFrame:
    """X4."""
    return df.withColumn(
        "predicate_code",
        F.when(F.col("evidence_state") == "COMPANY_DENIAL", "DENIES_INVOLVEMENT").otherwise("PRODUCES"),
    )


def extract_claims(
    fragments: DataFrame,
    rules: list[Rule] | None = None,
    hedge_pattern: str = HEDGE_PATTERN,
    injection_pattern: str = INJECTION_PATTERN,
) -> DataFrame:
    """The first matching rule of a fragment gives its only claim.

    A projection and a filter: the text is read once, nothing is shuffled.
    """
    rules = rules or DEFAULT_RULES
    # Generated columns are computed once a row: the text, the lowered text, and the rule
    lowered = fragments.withColumn("quote_text", F.explode(F.array("quote_text"))).withColumn(
        "_low", F.explode(F.array(F.lower("quote_text")))
    )
    clean, _ = screen_injection(lowered, injection_pattern)
    text, low = F.col("quote_text"), F.col("_low")
    first = F.explode(F.array(reduce(
        lambda acc, item: acc.when(_matches(text, item[1].pattern, low), item[0]),
        list(enumerate(rules))[1:],
        F.when(_matches(text, rules[0].pattern, low), 0),
    )))
    stages = F.array(*[F.lit(r.stage) for r in rules])
    states = F.array(*[F.lit(r.evidence) for r in rules])
    hits = clean.withColumn("_rule", first).filter(F.col("_rule").isNotNull())
    claims = hits.withColumns(
        {
            "business_stage": F.get(stages, F.col("_rule")),
            "evidence_state": F.get(states, F.col("_rule")),
            "extraction_version": F.lit(EXTRACTOR_VERSION),
        }
    ).drop("_rule", "_low")
    return choose_predicate(hedge(claims, hedge_pattern))


def claim_hash(claims: DataFrame, fragments: DataFrame) -> DataFrame:
    """Content hash over version, fragment checksums, extractor and claim content.

    The checksums of a document version are folded into one order-free digest
    per version by a partial aggregation, not gathered into a list.
    """
    part = F.xxhash64("checksum").cast("decimal(20,0)")
    digests = fragments.groupBy("document_version_id").agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.sum(part), F.min("checksum"), F.max("checksum")), 256)
        .alias("fragments_digest")
    )
    content = [
        c for c in (
            "document_version_id", "fragments_digest", "extraction_version", "subject_type",
            "subject_id", "predicate_code", "object_id", "object_value", "business_stage",
            "evidence_state", "valid_from", "valid_to", "quote_text",
        )
        if c in claims.columns or c == "fragments_digest"
    ]
    return (
        # One short row a version is looked up, so the claims with their texts are not sorted
        claims.join(digests.hint("shuffle_hash"), "document_version_id", "left")
        .withColumn("content_hash", struct_hash(*[F.col(c) for c in content]))
        .drop("fragments_digest")
    )


def new_claims(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """X5 replay: only claims whose content hash is unseen."""
    return claims.dropDuplicates(["content_hash"]).join(
        existing.select("content_hash"), "content_hash", "left_anti"
    )


def ground_quotes(quotes: DataFrame, fragments: DataFrame) -> DataFrame:
    """Status per quote ``(claim_id, evidence_id, document_version_id,
    page_number, char_start, char_end, quote_text)``; the first failed test decides."""
    stored = fragments.select(
        "evidence_id",
        F.col("document_version_id").alias("_version"),
        F.col("page_number").alias("_page"),
        F.col("char_start").alias("_start"),
        F.col("char_end").alias("_end"),
        # Normalised once per fragment, before quotes multiply it
        normalize_ws(F.col("quote_text")).alias("_text"),
    )
    found = F.contains("_text", normalize_ws(F.col("quote_text")))
    same_place = (
        (F.col("_page") == F.col("page_number"))
        & (F.col("_start") == F.col("char_start"))
        & (F.col("_end") == F.col("char_end"))
    )
    return (
        quotes.join(stored, "evidence_id", "left")
        .withColumn(
            "grounding",
            F.when(F.col("_text").isNull(), "FRAGMENT_MISSING")
            .when(~F.col("_version").eqNullSafe(F.col("document_version_id")), "VERSION_MISMATCH")
            .when(~found, "TEXT_NOT_FOUND")
            .when(~same_place, "RANGE_MISMATCH")
            .otherwise("OK"),
        )
        .drop("_version", "_page", "_start", "_end", "_text")
    )


# Reason texts of a candidate's verdict (fixed values); the fatal ones reject it
QUOTE_REASONS = {
    "FRAGMENT_MISSING": "quote references missing evidence fragment",
    "VERSION_MISMATCH": "quote version mismatch",
    "TEXT_NOT_FOUND": "quote text not found (possibly fabricated)",
    "RANGE_MISMATCH": "quote page/range mismatch",
}
NO_QUOTE = "text claim requires at least one grounded quote"
LABEL_ONLY = "MASS_PRODUCTION cannot be supported by platform classification alone"
REVENUE_UNPROVEN = "REVENUE_DISCLOSED requires a report period, segment or revenue quote"
DENIAL_UNPROVEN = "COMPANY_DENIAL requires the original text"
NOT_A_FACT = "EVIDENCE_INSUFFICIENT must not produce a fact claim (unknown != false)"
HEDGED = "conditional/planned/future phrasing cannot be promoted to a current fact"
FATAL = [*QUOTE_REASONS.values(), LABEL_ONLY, NOT_A_FACT]


def verdict(claims: DataFrame, grounding: DataFrame) -> DataFrame:
    """Reasons and status per claim; needs ``hedged`` and ``report_period`` columns."""
    facts = grounding.groupBy("claim_id").agg(
        *[F.bool_or(F.col("grounding") == s).alias(f"_{s}") for s in [*QUOTE_REASONS, "OK"]]
    )
    judged = claims.join(facts, "claim_id", "left")
    ok = F.coalesce("_OK", F.lit(False))
    state = F.coalesce("evidence_state", F.lit(""))
    reasons = F.array_compact(
        F.array(
            *[F.when(F.col(f"_{s}"), F.lit(text)) for s, text in QUOTE_REASONS.items()],
            F.when(F.col("_OK").isNull(), F.lit(NO_QUOTE)),
            F.when(
                (F.col("business_stage") == "MASS_PRODUCTION")
                & (state == "PLATFORM_CLASSIFICATION_ONLY"),
                F.lit(LABEL_ONLY),
            ),
            F.when(
                (state == "REVENUE_DISCLOSED") & F.col("report_period").isNull() & ~ok,
                F.lit(REVENUE_UNPROVEN),
            ),
            F.when((state == "COMPANY_DENIAL") & ~ok, F.lit(DENIAL_UNPROVEN)),
            F.when(state == "EVIDENCE_INSUFFICIENT", F.lit(NOT_A_FACT)),
            F.when(F.col("hedged"), F.lit(HEDGED)),
        )
    )
    return (
        judged.withColumn("reasons", reasons)
        .withColumn(
            "verdict",
            F.when(F.exists("reasons", lambda r: r.isin(FATAL)), "REJECTED")
            .when(F.size("reasons") > 0, "NEEDS_REVIEW")
            .otherwise("VALIDATED"),
        )
        .drop(*[f"_{s}" for s in [*QUOTE_REASONS, "OK"]])
    )


def check_predicate(claims: DataFrame, whitelist: list[str] | None = None) -> DataFrame:
    """A predicate outside the list sends a validated claim to review."""
    allowed = F.col("predicate_code").isin(whitelist or PREDICATES)
    return claims.withColumn(
        "predicate_reason",
        F.when(~allowed, F.concat(F.lit("predicate not in whitelist: "), "predicate_code")),
    )


NEGATED_WORDS = ["deny", "not_", "no_", "refute"]


def check_candidate(claims: DataFrame) -> DataFrame:
    """Reasons for a malformed candidate, empty when well formed."""
    predicate = F.lower("predicate_code")
    negated = reduce(lambda a, b: a | b, [F.contains(predicate, F.lit(w)) for w in NEGATED_WORDS])
    return claims.withColumn(
        "schema_reasons",
        F.array_compact(
            F.array(
                F.when(F.col("object_id").isNull() & F.col("object_value").isNull(),
                       F.lit("claim requires an object entity or object value")),
                F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1),
                       F.lit("confidence must be within 0..1")),
                F.when(F.col("char_end") < F.col("char_start"), F.lit("char_end must be >= char_start")),
                F.when(negated, F.lit("negation must use DENIES_INVOLVEMENT")),
            )
        ),
    )


def _violations(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """One row per broken check; a check that is NULL counts as broken."""
    entries = F.array(
        *[F.struct(F.lit(name).alias("shape"), F.coalesce(ok, F.lit(False)).alias("ok"))
          for name, ok in checks.items()]
    )
    return df.select(
        F.col(id_col).alias("focus"), F.inline(F.filter(entries, lambda e: ~e["ok"]))
    ).drop("ok")


def claim_shape_violations(claims: DataFrame) -> DataFrame:
    """X10."""
    optional = lambda c, values: F.col(c).isNull() | F.col(c).isin(values)
    return _violations(
        claims, "claim_id",
        {
            "claim_key": F.length(F.col("claim_id").cast("string")) > 0,
            "claim_subject": F.col("subject_id").isNotNull(),
            "predicate_code": F.col("predicate_code").isin(PREDICATES),
            "claim_object": F.col("object_id").isNotNull() | F.col("object_value").isNotNull(),
            "claim_status": F.col("claim_status").isin(CLAIM_STATUS),
            "business_stage": optional("business_stage", BUSINESS_STAGES),
            "evidence_state": optional("evidence_state", EVIDENCE_STATES),
            "confidence": F.col("confidence").between(0, 1),
            "recorded_at": F.col("recorded_at").isNotNull(),
            "ontology_version": F.col("ontology_version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"),
        },
    )


def time_order_violations(claims: DataFrame) -> DataFrame:
    """X11: the table rule allows an equal ``superseded_at``, the shape does not; both are told apart."""
    return _violations(
        claims, "claim_id",
        {
            "valid_time": ~F.coalesce(F.col("valid_to") <= F.col("valid_from"), F.lit(False)),
            "system_time": ~F.coalesce(F.col("superseded_at") <= F.col("recorded_at"), F.lit(False)),
            "system_time_table": ~F.coalesce(
                F.col("superseded_at") < F.col("recorded_at"), F.lit(False)
            ),
        },
    )


def accepted_without_evidence(claims: DataFrame, links: DataFrame) -> DataFrame:
    """X12."""
    suspect = claims.filter(
        (F.col("claim_status") == "ACCEPTED")
        & (F.coalesce("evidence_state", F.lit("")) != "STRUCTURED_SOURCE")
    )
    if "derived_from" in claims.columns:
        suspect = suspect.filter(F.col("derived_from").isNull())
    return suspect.join(links.select("claim_id"), "claim_id", "left_anti")


def label_only_production(claims: DataFrame) -> DataFrame:
    """X13."""
    return claims.filter(
        (F.col("business_stage") == "MASS_PRODUCTION")
        & (F.col("evidence_state") == "PLATFORM_CLASSIFICATION_ONLY")
    )


def revenue_without_period(claims: DataFrame) -> DataFrame:
    """X14."""
    return claims.filter(
        (F.col("evidence_state") == "REVENUE_DISCLOSED") & F.col("report_period").isNull()
    )


def tag_denial_violations(claims: DataFrame, links: DataFrame) -> DataFrame:
    """One row per claim and broken rule."""
    state, stage = F.coalesce("evidence_state", F.lit("")), F.coalesce("business_stage", F.lit("UNKNOWN"))
    tags = claims.filter(
        (F.col("predicate_code") == "TAGGED_AS")
        & ((state != "PLATFORM_CLASSIFICATION_ONLY") | (stage != "UNKNOWN"))
    ).select("claim_id", F.lit("tag_semantics").alias("shape"))
    denials = claims.filter(F.col("predicate_code") == "DENIES_INVOLVEMENT")
    wrong_state = denials.filter(state != "COMPANY_DENIAL").select(
        "claim_id", F.lit("denial_state").alias("shape")
    )
    no_text = denials.join(links.select("claim_id"), "claim_id", "left_anti").select(
        "claim_id", F.lit("denial_evidence").alias("shape")
    )
    return tags.unionByName(wrong_state).unionByName(no_text)


def object_not_product(claims: DataFrame, products: DataFrame) -> DataFrame:
    """X16."""
    return claims.filter(
        F.col("predicate_code").isin("PRODUCES", "DEVELOPS", "HAS_REVENUE_FROM")
        & F.col("object_id").isNotNull()
    ).join(
        products.select(F.col("product_id").alias("object_id")), "object_id", "left_anti"
    )


def table_shape_violations(df: DataFrame, shape: str) -> DataFrame:
    """Checks of one table kind."""
    if shape == "company":
        return _violations(df, "id", {"canonical_key": F.length(F.col("id").cast("string")) > 0})
    if shape == "security":
        return _violations(
            df, "id",
            {
                "ts_code": F.col("ts_code").rlike(TS_CODE),
                "issued_by": F.col("issuer_count") == 1,
                "listed_on": F.col("exchange_code").isNotNull(),
            },
        )
    if shape == "concept":
        return _violations(
            df, "id",
            {
                "label": F.col("name").isNotNull(),
                "source_platform": F.col("source_platform").isin(CONCEPT_PLATFORMS),
            },
        )
    if shape == "fragment":
        return _violations(
            df, "id",
            {
                "part_of_document": F.col("document_id").isNotNull(),
                "quote_text": F.length("quote_text") >= 5,
                "page_number": F.col("page_number").isNull() | (F.col("page_number") >= 1),
            },
        )
    if shape == "observation":
        return _violations(
            df, "id",
            {
                "observed_for": F.col("security_id").isNotNull(),
                "observes_metric": F.col("metric_code").isNotNull(),
                "report_period": F.col("period_end").isNotNull(),
                "metric_value": F.col("value").isNotNull(),
                "unit": F.col("unit").isNotNull(),
            },
        )
    raise ValueError(f"unknown shape {shape!r}")


#: Bits of the filter on anchors; its size is fixed, whatever the dictionary.
ANCHOR_BITS = 1 << 20
#: Characters from one gram of a text to the next, for names that are long enough.
STEPS = (64, 8, 1)


def _anchor_filter(names: DataFrame) -> Column:
    """Bit array of the hashes of all anchors, as one value of fixed size."""
    place = F.pmod(F.xxhash64("_anchor"), F.lit(ANCHOR_BITS))
    words = names.select(F.shiftright(place, 6).alias("w"), (place % 64).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")
    )
    every = names.sparkSession.range(ANCHOR_BITS // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    ordered = F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(ordered, lambda x: x["bits"]).alias("f")).scalar()


def _cut(df: DataFrame, column: str, size: int, overlap: int) -> DataFrame:
    """One row per piece of ``size`` characters, each with ``overlap`` more of the next."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(column), F.lit(1)), F.lit(size))
    return df.withColumn(column, F.explode(F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(size + overlap)))))


def map_claim_objects(quotes: DataFrame, products: DataFrame, gram: int = 16, block: int = 1024) -> DataFrame:
    """Product whose name occurs in the quote; longest name, then lowest id.

    ``quotes(claim_id, quote_text)``, ``products(product_id, canonical_name)``.
    An exact text search as an equi-join, for dictionaries of any size. A quote
    gives its grams at every ``step``-th character only, and a name those at its
    first ``step`` characters, so one of them meets wherever the name stands; each
    hit is confirmed on the whole text. The step of a name is the largest of
    ``STEPS`` that leaves it a whole gram; names shorter than ``gram`` use grams
    of their own length. Grams that are no name's, by a bit array of fixed size,
    are dropped where they are made, so that only likely hits are shuffled; the
    array is a value of the plan, not a column. Texts are cut into overlapping
    blocks so that no task holds all grams of a long text, and hits of a frequent
    gram are spread.
    """
    spare = F.length("canonical_name") - F.col("_n") + 1
    step = reduce(lambda acc, s: acc.when(spare >= s, s), STEPS[1:], F.when(spare >= STEPS[0], STEPS[0]))
    named = products.filter(F.length("canonical_name") > 0).withColumn(
        "_n", F.least(F.length("canonical_name"), F.lit(gram))
    ).withColumn("_step", step)
    classes = named.agg(F.collect_set(F.struct("_n", "_step")).alias("s")).scalar()
    names = named.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("_step")))).select(
        "product_id", "canonical_name", F.substring("canonical_name", F.col("_at"), F.col("_n")).alias("_anchor")
    ).distinct()
    pieces = _cut(quotes.select("claim_id", F.col("quote_text").alias("_block")), "_block", 64 * block, gram - 1)
    blocks = _cut(pieces, "_block", block, gram - 1).select("claim_id", "_block", F.inline(classes))
    last = F.least(F.lit(block), F.length("_block") - F.col("_n") + 1)
    place = F.pmod(F.xxhash64("_anchor"), F.lit(ANCHOR_BITS))
    word = F.get(_anchor_filter(names), F.shiftright(place, 6).cast("int"))
    known = F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    grams = blocks.filter(F.length("_block") >= F.col("_n")).withColumn(
        "_at", F.explode(F.sequence(F.lit(1), last, F.col("_step")))
    ).select("claim_id", F.substring("_block", F.col("_at"), F.col("_n")).alias("_anchor")).filter(known).distinct()
    hits = spread_join(grams, names, ["_anchor"], ["claim_id"]).select("claim_id", "product_id", "canonical_name").distinct()
    matched = (
        hits.join(quotes, "claim_id")
        .filter(F.contains("quote_text", "canonical_name"))
        .groupBy("claim_id")
        .agg(
            F.min_by(
                F.struct("product_id", "canonical_name"),
                F.struct(-F.length("canonical_name"), F.col("product_id")),
            ).alias("s")
        )
    )
    return quotes.select("claim_id").join(matched, "claim_id", "left").select(
        "claim_id",
        F.col("s.product_id").alias("object_id"),
        F.col("s.canonical_name").alias("product_name"),
    )


def claim_quality(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Acceptance and grounding rates."""
    linked = links.select("claim_id").distinct().withColumn("_linked", F.lit(1))
    joined = claims.select("claim_id", "claim_status").join(linked, "claim_id", "left")
    accepted = F.col("claim_status") == "ACCEPTED"
    return joined.agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & F.col("_linked").isNotNull()).alias("accepted_grounded"),
    ).select(
        "*",
        F.round(F.col("accepted") / F.col("claims"), 4).alias("acceptance_rate"),
        F.round(F.col("accepted_grounded") / F.col("accepted"), 4).alias("grounding_rate"),
    )


def default_valid_from(claims: DataFrame, years: DataFrame) -> DataFrame:
    """Claims without a start take January 1 of the subject's newest report year."""
    newest = years.groupBy("subject_id").agg(F.max("report_year").alias("_year"))
    start = F.make_date("_year", F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return (
        claims.join(newest, "subject_id", "left")
        .withColumn("valid_from", F.coalesce("valid_from", start))
        .drop("_year")
    )


def first_quote(quotes: DataFrame) -> DataFrame:
    """X18 input: one quote per claim, the first by evidence id."""
    order = Window.partitionBy("claim_id").orderBy("evidence_id")
    return quotes.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
