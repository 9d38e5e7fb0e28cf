"""Declared inference rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import classification_only
from factloom.plans.screen import bitemporal_claims

VERIFIED_STAGES = ["SAMPLE_VALIDATION", "SMALL_BATCH", "MASS_PRODUCTION"]
STRONG_STAGES = ["SMALL_BATCH", "MASS_PRODUCTION"]
DISCLOSED = ["PRODUCT_DISCLOSED", "REVENUE_DISCLOSED"]
OPERATING = ["PRODUCES", "DEVELOPS", "HAS_REVENUE_FROM"]
DENIAL_SOURCES = ["EXCHANGE_ANNOUNCEMENT", "INTERACTION_REPLY", "ANNUAL_REPORT"]
EXPOSURES = ["DIRECT_EXPOSURE_TO", "SECOND_ORDER_EXPOSURE_TO", "VERIFIED_RELEVANT_TO"]
PRICE_WORDS = ["STOCK_PRICE_WILL_RISE", "STOCK_PRICE_WILL_FALL", "BUY", "SELL"]


def _active(claims: DataFrame, as_of) -> DataFrame:
    return bitemporal_claims(claims, as_of, as_of, strict=True)


def verified_relevance(
    claims: DataFrame, links: DataFrame, closure: DataFrame, themes: DataFrame, as_of
) -> DataFrame:
    """R1 (R001): accepted product claim whose product reaches a theme within four hops.

    ``themes(product_id, theme, mapping_confidence)``; confidence is the lowest input.
    """
    proven = _active(claims, as_of).filter(
        F.col("predicate_code").isin(OPERATING)
        & (F.col("business_stage").isin(VERIFIED_STAGES) | F.col("evidence_state").isin(DISCLOSED))
    ).join(links.select("claim_id"), "claim_id", "left_semi")
    reach = closure.join(themes.withColumnRenamed("product_id", "ancestor"), "ancestor").groupBy(
        F.col("child").alias("object_id"), "theme"
    ).agg(F.min("hops").alias("hops"), F.max("mapping_confidence").alias("mapping_confidence"))
    return proven.join(reach, "object_id").select(
        "subject_id", F.lit("VERIFIED_RELEVANT_TO").alias("predicate_code"), "theme", "hops", "claim_id",
        F.least("confidence", "mapping_confidence").alias("confidence"),
    )


def classification_annotations(memberships: DataFrame, claims: DataFrame) -> DataFrame:
    """R2 (R002): an annotation, never a claim."""
    return classification_only(memberships, claims).withColumn("annotation", F.lit("CLASSIFICATION_ONLY"))


def direct_exposure(relevance: DataFrame, max_hops: int = 1) -> DataFrame:
    """R3 (R003)."""
    return (
        relevance.filter(F.col("hops") <= max_hops)
        .groupBy("subject_id", "theme")
        .agg(F.count_distinct("claim_id").alias("input_claims"), F.max("confidence").alias("confidence"))
        .withColumn("predicate_code", F.lit("DIRECT_EXPOSURE_TO"))
    )


def second_order_exposure(
    claims: DataFrame, links: DataFrame, components: DataFrame, themes: DataFrame, as_of
) -> DataFrame:
    """R4 (R004): produced in batches, and two or three component hops away from a theme.

    ``components(child, ancestor, hops)``.
    """
    strong = _active(claims, as_of).filter(
        (F.col("predicate_code") == "PRODUCES") & F.col("business_stage").isin(STRONG_STAGES)
    ).join(links.select("claim_id"), "claim_id", "left_semi")
    reach = (
        components.filter(F.col("hops").between(2, 3))
        .join(themes.select(F.col("product_id").alias("ancestor"), "theme"), "ancestor")
        .select(F.col("child").alias("object_id"), "theme")
        .distinct()
    )
    return strong.join(reach, "object_id").groupBy("subject_id", "theme").agg(
        F.count_distinct("claim_id").alias("input_claims")
    ).withColumn("predicate_code", F.lit("SECOND_ORDER_EXPOSURE_TO"))


def normalized_denials(claims: DataFrame, links: DataFrame, fragments: DataFrame, docs: DataFrame, as_of) -> DataFrame:
    """R5 (R006): denials proven by an authoritative source type."""
    denials = _active(claims, as_of).filter(F.col("predicate_code") == "DENIES_INVOLVEMENT")
    trail = (
        denials.join(links.select("claim_id", "evidence_id"), "claim_id")
        .join(fragments.select("evidence_id", "document_id"), "evidence_id")
        .join(docs.filter(F.col("document_type").isin(DENIAL_SOURCES)).select("document_id", "document_type"), "document_id")
    )
    return trail.groupBy("claim_id", "subject_id").agg(
        F.min("document_type").alias("document_type"), F.count(F.lit(1)).alias("evidence")
    ).withColumn("evidence_state", F.lit("COMPANY_DENIAL"))


def holdings_without_control(holdings: DataFrame, claims: DataFrame) -> DataFrame:
    """R6 (R008): holders without an accepted control claim; holding never implies control."""
    control = claims.filter(
        (F.col("predicate_code") == "CONTROLS") & (F.col("claim_status") == "ACCEPTED")
    ).select(F.col("subject_id").alias("holder_name"), F.col("object_id").alias("security_id"))
    return holdings.join(control, ["holder_name", "security_id"], "left_anti").withColumn(
        "prohibited_inference", F.lit("CONTROLS")
    )


def evidence_insufficient(companies: DataFrame, claims: DataFrame) -> DataFrame:
    """R7 (R009): neither an accepted claim nor a denial: unknown, not false."""
    affirmed = claims.filter(F.col("claim_status") == "ACCEPTED").select(F.col("subject_id").alias("id"))
    denied = claims.filter(F.col("predicate_code") == "DENIES_INVOLVEMENT").select(
        F.col("subject_id").alias("id")
    )
    return (
        companies.join(affirmed, "id", "left_anti")
        .join(denied, "id", "left_anti")
        .withColumn("annotation", F.lit("EVIDENCE_INSUFFICIENT"))
    )


def prohibited_inferences(claims: DataFrame) -> DataFrame:
    """R8 (R010, R011): ``claims`` with ``input_predicate``, ``input_evidence_state`` of their source."""
    upgraded: Column = (
        (F.col("input_predicate") == "TAGGED_AS")
        & (F.col("input_evidence_state") == "PLATFORM_CLASSIFICATION_ONLY")
        & (
            F.col("predicate_code").isin(OPERATING)
            | F.col("business_stage").isin(VERIFIED_STAGES)
            | F.col("evidence_state").isin(DISCLOSED)
        )
    )
    priced = F.col("input_predicate").isin(EXPOSURES) & F.col("predicate_code").isin(PRICE_WORDS)
    return claims.withColumn(
        "violation",
        F.when(F.coalesce(upgraded, F.lit(False)), "R010_PLATFORM_TAG_IS_NOT_PRODUCTION").when(
            F.coalesce(priced, F.lit(False)), "R011_NO_PRICE_DIRECTION_INFERENCE"
        ),
    ).filter(F.col("violation").isNotNull())


def stamp_inference(df: DataFrame, rule_id: str, version: str, at, ttl_hours: int = 24) -> DataFrame:
    """Inferred rows carry rule, version and expiry."""
    inferred = F.lit(at).cast("timestamp_ntz")
    return df.withColumns(
        {
            "rule_id": F.lit(rule_id),
            "rule_version": F.lit(version),
            "fact_layer": F.lit("INFERRED_FACT"),
            "expires_at": inferred + F.make_dt_interval(F.lit(0), F.lit(ttl_hours)),
        }
    )
