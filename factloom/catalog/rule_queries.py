"""R rows over event claims, the part taxonomy and conversation evidence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.graph_queries import THEMES, brand_claims, themes
from factloom.catalog.registry import query
from factloom.functions.clean import LONG_TS_CODE
from factloom.operators import graph as g
from factloom.operators import rules as r
from factloom.operators.standardize import holdings
from factloom.sources.bindings import Frames

AS_OF = dt.datetime(2024, 1, 28)
ACTIVE = """act AS (SELECT *, concat('brand:', object_id) AS brand FROM claim WHERE claim_status = 'ACCEPTED'
    AND valid_from <= TIMESTAMP '2024-01-28' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-28')
    AND recorded_at <= TIMESTAMP '2024-01-28' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '2024-01-28'))"""
RELEVANT = f"""{THEMES}, {ACTIVE},
    rel AS (SELECT a.subject_id, t.theme, c.hops, a.claim_id, least(a.confidence, CAST(0.9 AS DOUBLE)) AS confidence FROM act a
        JOIN closure c ON c.child = a.brand JOIN theme t ON t.product_id = c.ancestor
        WHERE a.object_id IS NOT NULL AND predicate_code IN ('PRODUCES', 'DEVELOPS', 'HAS_REVENUE_FROM')
          AND (business_stage IN ('SAMPLE_VALIDATION', 'SMALL_BATCH', 'MASS_PRODUCTION') OR evidence_state IN ('PRODUCT_DISCLOSED', 'REVENUE_DISCLOSED'))
          AND a.claim_id IN (SELECT claim_id FROM live_link))"""


def _relevance(f: Frames) -> DataFrame:
    mapped = themes(f).withColumn("mapping_confidence", F.lit(0.9).cast("double"))
    closure = g.taxonomy_closure(f.taxonomy(), to=mapped.select(F.col("product_id").alias("ancestor")))
    return r.verified_relevance(brand_claims(f), f.live_links(), closure, mapped, AS_OF)


@query("r01_verified_relevance", f"WITH {RELEVANT} SELECT subject_id, theme, hops, claim_id, confidence FROM rel")
def r01(f: Frames) -> DataFrame:
    return _relevance(f).drop("predicate_code")


@query("r02_classification_annotations", """
    SELECT o_custkey AS company_id, 'CLASSIFICATION_ONLY' AS annotation FROM orders
    WHERE o_custkey NOT IN (SELECT subject_id FROM claim WHERE claim_status = 'ACCEPTED'
        AND predicate_code IN ('PRODUCES', 'DEVELOPS', 'HAS_REVENUE_FROM')) GROUP BY 1""")
def r02(f: Frames) -> DataFrame:
    members = f.table("orders").selectExpr("o_custkey AS company_id", "o_orderpriority AS concept_id")
    return r.classification_annotations(members, f.claims()).select("company_id", "annotation")


@query("r03_direct_exposure", f"""WITH {RELEVANT}
    SELECT subject_id, theme, count(DISTINCT claim_id) AS input_claims, max(confidence) AS confidence FROM rel WHERE hops <= 1 GROUP BY 1, 2""")
def r03(f: Frames) -> DataFrame:
    return r.direct_exposure(_relevance(f)).drop("predicate_code")


@query("r04_second_order_exposure", f"""WITH {ACTIVE}
    SELECT subject_id, 'root:goods' AS theme, count(DISTINCT claim_id) AS input_claims FROM act
    WHERE predicate_code = 'PRODUCES' AND business_stage IN ('SMALL_BATCH', 'MASS_PRODUCTION') AND claim_id IN (SELECT claim_id FROM live_link)
      AND brand IN (SELECT child FROM closure WHERE ancestor = 'root:goods' AND hops BETWEEN 2 AND 3) GROUP BY 1""")
def r04(f: Frames) -> DataFrame:
    root = f.taxonomy().filter("parent = 'root:goods'").select(F.col("parent").alias("product_id"), F.col("parent").alias("theme")).distinct()
    closure = g.taxonomy_closure(f.taxonomy(), to=root.select(F.col("product_id").alias("ancestor")))
    return r.second_order_exposure(brand_claims(f), f.live_links(), closure, root, AS_OF).drop("predicate_code")


@query("r05_normalized_denials", f"""WITH {ACTIVE}
    SELECT a.claim_id, a.subject_id, count(*) AS evidence FROM act a JOIN ev_link k USING (claim_id) JOIN fragment f USING (evidence_id)
    JOIN documents d ON d.doc_id = f.document_id WHERE predicate_code = 'DENIES_INVOLVEMENT' AND d.lang IN ('en', 'fr') GROUP BY 1, 2""")
def r05(f: Frames) -> DataFrame:
    docs = f.table("documents").selectExpr(
        "doc_id AS document_id", "CASE lang WHEN 'en' THEN 'ANNUAL_REPORT' WHEN 'fr' THEN 'INTERACTION_REPLY' ELSE 'BLOG' END AS document_type"
    )
    return r.normalized_denials(f.claims(), f.claim_evidence(), f.fragments(), docs, AS_OF).select("claim_id", "subject_id", "evidence")


@query("r06_holdings_without_control", """
    WITH h AS (SELECT security_id, holder_name, count(*) AS n FROM (SELECT DISTINCT security_id, holder_name, end_date, hold_ratio FROM hold_row
        WHERE holder_name IS NOT NULL) GROUP BY 1, 2)
    SELECT h.*, 'CONTROLS' AS prohibited_inference FROM h WHERE (holder_name, security_id) NOT IN (
        SELECT (s_name, o_custkey) FROM orders JOIN supplier ON s_suppkey = o_orderkey % 97 WHERE o_orderstatus = 'F')""")
def r06(f: Frames) -> DataFrame:
    held, _ = holdings(f.raw_holders(), f.securities(), code_form=LONG_TS_CODE)
    grouped = held.groupBy("security_id", "holder_name").agg(F.count(F.lit(1)).alias("n"))
    control = (
        f.table("orders").join(f.table("supplier"), F.expr("s_suppkey = o_orderkey % 97"))
        .selectExpr("s_name AS subject_id", "o_custkey AS object_id", "'CONTROLS' AS predicate_code",
                    "CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' ELSE 'REJECTED' END AS claim_status")
    )
    return r.holdings_without_control(grouped, control)


@query("r07_evidence_insufficient", """
    SELECT id, 'EVIDENCE_INSUFFICIENT' AS annotation FROM company
    WHERE id NOT IN (SELECT subject_id FROM claim WHERE claim_status = 'ACCEPTED' OR predicate_code = 'DENIES_INVOLVEMENT')""")
def r07(f: Frames) -> DataFrame:
    return r.evidence_insufficient(f.company(), f.claims()).select("id", "annotation")


@query("r08_prohibited_inferences", """
    SELECT claim_id, CASE WHEN k % 3 = 0 AND (predicate_code IN ('PRODUCES', 'DEVELOPS', 'HAS_REVENUE_FROM')
            OR business_stage IN ('SAMPLE_VALIDATION', 'SMALL_BATCH', 'MASS_PRODUCTION') OR evidence_state IN ('PRODUCT_DISCLOSED', 'REVENUE_DISCLOSED'))
        THEN 'R010_PLATFORM_TAG_IS_NOT_PRODUCTION' ELSE 'R011_NO_PRICE_DIRECTION_INFERENCE' END AS violation
    FROM claim WHERE (k % 3 = 0 AND (predicate_code IN ('PRODUCES', 'DEVELOPS', 'HAS_REVENUE_FROM')
            OR business_stage IN ('SAMPLE_VALIDATION', 'SMALL_BATCH', 'MASS_PRODUCTION') OR evidence_state IN ('PRODUCT_DISCLOSED', 'REVENUE_DISCLOSED')))
        OR (k % 3 = 1 AND predicate_code = 'SUPPLIES_TO')""")
def r08(f: Frames) -> DataFrame:
    claims = f.claims().selectExpr(
        "claim_id", "k", "business_stage", "evidence_state",
        "CASE k % 3 WHEN 0 THEN 'TAGGED_AS' WHEN 1 THEN 'DIRECT_EXPOSURE_TO' ELSE 'PRODUCES' END AS input_predicate",
        "'PLATFORM_CLASSIFICATION_ONLY' AS input_evidence_state",
        "CASE WHEN predicate_code = 'SUPPLIES_TO' AND k % 3 = 1 THEN 'BUY' ELSE predicate_code END AS predicate_code",
    )
    return r.prohibited_inferences(claims).select("claim_id", "violation")


@query("r09_stamp_inference", f"""WITH {RELEVANT}
    SELECT subject_id, claim_id, theme, 'R001' AS rule_id, '0.1.1' AS rule_version, TIMESTAMP '2024-01-29 00:00:00' AS expires_at FROM rel""")
def r09(f: Frames) -> DataFrame:
    return r.stamp_inference(_relevance(f), "R001", "0.1.1", AS_OF).select(
        "subject_id", "claim_id", "theme", "rule_id", "rule_version", "expires_at"
    )
