"""K rows over the event claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.operators import conflicts
from factloom.sources.bindings import Frames

VALUE = """
    SELECT 'VALUE' AS kind, subject_id, predicate_code AS group_key, count(*) AS claims,
           count(DISTINCT coalesce(CAST(object_id AS VARCHAR), object_value, '')) AS variants
    FROM claim GROUP BY 2, 3 HAVING count(DISTINCT coalesce(CAST(object_id AS VARCHAR), object_value, '')) > 1"""
TYPE = """
    SELECT 'TYPE' AS kind, subject_id, predicate_code AS group_key, count(*) AS claims,
           count(DISTINCT CASE WHEN object_id IS NOT NULL THEN coalesce(object_type, '') END) AS variants
    FROM claim GROUP BY 2, 3 HAVING count(DISTINCT CASE WHEN object_id IS NOT NULL THEN coalesce(object_type, '') END) > 1"""
RELATION = """
    SELECT 'RELATION' AS kind, subject_id, CAST(object_id AS VARCHAR) AS group_key, count(*) AS claims,
           count(DISTINCT predicate_code) AS variants
    FROM claim WHERE object_id IS NOT NULL GROUP BY 2, 3 HAVING count(DISTINCT predicate_code) > 1"""
LOGICAL = """
    SELECT 'LOGICAL' AS kind, subject_id, 'DENIES_INVOLVEMENT' AS group_key,
           count(*) FILTER (predicate_code = 'DENIES_INVOLVEMENT' OR business_stage IS NOT NULL) AS claims,
           CAST(2 AS BIGINT) AS variants
    FROM claim GROUP BY 2 HAVING count(*) FILTER (predicate_code = 'DENIES_INVOLVEMENT') > 0
      AND count(*) FILTER (predicate_code <> 'DENIES_INVOLVEMENT' AND business_stage IS NOT NULL) > 0"""


def temporal_sql(kind_key: str, source: str = "claim") -> str:
    """Neighbour test over sorted spans, as plainly as it can be put."""
    return f"""
    SELECT 'TEMPORAL_OVERLAP' AS kind, subject_id, CAST({kind_key} AS VARCHAR) AS group_key, count(*) AS claims,
           CAST(2 AS BIGINT) AS variants
    FROM (SELECT *, lag(t) OVER (PARTITION BY subject_id, {kind_key} ORDER BY f, t) AS before_t FROM (
        SELECT subject_id, {kind_key}, coalesce(business_stage = 'MASS_PRODUCTION', false) AS made,
               evidence_state = 'COMPANY_DENIAL' AS denied,
               valid_from AS f, coalesce(valid_to, TIMESTAMP '9999-12-31 00:00:00') AS t
        FROM {source} WHERE claim_status IN ('ACCEPTED', 'NEEDS_REVIEW')) WHERE made OR denied)
    GROUP BY 2, 3 HAVING bool_or(made) AND bool_or(denied) AND bool_or(f < before_t)"""


@query("k01_value_conflicts", VALUE)
def k01(f: Frames) -> DataFrame:
    return conflicts.value_conflicts(f.claims())


@query("k02_type_conflicts", TYPE)
def k02(f: Frames) -> DataFrame:
    return conflicts.type_conflicts(f.claims())


@query("k03_relation_conflicts", RELATION)
def k03(f: Frames) -> DataFrame:
    return conflicts.relation_conflicts(f.claims())


@query("k04_logical_conflicts", LOGICAL)
def k04(f: Frames) -> DataFrame:
    return conflicts.logical_conflicts(f.claims())


@query("k05_temporal_conflicts", temporal_sql("predicate_code"))
def k05(f: Frames) -> DataFrame:
    return conflicts.temporal_conflicts(f.claims())


@query("k05_temporal_by_object", temporal_sql("object_id"))
def k05b(f: Frames) -> DataFrame:
    return conflicts.temporal_conflicts(f.claims(), ("subject_id", "object_id"))


@query("k05_finding_claims", f"""
    WITH findings AS ({VALUE} UNION ALL {TYPE} UNION ALL {RELATION} UNION ALL {LOGICAL}
        UNION ALL {temporal_sql('predicate_code')})
    SELECT fd.kind, fd.subject_id, count(*) AS pairs, count(DISTINCT c.claim_id) AS claims
    FROM findings fd JOIN claim c ON c.subject_id = fd.subject_id AND (
        (fd.kind IN ('VALUE', 'TYPE') AND c.predicate_code = fd.group_key)
        OR (fd.kind = 'RELATION' AND CAST(c.object_id AS VARCHAR) = fd.group_key)
        OR (fd.kind = 'LOGICAL' AND (c.predicate_code = 'DENIES_INVOLVEMENT' OR c.business_stage IS NOT NULL))
        OR (fd.kind = 'TEMPORAL_OVERLAP' AND c.predicate_code = fd.group_key AND c.claim_status IN ('ACCEPTED', 'NEEDS_REVIEW')
            AND (c.evidence_state = 'COMPANY_DENIAL' OR coalesce(c.business_stage = 'MASS_PRODUCTION', false))))
    GROUP BY 1, 2""")
def k05c(f: Frames) -> DataFrame:
    claims = f.claims()
    return conflicts.finding_claims(claims, conflicts.all_conflicts(claims)).groupBy("kind", "subject_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("claim_id").alias("claims")
    )


LIVE_SET = """live_claim AS (SELECT *, claim_status = 'VALIDATED' AS fresh FROM claim
        WHERE claim_status IN ('ACCEPTED', 'NEEDS_REVIEW', 'VALIDATED')),
    mixed AS (SELECT * REPLACE (CASE WHEN fresh THEN 'NEEDS_REVIEW' ELSE claim_status END AS claim_status) FROM live_claim
        WHERE subject_id IN (SELECT subject_id FROM live_claim WHERE fresh))"""


@query("k06_incoming_conflicts", f"""
    WITH {LIVE_SET},
    findings AS ({VALUE.replace('FROM claim', 'FROM mixed')} UNION ALL {TYPE.replace('FROM claim', 'FROM mixed')}
        UNION ALL {RELATION.replace('FROM claim', 'FROM mixed')} UNION ALL {LOGICAL.replace('FROM claim', 'FROM mixed')}
        UNION ALL {temporal_sql('predicate_code', 'mixed')})
    SELECT c.claim_id, c.subject_id, 'CRITICAL' AS priority, k.reasons
    FROM live_claim c JOIN (SELECT subject_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS reasons FROM findings GROUP BY 1) k
      USING (subject_id) WHERE c.fresh""")
def k06(f: Frames) -> DataFrame:
    claims = f.claims()
    tasks = conflicts.incoming_conflicts(claims.filter("claim_status = 'VALIDATED'"), claims)
    return tasks.select("claim_id", "subject_id", "priority", F.array_join("reason_codes", ",").alias("reasons"))


@query("k07_denial_overlap", """
    WITH side AS (SELECT claim_id, subject_id, object_id, evidence_state = 'COMPANY_DENIAL' AS denial, valid_from AS f,
            coalesce(valid_to, TIMESTAMP '9999-12-31 00:00:00') AS t FROM claim
        WHERE claim_status IN ('ACCEPTED', 'NEEDS_REVIEW') AND object_id IS NOT NULL
          AND (evidence_state IN ('COMPANY_DENIAL', 'REVENUE_DISCLOSED') OR business_stage = 'MASS_PRODUCTION'))
    SELECT a.subject_id, a.object_id, a.claim_id, a.denial, count(*) AS overlaps FROM side a JOIN side b
      ON a.subject_id = b.subject_id AND a.object_id = b.object_id AND a.denial <> b.denial AND a.f < b.t AND b.f < a.t
    GROUP BY 1, 2, 3, 4""")
def k07(f: Frames) -> DataFrame:
    return conflicts.denial_overlap(f.claims()).drop("severity")


@query("k08_conflict_warnings", """
    SELECT subject_id AS company_id, count(*) AS conflicted FROM claim
    WHERE claim_status IN ('CONTRADICTED', 'SUPERSEDED') GROUP BY 1""")
def k08(f: Frames) -> DataFrame:
    return conflicts.conflict_warnings(f.claims())


@query("k09_issuer_conflicts", """
    WITH span AS (SELECT user_id AS security_id, event_type AS company_id, ts AS f,
        CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 5 <> 0 THEN ts + to_hours(CAST(json_extract(props, '$.k') AS INT))
             ELSE ts + to_hours(1) END AS t FROM events)
    SELECT a.security_id, (SELECT count(DISTINCT company_id) FROM span s WHERE s.security_id = a.security_id) AS issuers
    FROM span a JOIN span b ON a.security_id = b.security_id AND a.company_id <> b.company_id AND a.f < b.t AND b.f < a.t
    GROUP BY 1""")
def k09(f: Frames) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    links = f.table("events").select(
        F.col("user_id").alias("security_id"), F.col("event_type").alias("company_id"), F.col("ts").alias("valid_from"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.when(k % 5 != 0, k).otherwise(1))).alias("valid_to"),
    )
    return conflicts.issuer_conflicts(links)


@query("k10_numeric_conflicts", """
    SELECT security_id, period_end, count(*) AS observations, count(DISTINCT value) AS distinct_values,
           CAST(min(value) AS DOUBLE) AS lowest, CAST(max(value) AS DOUBLE) AS highest
    FROM obs GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def k10(f: Frames) -> DataFrame:
    out = conflicts.numeric_conflicts(f.observations())
    return out.select("security_id", "period_end", "observations", "distinct_values",
                      F.col("lowest").cast("double").alias("lowest"), F.col("highest").cast("double").alias("highest"))
