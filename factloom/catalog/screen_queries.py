"""Q rows: the screen over customers, order history, event claims and conversation evidence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.operators.graph import business_edges, membership_edges
from factloom.plans import screen as q
from factloom.plans.model import NumericFilter, QueryPlan
from factloom.sources.bindings import Frames

AS_OF = dt.datetime(2024, 1, 20)
KNOWN = dt.datetime(2024, 1, 25)
NUMERIC = NumericFilter("NET_CF_OPERATING", "TOTAL_POSITIVE", 3, -200000)
PLAN = QueryPlan(numeric=NUMERIC, as_of=AS_OF, known_at=KNOWN, max_results=100)
STAGE_PLAN = QueryPlan(business_stage="MASS_PRODUCTION", evidence_required=False, max_results=100)

LIVE = """
    live AS (SELECT * FROM claim WHERE claim_status = 'ACCEPTED'
        AND valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')
        AND recorded_at <= TIMESTAMP '2024-01-25'),
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at DESC, claim_id) AS n
        FROM live)),
    per_company AS (SELECT subject_id AS company_id, count(*) AS claims_loaded,
        string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY n) FILTER (n <= 5) AS claim_ids,
        min_by(coalesce(business_stage, '-'), n) AS business_stage, min_by(evidence_state, n) AS evidence_state,
        min_by(valid_from, n) AS valid_from FROM ranked GROUP BY 1),
    fin AS (SELECT company_id, count(*) AS years, max(available) AS available, CAST(sum(value) AS DOUBLE) AS value,
        CASE WHEN min(period_end) = max(period_end) THEN CAST(max(period_end) AS VARCHAR)
             ELSE concat(min(period_end), '..', max(period_end)) END AS report_period,
        max_by(currency, period_end) FILTER (currency IS NOT NULL) AS currency
        FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY period_end DESC) AS rk,
                     count(*) OVER (PARTITION BY company_id) AS available
              FROM (SELECT company_id, period_end, value, currency,
                           row_number() OVER (PARTITION BY company_id, period_end ORDER BY announced_at DESC, security_id, id) AS rn
                    FROM fy_current JOIN links USING (security_id)
                    WHERE period_end <= DATE '2024-01-20' AND announced_at <= TIMESTAMP '2024-01-25') WHERE rn = 1)
        WHERE rk <= 3 GROUP BY 1),
    judged AS (SELECT d.company_id, coalesce(c.canonical_name, 'Unknown') AS company_name, p.*  EXCLUDE (company_id), fin.* EXCLUDE (company_id),
        CASE WHEN p.claims_loaded IS NULL THEN 'no matching claims'
             WHEN fin.years IS NULL THEN 'no financial observations for metric NET_CF_OPERATING'
             WHEN fin.years <> 3 THEN concat('insufficient financial data (insufficient_complete_fiscal_years: ', fin.available,
                  ' complete FY, need 3)')
             WHEN NOT fin.value > -200000 THEN concat('financial filter not passed (TOTAL_POSITIVE=', ntext(fin.value), ')') END AS exclusion
        FROM (SELECT DISTINCT subject_id AS company_id FROM claim WHERE claim_status = 'ACCEPTED') d
        LEFT JOIN company c ON c.id = d.company_id LEFT JOIN per_company p ON p.company_id = d.company_id
        LEFT JOIN fin ON fin.company_id = d.company_id),
    evidence AS (SELECT r.subject_id AS company_id, r.n, f.evidence_id, row_number() OVER (PARTITION BY r.claim_id ORDER BY f.evidence_id) AS e
        FROM ranked r JOIN ev_link k USING (claim_id) JOIN fragment f USING (evidence_id)),
    proof AS (SELECT company_id, count(*) AS evidence_count,
        string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY n, e) FILTER (p <= 5) AS evidence_ids
        FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n, e) AS p FROM evidence ) GROUP BY 1)
""".replace("ntext(fin.value)", "regexp_replace(regexp_replace(CAST(CAST(fin.value AS DECIMAL(38,6)) AS VARCHAR), '0+$', ''), '\\.$', '.0')")


def _text(col: str) -> Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",").alias(col)


@query("q01_bitemporal_claims", """
    SELECT claim_id, subject_id, valid_from, valid_to, recorded_at FROM claim WHERE claim_status = 'ACCEPTED'
      AND valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')
      AND recorded_at <= TIMESTAMP '2024-01-25'""")
def q01(f: Frames) -> DataFrame:
    return q.bitemporal_claims(f.claims(), AS_OF, KNOWN).select(
        "claim_id", "subject_id", "valid_from", "valid_to", "recorded_at"
    )


@query("q02_bitemporal_strict", """
    SELECT claim_id FROM claim WHERE claim_status = 'ACCEPTED' AND recorded_at <= TIMESTAMP '2024-01-25'
      AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '2024-01-25')""")
def q02(f: Frames) -> DataFrame:
    return q.bitemporal_claims(f.claims(), None, KNOWN, strict=True).select("claim_id")


@query("q03_candidates_graph", """
    SELECT DISTINCT subject_id AS company_id, 'graph' AS source FROM claim
    WHERE claim_status = 'ACCEPTED' AND predicate_code = 'PRODUCES' AND object_id IS NOT NULL
      AND business_stage = 'MASS_PRODUCTION'""")
def q03(f: Frames) -> DataFrame:
    edges = business_edges(f.claims())
    nodes = f.company().select("id", F.lit("Company").alias("label"), "canonical_name")
    ids, source, _ = q.candidates(STAGE_PLAN, f.claims(), (nodes, edges))
    return ids.select("company_id", F.lit(source).alias("source"))


@query("q03_candidates_stale_graph", """
    SELECT DISTINCT subject_id AS company_id, 'pg-stale' AS source FROM claim
    WHERE claim_status = 'ACCEPTED' AND business_stage = 'MASS_PRODUCTION'""")
def q03b(f: Frames) -> DataFrame:
    edges = business_edges(f.claims()).withColumn("active", F.lit(False))
    nodes = f.company().select("id", F.lit("Company").alias("label"), "canonical_name")
    ids, source, _ = q.candidates(STAGE_PLAN, f.claims(), (nodes, edges))
    return ids.select("company_id", F.lit(source).alias("source"))


CONCEPT_PLAN = QueryPlan(concept_name="2-HIGH", numeric=NUMERIC, as_of=AS_OF, known_at=KNOWN, max_results=100)


def _concept_graph(f: Frames) -> tuple[DataFrame, DataFrame]:
    """Companies tagged with the priorities of their orders."""
    nodes = f.table("orders").selectExpr("o_orderpriority AS id", "'Concept' AS label", "o_orderpriority AS canonical_name").distinct()
    return nodes, membership_edges(f.table("orders").selectExpr(
        "o_custkey AS src", "o_orderpriority AS dst", "CAST(o_orderdate AS DATE) AS snapshot_date"), "TAGGED_AS")


@query("q03_candidates_concept", """
    SELECT DISTINCT o_custkey AS company_id, 'graph' AS source FROM orders WHERE o_orderpriority = '2-HIGH'""")
def q03c(f: Frames) -> DataFrame:
    ids, source, _ = q.candidates(CONCEPT_PLAN, f.claims(), _concept_graph(f))
    return ids.select("company_id", F.lit(source).alias("source"))


@query("q03_candidates_without_graph", """
    SELECT DISTINCT subject_id AS company_id, 'pg-unavailable' AS source FROM claim
    WHERE claim_status = 'ACCEPTED' AND business_stage = 'MASS_PRODUCTION'""")
def q03d(f: Frames) -> DataFrame:
    """Stage candidates come from the tables; a concept without a graph brings none, not all."""
    ids, source, _ = q.candidates(STAGE_PLAN, f.claims())
    none, other, _ = q.candidates(CONCEPT_PLAN, f.claims())
    return ids.select("company_id", F.lit(source).alias("source")).unionByName(none.select("company_id", F.lit(other).alias("source")))


@query("q04_exclusion_reasons", f"WITH {LIVE} SELECT company_id, company_name, exclusion AS reason FROM judged WHERE exclusion IS NOT NULL")
def q04(f: Frames) -> DataFrame:
    return q.screen(f.screen_tables(), PLAN).excluded.select("company_id", "company_name", "reason")


@query("q05_unknowns", f"""WITH {LIVE}
    SELECT j.company_id, concat(j.company_name, ': claim without evidence (excluded from results)') AS message
    FROM judged j LEFT JOIN proof USING (company_id) WHERE exclusion IS NULL AND evidence_count IS NULL""")
def q05(f: Frames) -> DataFrame:
    return q.screen(f.screen_tables(), PLAN).unknowns.select("company_id", "message")


@query("q06_top_evidence", """
    SELECT claim_id, evidence_id, page_number, rn FROM (
        SELECT k.claim_id, f.evidence_id, f.page_number, row_number() OVER (PARTITION BY k.claim_id ORDER BY f.evidence_id) AS rn
        FROM claim c JOIN ev_link k USING (claim_id) JOIN fragment f USING (evidence_id)) WHERE rn <= 5""")
def q06(f: Frames) -> DataFrame:
    ranked = f.claims().select("claim_id", "subject_id", F.lit(1).alias("_n"))
    return q.top_evidence(ranked, f.claim_evidence(), f.fragments()).select(
        "claim_id", "evidence_id", "page_number", F.col("_e").alias("rn")
    )


@query("q07_display_fields", """
    SELECT c.id AS company_id, s.security_code, p.standard_product FROM company c
    LEFT JOIN (SELECT company_id, min(ts_code) AS security_code FROM links JOIN security USING (security_id) GROUP BY 1) s
      ON s.company_id = c.id
    LEFT JOIN (SELECT subject_id, arg_min(canonical_name, n) AS standard_product FROM (
        SELECT k.subject_id, k.object_id, row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at DESC, claim_id) AS n
        FROM claim k WHERE claim_status = 'ACCEPTED') JOIN product ON product_id = object_id WHERE n <= 100 GROUP BY 1) p
      ON p.subject_id = c.id""")
def q07(f: Frames) -> DataFrame:
    ranked = q.ranked_claims(q.bitemporal_claims(f.claims()), 100)
    ids = f.company().select(F.col("id").alias("company_id"))
    return q.display_fields(ids, f.links(), f.securities(), ranked, f.products())


RESULTS = f"""WITH {LIVE},
    shown AS (SELECT * FROM judged JOIN proof USING (company_id) WHERE exclusion IS NULL ORDER BY company_id LIMIT 100)
    SELECT company_id, company_name, claim_ids, business_stage, evidence_state, valid_from,
           value AS financial_value, report_period, currency, evidence_ids, evidence_count,
           s.security_code, p.standard_product, 'pg' AS data_freshness,
           concat('PG candidates (no graph query required) | financial filter applied: metric=NET_CF_OPERATING operator=TOTAL_POSITIVE window=3FY period_rule=LAST_3_FY_TOTAL_POSITIVE -> value=',
               regexp_replace(regexp_replace(CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR), '0+$', ''), '\\.$', '.0'),
               ' passed=True | claims loaded: ', claims_loaded, ' (ACCEPTED, as_of/known_at applied) | evidence attached: ', evidence_count) AS reasoning
    FROM shown
    LEFT JOIN (SELECT company_id, min(ts_code) AS security_code FROM links JOIN security USING (security_id) GROUP BY 1) s USING (company_id)
    LEFT JOIN (SELECT subject_id AS company_id, arg_min(canonical_name, n) AS standard_product FROM ranked
        JOIN product ON product_id = object_id GROUP BY 1) p USING (company_id)"""


def _shown(out: DataFrame) -> DataFrame:
    attached = F.regexp_extract(F.element_at("reasoning_path", -1), r"(\d+)$", 1).cast("bigint")
    return out.select(
        "company_id", "company_name", "security_code", "standard_product", _text("claim_ids"),
        F.coalesce("business_stage", F.lit("-")).alias("business_stage"), "evidence_state", "valid_from",
        "financial_value", "report_period", "currency", _text("evidence_ids"),
        attached.alias("evidence_count"), "data_freshness",
        F.array_join("reasoning_path", " | ").alias("reasoning"),
    )


@query("q10_screen_results", RESULTS)
def q10(f: Frames) -> DataFrame:
    return _shown(q.screen(f.screen_tables(), PLAN).results)


@query("q10_screen_by_concept", RESULTS.replace(
    "(SELECT DISTINCT subject_id AS company_id FROM claim WHERE claim_status = 'ACCEPTED') d",
    "(SELECT DISTINCT o_custkey AS company_id FROM orders WHERE o_orderpriority = '2-HIGH') d",
).replace("'pg' AS data_freshness", "'graph+pg' AS data_freshness").replace(
    "PG candidates (no graph query required)", "graph concept filter applied: 2-HIGH"))
def q10b(f: Frames) -> DataFrame:
    tables = f.screen_tables()
    tables["nodes"], tables["edges"] = _concept_graph(f)
    return _shown(q.screen(tables, CONCEPT_PLAN).results)


@query("q08_grounded_results", f"""WITH {LIVE},
    shown AS (SELECT * FROM judged JOIN proof USING (company_id) WHERE exclusion IS NULL ORDER BY company_id LIMIT 100)
    SELECT company_id, CAST(count(*) AS BIGINT) AS quotes, sum(length(quote_text)) AS quote_chars FROM (
        SELECT e.company_id, f.quote_text, row_number() OVER (PARTITION BY e.company_id ORDER BY n, e) AS p
        FROM evidence e JOIN shown USING (company_id) JOIN fragment f USING (evidence_id))
    WHERE p <= 5 GROUP BY 1""")
def q08(f: Frames) -> DataFrame:
    out = q.screen(f.screen_tables(), PLAN).results
    chars = F.aggregate("evidence_quotes", F.lit(0), lambda a, e: a + F.length(e["quote_text"]))
    return out.select(
        "company_id", F.size("evidence_quotes").cast("bigint").alias("quotes"), chars.cast("bigint").alias("quote_chars")
    )


@query("q09_reasoning_path", """
    SELECT company_id, 'graph stage filter applied: MASS_PRODUCTION' AS step_1,
           concat('claims loaded: ', n, ' (ACCEPTED, as_of/known_at applied)') AS step_2
    FROM (SELECT subject_id AS company_id, count(*) AS n FROM claim
          WHERE claim_status = 'ACCEPTED' AND subject_id IN (SELECT subject_id FROM claim WHERE claim_status = 'ACCEPTED'
            AND predicate_code = 'PRODUCES' AND object_id IS NOT NULL AND business_stage = 'MASS_PRODUCTION') GROUP BY 1)
    ORDER BY company_id LIMIT 100""")
def q09(f: Frames) -> DataFrame:
    tables = f.screen_tables()
    tables["edges"] = business_edges(tables["claims"])
    tables["nodes"] = f.company().select("id", F.lit("Company").alias("label"), "canonical_name")
    out = q.screen(tables, STAGE_PLAN).results
    return out.select(
        "company_id", F.get("reasoning_path", F.lit(0)).alias("step_1"), F.get("reasoning_path", F.lit(1)).alias("step_2")
    )


@query("q10_screen_conflicts", f"""WITH {LIVE}
    SELECT j.company_id, concat(j.company_name, ': ', w.conflicted,
        ' contradicted/superseded claim(s) present - results carry this warning') AS message
    FROM judged j JOIN proof USING (company_id)
    JOIN (SELECT subject_id, count(*) AS conflicted FROM claim WHERE claim_status IN ('CONTRADICTED', 'SUPERSEDED') GROUP BY 1) w
      ON w.subject_id = j.company_id
    WHERE exclusion IS NULL""")
def q10c(f: Frames) -> DataFrame:
    return q.screen(f.screen_tables(), PLAN).conflicts.select("company_id", "message")


ENDS = """
    ends AS (SELECT concat('customer:', min(c_custkey)) AS a, concat('customer:', max(c_custkey)) AS b FROM customer)"""


def _ends(f: Frames) -> tuple[str, str]:
    row = f.table("customer").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).first()
    return f"customer:{row.a}", f"customer:{row.b}"


@query("q11_explain_relation", f"""WITH {ENDS},
    h1 AS (SELECT e.src AS s, e.dst AS n1, e.edge_id AS e1, e.rel_type AS r1 FROM trade_und e JOIN ends ON e.src = ends.a),
    h2 AS (SELECT h1.*, e.dst AS n2, e.edge_id AS e2, e.rel_type AS r2 FROM h1 JOIN trade_und e ON e.src = n1 AND e.edge_id <> e1),
    g1 AS (SELECT e.dst AS m1, e.edge_id AS d1, e.rel_type AS q1 FROM trade_und e JOIN ends ON e.src = ends.b),
    g2 AS (SELECT g1.*, e.dst AS m2, e.edge_id AS d2, e.rel_type AS q2 FROM g1 JOIN trade_und e ON e.src = m1 AND e.edge_id <> d1)
    SELECT 4 AS hops, concat('graph path: ', s, ' - -[', r1, ']-> - ', n1, ' - -[', r2, ']-> - ', n2, ' - -[', q2, ']-> - ', m1,
           ' - -[', q1, ']-> - ', (SELECT b FROM ends), ' (4 hops)') AS reasoning
    FROM h2 JOIN g2 ON n2 = m2 AND e1 <> d1 AND e1 <> d2 AND e2 <> d1 AND e2 <> d2
    ORDER BY [s, n1, n2, m1, (SELECT b FROM ends)], [e1, e2, d2, d1] LIMIT 1""")
def q11(f: Frames) -> DataFrame:
    a, b = _ends(f)
    tables = {"edges": f.trade_edges(), "company": f.trade_nodes(), "claims": f.claims().withColumn(
        "subject_id", F.concat(F.lit("customer:"), F.col("subject_id").cast("string")))}
    plan = QueryPlan(intent="EXPLAIN_RELATION", subject_id=a, object_id=b, max_hops=4)
    path, _ = q.explain_relation(tables, plan)
    return path


@query("q11_explain_ends", f"""WITH {ENDS}
    SELECT n.id AS subject_id, n.canonical_name, c.business_stage, c.claims FROM trade_node n JOIN ends ON n.id IN (ends.a, ends.b)
    LEFT JOIN (SELECT concat('customer:', subject_id) AS subject_id, arg_min(coalesce(business_stage, '-'), n) AS business_stage, count(*) AS claims FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at DESC, claim_id) AS n FROM claim WHERE claim_status = 'ACCEPTED')
        WHERE n <= 5 GROUP BY 1) c ON c.subject_id = n.id""")
def q11b(f: Frames) -> DataFrame:
    a, b = _ends(f)
    claims = f.claims().withColumn("subject_id", F.concat(F.lit("customer:"), F.col("subject_id").cast("string")))
    tables = {"edges": f.trade_edges(), "company": f.trade_nodes(),
              "claims": claims.withColumn("business_stage", F.coalesce("business_stage", F.lit("-")))}
    plan = QueryPlan(intent="EXPLAIN_RELATION", subject_id=a, object_id=b, max_hops=4)
    return q.explain_relation(tables, plan)[1]


@query("q12_entity_lookup", "SELECT id, canonical_name FROM company WHERE id = (SELECT max(user_id) FROM events)")
def q12(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id")).scalar()
    return q.entity_lookup({"company": f.company()}, wanted)


@query("q13_compare", f"""
    SELECT c.id AS company_id, c.canonical_name, k.accepted_claims, k.newest_stage, v.value, v.passed FROM company c
    LEFT JOIN (SELECT subject_id, count(*) AS accepted_claims,
                      coalesce(first(business_stage ORDER BY recorded_at DESC, claim_id DESC), '-') AS newest_stage
               FROM claim WHERE claim_status = 'ACCEPTED' GROUP BY 1) k ON k.subject_id = c.id
    LEFT JOIN (SELECT company_id, CASE WHEN count(*) = 3 THEN CAST(sum(value) AS DOUBLE) END AS value,
                      count(*) = 3 AND sum(value) > 0 AS passed FROM fy_ranked WHERE fy_rank <= 3 GROUP BY 1) v ON v.company_id = c.id
    WHERE c.id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 5)""")
def q13(f: Frames) -> DataFrame:
    top = f.table("events").groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(5)
    ids = [r.user_id for r in top.collect()]
    tables = f.screen_tables()
    tables["claims"] = tables["claims"].withColumn("business_stage", F.coalesce("business_stage", F.lit("-")))
    return q.compare(tables, ids, QueryPlan(numeric=NumericFilter("NET_CF_OPERATING"))).drop("report_period")


@query("q13_search_evidence", """
    SELECT evidence_id, document_id, CAST(contains(lower(quote_text), 'ther') AS INT) + CAST(contains(lower(quote_text), 'oua') AS INT)
        + CAST(contains(lower(quote_text), 'tion') AS INT) AS score FROM fragment
    WHERE contains(lower(quote_text), 'ther') OR contains(lower(quote_text), 'oua') OR contains(lower(quote_text), 'tion')
    ORDER BY score DESC, evidence_id LIMIT 50""")
def q13b(f: Frames) -> DataFrame:
    return q.search_evidence(f.fragments(), "ther OUA tion", 50)


@query("q14_audit_dedup", """
    SELECT user_id AS query_id, arg_min(event_id, (ts, event_id)) AS audit_id, arg_min(event_type, (ts, event_id)) AS plan,
           count(*) AS records, count(DISTINCT event_type) > 1 AS plan_conflict FROM events GROUP BY 1""")
def q14(f: Frames) -> DataFrame:
    audit = f.table("events").selectExpr("user_id AS query_id", "event_id AS audit_id", "event_type AS plan", "ts AS created_at")
    return q.dedup_audit(audit).drop("created_at")


@query("q15_response_status", """
    SELECT event_id AS query_id, CASE WHEN event_type = 'error' THEN 'REJECTED' WHEN event_type = 'signup' THEN 'FAILED'
        WHEN value > 30 THEN 'DEGRADED' ELSE 'SUCCEEDED' END AS status FROM events""")
def q15(f: Frames) -> DataFrame:
    runs = f.table("events").selectExpr(
        "event_id AS query_id",
        "CASE event_type WHEN 'error' THEN 'plan_validation' WHEN 'signup' THEN 'query_timeout' END AS error_category",
        "CASE WHEN value > 30 THEN 'pg-stale' ELSE 'graph' END AS candidate_source",
    )
    return q.response_status(runs).select("query_id", "status")


@query("q16_plan_key", """
    SELECT count(DISTINCT (upper(trim(event_type)), user_id)) AS keys, count(*) AS plans FROM events""")
def q16(f: Frames) -> DataFrame:
    plans = f.table("events").select(
        F.col("event_id").alias("query_id"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type")).alias("intent"),
        "user_id",
    )
    keyed = q.plan_key(plans, {"ontology": "0.1.0"})
    return keyed.agg(F.count_distinct("plan_key").alias("keys"), F.count(F.lit(1)).alias("plans"))
