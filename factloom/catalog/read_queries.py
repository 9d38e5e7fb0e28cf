"""T rows: read models and operational aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.claim_queries import _quotes
from factloom.catalog.registry import query
from factloom.operators import claims as x
from factloom.operators import readmodels as t
from factloom.sources.bindings import Frames

LIST = """staged AS (SELECT id, canonical_name FROM company WHERE contains(lower(canonical_name), '00000')
    AND id IN (SELECT subject_id FROM claim WHERE claim_status = 'ACCEPTED' AND business_stage = 'SMALL_BATCH'))"""


@query("t01_company_list", f"""WITH {LIST}
    SELECT c.id, c.canonical_name, (SELECT min(ts_code) FROM links JOIN security USING (security_id) WHERE company_id = c.id) AS security_code,
           (SELECT count(*) FROM claim k WHERE k.subject_id = c.id AND claim_status = 'ACCEPTED' AND predicate_code = 'PRODUCES') AS produces_claims,
           (SELECT count(*) FROM staged) AS total
    FROM staged c ORDER BY c.canonical_name, c.id LIMIT 20 OFFSET 10""")
def t01(f: Frames) -> DataFrame:
    page, total = t.company_list(f.company(), f.links(), f.securities(), f.claims(), "00000", "SMALL_BATCH", 20, 10)
    return page.select("*", total.scalar().alias("total"))


@query("t02_detail", "SELECT claim_id, predicate_code FROM claim WHERE claim_id = (SELECT max(event_id) FROM events)")
def t02(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("event_id")).scalar()
    return t.detail(f.claims(), "claim_id", wanted).select("claim_id", "predicate_code")


@query("t03_company_claims", """
    SELECT claim_id, recorded_at FROM claim WHERE subject_id = (SELECT max(user_id) FROM events) ORDER BY recorded_at DESC, claim_id LIMIT 25""")
def t03(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id")).scalar()
    return t.company_claims(f.claims(), wanted, 25).select("claim_id", "recorded_at")


@query("t04_timeline", """
    SELECT claim_id, predicate_code, valid_from, recorded_at FROM claim WHERE claim_status = 'ACCEPTED' AND subject_id = (SELECT max(user_id) FROM events)""")
def t04(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id")).scalar()
    return t.timeline(f.claims(), wanted).select("claim_id", "predicate_code", "valid_from", "recorded_at")


@query("t05_overview", """
    SELECT (SELECT count(*) FROM company) AS companies, (SELECT count(*) FROM claim WHERE claim_status = 'ACCEPTED') AS accepted_claims,
           (SELECT count(*) FROM claim WHERE claim_status = 'NEEDS_REVIEW') AS pending_reviews, (SELECT max(recorded_at) FROM claim) AS latest_claim_at,
           (SELECT count(*) FROM fragment) AS evidence_fragments, (SELECT count(*) FROM obs) AS financial_observations,
           (SELECT max(recorded_at) FROM obs) AS latest_observation_at""")
def t05(f: Frames) -> DataFrame:
    return t.overview(f.company(), f.claims(), f.fragments(), f.observations())


@query("t06_recent_runs", """
    (SELECT 'ingest' AS kind, run_id, dataset, status, finished_at FROM run WHERE finished_at IS NOT NULL ORDER BY finished_at DESC, run_id LIMIT 10)
    UNION ALL (SELECT 'normalization', run_id, dataset, status, finished_at FROM run WHERE finished_at IS NOT NULL AND dataset = '1-URGENT'
    ORDER BY finished_at DESC, run_id LIMIT 10)""")
def t06(f: Frames) -> DataFrame:
    return t.recent_runs(f.runs(), f.runs().filter("dataset = '1-URGENT'"))


@query("t07_dataset_freshness", """
    SELECT r.dataset, coalesce(e.at, r.at) AS fresh_at FROM (SELECT dataset, max(finished_at) AS at FROM run WHERE status <> 'RUNNING' GROUP BY 1) r
    LEFT JOIN (SELECT CASE event_type WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' ELSE event_type END AS dataset, max(ts) AS at FROM events GROUP BY 1) e USING (dataset)""")
def t07(f: Frames) -> DataFrame:
    raw = f.table("events").selectExpr(
        "CASE event_type WHEN 'click' THEN '1-URGENT' WHEN 'view' THEN '2-HIGH' ELSE event_type END AS api_name", "ts AS retrieved_at"
    )
    return t.dataset_freshness(f.runs(), raw)


@query("t08_run_history", """
    SELECT r.run_id, r.started_at, (SELECT count(*) FROM lineitem WHERE l_orderkey = r.run_id) AS events FROM run r
    WHERE dataset = '2-HIGH' ORDER BY started_at DESC, run_id LIMIT 30""")
def t08(f: Frames) -> DataFrame:
    events = f.table("lineitem").select(F.col("l_orderkey").alias("run_id"))
    return t.run_history(f.runs(), events, "2-HIGH", 30).select("run_id", "started_at", "events")


@query("t09_stale_runs", "SELECT run_id, lease_expires_at FROM run WHERE status = 'RUNNING' AND lease_expires_at < TIMESTAMP '1998-01-01'")
def t09(f: Frames) -> DataFrame:
    now = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz")
    return t.stale_runs(f.runs(), now).select("run_id", "lease_expires_at")


STATS = """stats AS (SELECT (SELECT count(*) FROM security) AS security_total, (SELECT count(*) FROM security WHERE status = 'UNKNOWN') AS security_unknown,
    (SELECT count(*) FROM security WHERE status = 'ACTIVE') AS security_active, (SELECT count(*) FROM company) AS company_total,
    (SELECT count(*) FROM obs) AS observation_total, (SELECT count(*) FROM obs WHERE value IS NULL) AS observation_null,
    (SELECT count(*) FROM lineitem) AS segment_total, (SELECT count(*) FROM product) AS product_total)"""


def _stats(f: Frames) -> DataFrame:
    return t.master_stats(f.securities(), f.company(), f.observations(), f.table("lineitem"), f.products())


@query("t10_master_stats", f"WITH {STATS} SELECT * FROM stats")
def t10(f: Frames) -> DataFrame:
    return _stats(f)


@query("t11_invariant_failures", f"""WITH {STATS}
    SELECT 'product_total' AS name, product_total AS actual, CAST(1000000 AS BIGINT) AS floor FROM stats
    UNION ALL SELECT 'observation_null', observation_null, CAST(1 AS BIGINT) FROM stats""")
def t11(f: Frames) -> DataFrame:
    return t.invariant_failures(_stats(f), {"company_total": 1, "product_total": 1_000_000, "observation_null": 1, "observation_total": 1})


@query("t12_golden_metrics", """
    WITH res AS (SELECT n_regionkey AS case_id, c_name AS name, c_acctbal > 0 AS grounded FROM customer JOIN nation ON n_nationkey = c_nationkey
          WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    want AS (SELECT DISTINCT n_regionkey AS case_id, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')),
    ban AS (SELECT DISTINCT n_regionkey AS case_id, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0),
    r AS (SELECT case_id, count(*) AS returned, count(*) FILTER (grounded) AS grounded,
            count(*) FILTER ((case_id, name) IN (SELECT (case_id, name) FROM want)) AS hits,
            count(*) FILTER ((case_id, name) IN (SELECT (case_id, name) FROM ban)) AS leaks FROM res GROUP BY 1),
    w AS (SELECT case_id, count(*) AS expected FROM want GROUP BY 1)
    SELECT case_id, returned, expected, hits, leaks, returned - hits AS unexpected, round(hits / returned, 4) AS precision,
           round(hits / expected, 4) AS recall, round(grounded / returned, 4) AS evidence_grounding FROM r JOIN w USING (case_id)""")
def t12(f: Frames) -> DataFrame:
    people = f.table("customer").join(f.table("nation"), F.expr("n_nationkey = c_nationkey")).selectExpr(
        "n_regionkey AS case_id", "c_name AS name", "c_mktsegment AS seg", "c_acctbal AS bal"
    )
    results = people.filter("seg IN ('BUILDING', 'MACHINERY')").selectExpr("case_id", "name", "bal > 0 AS grounded")
    wanted = people.filter("seg IN ('BUILDING', 'HOUSEHOLD')").selectExpr("case_id", "name", "false AS forbidden")
    banned = people.filter("seg = 'MACHINERY' AND bal < 0").selectExpr("case_id", "name", "true AS forbidden")
    return t.golden_metrics(results, wanted.unionByName(banned))


@query("t13_list_by", "SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 40")
def t13(f: Frames) -> DataFrame:
    docs = f.table("documents").select("doc_id", "source", "n_chars")
    return t.list_by(docs, F.col("source") == "src3", [F.col("n_chars").desc(), "doc_id"], 40)


@query("t14_quality_metrics", """
    SELECT (SELECT count(*) FROM claim) AS claims, (SELECT count(*) FROM claim WHERE claim_status = 'ACCEPTED') AS accepted,
           (SELECT count(*) FROM fragment WHERE page_number % 6 IN (1, 2, 3, 4)) AS grounding_failures,
           (SELECT count(*) FROM task WHERE status IN ('OPEN', 'IN_PROGRESS')) AS review_backlog,
           (SELECT count(*) FROM claim WHERE claim_status = 'ACCEPTED' AND claim_id IN (SELECT claim_id FROM live_link)) AS accepted_with_evidence,
           (SELECT round(count(*) FILTER (claim_status = 'ACCEPTED') / count(*), 4) FROM claim) AS acceptance_rate""")
def t14(f: Frames) -> DataFrame:
    grounding = x.ground_quotes(_quotes(f), f.fragments())
    return t.quality_metrics(f.claims(), f.live_links(), grounding, f.tasks())
