"""N rows: raw records derived from customers, orders and lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.functions.clean import LONG_TS_CODE
from factloom.operators import standardize as n
from factloom.sources import sinks
from factloom.sources.bindings import Frames


def _std(f: Frames) -> DataFrame:
    return n.securities(f.raw_securities(), code_form=LONG_TS_CODE)[0]


def _codes(f: Frames) -> DataFrame:
    """Security reference with the plain customer key as its id."""
    return f.securities().select("ts_code", "security_id")


def _active_links(f: Frames) -> DataFrame:
    """Links of active securities; the others have no company yet."""
    active = f.securities().filter("status = 'ACTIVE'")
    return f.links().join(active, "security_id", "left_semi")


@query("n01_raw_since", """
    SELECT rid FROM raw_sec WHERE retrieved_at > TIMESTAMP '2024-01-01 08:20:00'
       OR (retrieved_at = TIMESTAMP '2024-01-01 08:20:00' AND rid > 500)""")
def n01(f: Frames) -> DataFrame:
    at = (dt.datetime(2024, 1, 1, 8, 20), 500)
    return n.raw_since(f.raw_securities(), "stock_basic", at).select(F.col("source_record_id").alias("rid"))


@query("n02_normalize_generic", """
    SELECT 'rows' AS part, count(*) AS n FROM std_sec
    UNION ALL SELECT 'rejects', count(*) FROM raw_sec WHERE NOT code_ok OR name IS NULL""")
def n02(f: Frames) -> DataFrame:
    rows, rejects, _ = n.normalize(f.raw_securities(), "stock_basic", code_form=LONG_TS_CODE)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(rows, "rows").unionByName(count(rejects, "rejects"))


MEMBERS = """
    member AS (SELECT o_orderkey AS rid, l.company_id, o_orderpriority AS code, CAST(o_orderdate AS DATE) AS snapshot_date,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey % 1000) AS retrieved_at,
        true AS code_ok
        FROM orders JOIN security s ON s.security_id = o_custkey JOIN links l ON l.security_id = o_custkey)"""


def _raw_members(f: Frames) -> DataFrame:
    base = f.spread("orders").join(
        f.securities().select(F.col("security_id").alias("o_custkey"), "ts_code"), "o_custkey"
    )
    return f._raw(
        base, "ths_member",
        {
            "ts_code": "ts_code", "con_code": "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END",
            "code": "CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority END",
            "in_date": "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyyMMdd') END",
            "snapshot_date": "CASE WHEN o_orderkey % 2 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') END",
        },
        "o_orderkey",
    )


def _raw_concepts(f: Frames) -> DataFrame:
    base = f.spread("orders").withColumn("rid", F.col("o_orderkey"))
    return f._raw(
        base, "ths_index",
        {"ts_code": "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END",
         "name": "concat('Concept ', o_orderstatus, ' ', o_orderkey % 1000)"},
        "o_orderkey",
    )


def _memberships(f: Frames) -> tuple[DataFrame, DataFrame]:
    concepts, _ = n.concepts(_raw_concepts(f), "THS")
    return n.concept_membership(_raw_members(f), "THS", _codes(f), f.links(), concepts, LONG_TS_CODE)


@query("n03_snapshot_groups", f"""WITH {MEMBERS}
    SELECT snapshot_date, count(DISTINCT (company_id, code)) AS members FROM member WHERE code <> '5-LOW' AND code_ok GROUP BY 1""")
def n03(f: Frames) -> DataFrame:
    return n.snapshot_counts(_memberships(f)[0])


@query("n03_snapshot_write", f"""WITH {MEMBERS}
    SELECT snapshot_date, count(DISTINCT (company_id, code)) AS members FROM member WHERE code <> '5-LOW' AND code_ok GROUP BY 1""")
def n03b(f: Frames) -> DataFrame:
    import uuid

    from factloom.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(f.spark)}/members/{uuid.uuid4().hex}"
    rows = _memberships(f)[0]
    sinks.write_snapshot(rows.unionByName(rows.filter("day(snapshot_date) = 1")), path)
    # A replay of some dates replaces these alone, here the rows that came twice.
    sinks.write_snapshot(rows.filter("day(snapshot_date) = 1"), path)
    return n.snapshot_counts(sinks.read_snapshot(f.spark, path))


@query("n04_reject_log", """
    SELECT 'stock_basic' AS dataset, CASE WHEN NOT code_ok THEN concat('invalid ts_code: ''', ts_code_raw, '''') ELSE 'missing name' END AS reason,
           rid AS source_record_id FROM raw_sec WHERE NOT code_ok OR name IS NULL
    UNION ALL
    SELECT 'cashflow_vip', CASE WHEN ts_code IS NULL THEN 'invalid ts_code: None' WHEN period_end IS NULL THEN 'unparseable date: ''n/a'''
        WHEN bad_number THEN 'unparseable decimal: ''abc''' ELSE concat('security ', ts_code, ' not standardized yet') END, rid
    FROM raw_stmt WHERE ts_code IS NULL OR period_end IS NULL OR bad_number OR ts_code NOT IN (SELECT ts_code FROM std_sec)""")
def n04(f: Frames) -> DataFrame:
    std, bad_codes = n.securities(f.raw_securities(), code_form=LONG_TS_CODE)
    _, bad_rows = n.to_observations(f.raw_statements(), std, ["n_cashflow_act"], LONG_TS_CODE)
    return n.reject_log({"stock_basic": bad_codes, "cashflow_vip": bad_rows}).drop("ref")


@query("n05_exchanges", """
    SELECT exchange_code AS code, arg_max(split_part(ts_code, '.', 2), (retrieved_at, rid)) AS name FROM std_sec GROUP BY 1""")
def n05(f: Frames) -> DataFrame:
    return n.exchanges(f.raw_securities())


@query("n06_securities", "SELECT ts_code, symbol, name, exchange_code, status FROM std_sec")
def n06(f: Frames) -> DataFrame:
    return _std(f).select("ts_code", "symbol", "name", "exchange_code", "status")


@query("n06_securities_merge", """
    WITH row AS (SELECT concat('00000', left(o_orderpriority, 1), '.SH') AS ts_code, o_orderkey AS rid, o_orderkey % 1000 AS m,
        concat('Name ', o_orderkey) AS name, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'P' THEN 'PAUSED' ELSE 'UNKNOWN' END AS status FROM orders),
    cur AS (SELECT ts_code, 'PAUSED' AS status FROM row WHERE ts_code <= '000002.SH' GROUP BY 1)
    SELECT r.ts_code, arg_max(r.name, (m, rid)) AS name, coalesce(max(c.status), arg_min(r.status, (m, rid))) AS status
    FROM row r LEFT JOIN cur c USING (ts_code) GROUP BY 1""")
def n06b(f: Frames) -> DataFrame:
    # Orders replayed as listing rows of five codes: the first status stays, the last name wins
    raw = f._raw(
        f.table("orders"), "stock_basic",
        {"ts_code": "concat('00000', left(o_orderpriority, 1), '.SH')", "name": "concat('Name ', o_orderkey)",
         "list_status": "CASE o_orderstatus WHEN 'F' THEN 'L' WHEN 'P' THEN 'P' END"},
        "o_orderkey",
    )
    rows, _ = n.securities(raw)
    current = rows.filter("ts_code <= '000002.SH'").withColumns({"name": F.lit("old"), "status": F.lit("PAUSED")})
    return n.securities(raw, current)[0].select("ts_code", "name", "status")


@query("n07_companies", """
    SELECT concat('TUSHARE-UNVERIFIED-', c.ts_code) AS uscc, c.canonical_name FROM raw_com c
    WHERE c.canonical_name IS NOT NULL AND c.ts_code IN (SELECT ts_code FROM std_sec)""")
def n07(f: Frames) -> DataFrame:
    return n.companies(f.raw_companies(), _std(f), code_form=LONG_TS_CODE)[0].select("uscc", "canonical_name")


@query("n07_company_events", """
    SELECT c.ts_code AS entity_ref, 'MAPPED' AS event_type FROM raw_com c
    WHERE c.canonical_name IS NOT NULL AND c.ts_code IN (SELECT ts_code FROM security)
      AND c.rid NOT IN (SELECT security_id FROM security WHERE status = 'ACTIVE')""")
def n07b(f: Frames) -> DataFrame:
    known = _active_links(f).withColumn("company_id", F.col("company_id").cast("string"))
    _, _, events, _ = n.companies(f.raw_companies(), _codes(f), known, LONG_TS_CODE)
    return events.select("entity_ref", "event_type")


@query("n08_latest_link", """
    SELECT user_id AS security_id, arg_max(event_type, (ts, event_type)) AS company_id FROM events GROUP BY 1""")
def n08(f: Frames) -> DataFrame:
    links = f.table("events").selectExpr("user_id AS security_id", "event_type AS company_id", "ts AS recorded_at")
    return n.latest_company_link(links)


@query("n09_profiles", """
    SELECT l.company_id, arg_max(c.province, (c.retrieved_at, c.rid)) AS province,
           CAST(arg_max(c.reg_capital, (c.retrieved_at, c.rid)) AS DOUBLE) AS registered_capital,
           arg_max(c.main_business, (c.retrieved_at, c.rid)) AS main_part_business
    FROM raw_com c JOIN security s ON s.ts_code = c.ts_code JOIN links l ON l.security_id = s.security_id
    WHERE c.canonical_name IS NOT NULL AND NOT c.bad_capital GROUP BY 1""")
def n09(f: Frames) -> DataFrame:
    profiles, _ = n.company_profiles(f.raw_companies(), _codes(f), f.links(), LONG_TS_CODE)
    return profiles.select(
        "company_id", "province", F.col("registered_capital").cast("double").alias("registered_capital"), "main_part_business"
    )


@query("n10_name_history", """
    SELECT o_custkey AS security_id, o_orderstatus AS name, CAST(o_orderdate AS DATE) AS start_date,
           arg_min(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INT), (o_orderkey % 1000, o_orderkey)) AS end_date
    FROM orders JOIN security s ON s.security_id = o_custkey GROUP BY 1, 2, 3""")
def n10(f: Frames) -> DataFrame:
    base = f.spread("orders").join(f.securities().select(F.col("security_id").alias("o_custkey"), "ts_code"), "o_custkey")
    raw = f._raw(
        base, "namechange",
        {"ts_code": "ts_code", "name": "o_orderstatus", "start_date": "date_format(o_orderdate, 'yyyyMMdd')",
         "end_date": "date_format(date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 50 AS INT)), 'yyyy-MM-dd')"},
        "o_orderkey",
    )
    return n.name_history(raw, _codes(f), LONG_TS_CODE)[0].select("security_id", "name", "start_date", "end_date")


def _raw_industries(f: Frames) -> DataFrame:
    nation = f.table("nation").selectExpr("n_nationkey AS rid", "concat('N', n_nationkey) AS code", "n_name AS name",
                                          "concat('R', n_regionkey) AS parent", "'L2' AS level")
    region = f.table("region").selectExpr("r_regionkey + 1000 AS rid", "concat('R', r_regionkey) AS code", "r_name AS name",
                                          "CASE WHEN r_regionkey = 0 THEN 'missing' END AS parent", "CAST(NULL AS STRING) AS level")
    return f._raw(
        nation.unionByName(region), "index_classify",
        {"index_code": "code", "industry_name": "name", "level": "level", "parent_code": "parent"}, "rid",
    )


@query("n11_industries", """
    SELECT concat('N', n_nationkey) AS external_code, n_name AS name, 'L2' AS level_code, concat('R', n_regionkey) AS parent FROM nation
    UNION ALL SELECT concat('R', r_regionkey), r_name, 'L1', NULL FROM region""")
def n11(f: Frames) -> DataFrame:
    rows, _ = n.industries(_raw_industries(f))
    return rows.select("external_code", "name", "level_code",
                       F.when(F.col("parent_id").isNotNull(), F.col("parent_code")).alias("parent"))


@query("n12_industry_membership", """
    SELECT l.company_id, concat('N', c_nationkey) AS industry, DATE '2020-01-01' + CAST(c_custkey % 300 AS INT) AS valid_from,
           CASE WHEN c_custkey % 3 = 0 THEN DATE '2023-01-01' END AS valid_to
    FROM customer JOIN security s ON s.security_id = c_custkey JOIN links l ON l.security_id = c_custkey
    WHERE c_nationkey IN (SELECT n_nationkey FROM nation)""")
def n12(f: Frames) -> DataFrame:
    base = f.table("customer").join(f.securities().select(F.col("security_id").alias("c_custkey"), "ts_code"), "c_custkey")
    raw = f._raw(
        base, "index_member_all",
        {"ts_code": "ts_code", "index_code": "concat('N', c_nationkey)",
         "in_date": "date_format(date_add(date'2020-01-01', CAST(c_custkey % 300 AS INT)), 'yyyyMMdd')",
         "out_date": "CASE WHEN c_custkey % 3 = 0 THEN '20230101' ELSE '' END"},
        "c_custkey",
    )
    industries, _ = n.industries(_raw_industries(f))
    rows, _ = n.industry_membership(raw, _codes(f), f.links(), industries, LONG_TS_CODE)
    named = industries.select("industry_id", F.col("external_code").alias("industry"))
    return rows.join(named, "industry_id").select("company_id", "industry", "valid_from", "valid_to")


@query("n13_concepts", """
    SELECT o_orderpriority AS external_code,
           arg_max(concat('Concept ', o_orderstatus, ' ', o_orderkey % 1000), (o_orderkey % 1000, o_orderkey)) AS name
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def n13(f: Frames) -> DataFrame:
    return n.concepts(_raw_concepts(f), "THS")[0].select("external_code", "name")


@query("n14_concept_membership", f"""WITH {MEMBERS}
    SELECT company_id, code, snapshot_date, min(retrieved_at) AS recorded_at, true AS is_member FROM member
    WHERE code <> '5-LOW' AND code_ok GROUP BY 1, 2, 3""")
def n14(f: Frames) -> DataFrame:
    concepts, _ = n.concepts(_raw_concepts(f), "THS")
    named = concepts.select("concept_id", F.col("external_code").alias("code"))
    return _memberships(f)[0].join(named, "concept_id").drop("concept_id")


@query("n14_membership_rejects", f"""WITH {MEMBERS}
    SELECT rid AS source_record_id, 'concept THS:5-LOW not standardized yet' AS reason FROM member WHERE code = '5-LOW' AND code_ok""")
def n14b(f: Frames) -> DataFrame:
    return _memberships(f)[1].filter("reason LIKE 'concept%'").select("source_record_id", "reason")


OBSERVED = """
    seen AS (SELECT r.*, s.security_id, coalesce(ann_date, retrieved_at) AS announced_at FROM raw_stmt r
        JOIN security s ON s.ts_code = r.ts_code
        WHERE period_end IS NOT NULL AND NOT bad_number AND present)"""


@query("n15_to_observations", f"""WITH {OBSERVED}
    SELECT rid AS source_record_id, security_id, period_end, CAST(value AS DOUBLE) AS value FROM seen""")
def n15(f: Frames) -> DataFrame:
    rows, _ = n.to_observations(f.raw_statements(), _codes(f), ["n_cashflow_act"], LONG_TS_CODE)
    return rows.select("source_record_id", "security_id", "period_end", F.col("value").cast("double").alias("value"))


@query("n16_merge_observations", f"""WITH {OBSERVED},
    one AS (SELECT security_id, period_end, report_type, update_flag, announced_at,
                   arg_min(rid, (retrieved_at, rid)) AS source_record_id FROM seen GROUP BY 1, 2, 3, 4, 5)
    SELECT * FROM one WHERE (security_id, period_end, report_type, update_flag, announced_at) NOT IN (
        SELECT (security_id, period_end, report_type, update_flag, announced_at) FROM seen WHERE update_flag = 'F')""")
def n16(f: Frames) -> DataFrame:
    rows, _ = n.to_observations(f.raw_statements(), _codes(f), ["n_cashflow_act"], LONG_TS_CODE)
    current = rows.filter("update_flag = 'F'")
    return n.merge_observations(rows, current).select(
        "security_id", "period_end", "report_type", "update_flag", "announced_at", "source_record_id"
    )


@query("n17_observation_defaults", """
    SELECT rid AS source_record_id, coalesce(ann_date, retrieved_at) AS announced_at, report_type, update_flag,
           CAST(NULL AS VARCHAR) AS currency FROM raw_stmt""")
def n17(f: Frames) -> DataFrame:
    return n.observation_defaults(f.raw_statements()).select(
        "source_record_id", "announced_at", "report_type", "update_flag", "currency"
    )


@query("n18_metric_catalog", """
    SELECT m.metric_code, m.statement_type, o.observations FROM (VALUES ('NET_CF_OPERATING', 'CASHFLOW'), ('TOTAL_REVENUE', 'INCOME'),
        ('NET_INCOME', 'INCOME'), ('ROE', 'INDICATOR'), ('NET_PROFIT_YOY', 'INDICATOR')) m(metric_code, statement_type)
    LEFT JOIN (SELECT metric_code, count(*) AS observations FROM obs GROUP BY 1) o USING (metric_code)""")
def n18(f: Frames) -> DataFrame:
    counts = f.observations().groupBy("metric_code").agg(F.count(F.lit(1)).alias("observations"))
    return n.metric_catalog(f.spark).join(counts, "metric_code", "left").select("metric_code", "statement_type", "observations")


@query("n19_business_segments", """
    SELECT company_id, period_end, segment_type, raw_segment_name, CAST(revenue AS DOUBLE) AS revenue FROM segment""")
def n19(f: Frames) -> DataFrame:
    rows, _, _ = n.business_segments(f.raw_segments(), _codes(f), f.links(), code_form=LONG_TS_CODE)
    return rows.select("company_id", "period_end", "segment_type", "raw_segment_name", F.col("revenue").cast("double").alias("revenue"))


@query("n19_segment_corrections", """
    SELECT writes - 1 AS overwrites, count(*) AS n FROM segment WHERE writes > 1 GROUP BY 1""")
def n19b(f: Frames) -> DataFrame:
    _, events, _ = n.business_segments(f.raw_segments(), _codes(f), f.links(), code_form=LONG_TS_CODE)
    return events.groupBy("overwrites").agg(F.count(F.lit(1)).alias("n"))


@query("n20_holdings", """
    SELECT security_id, holder_name, end_date, CAST(hold_ratio AS DOUBLE) AS hold_ratio, 'HOLDS' AS predicate_code
    FROM hold_row WHERE holder_name IS NOT NULL GROUP BY 1, 2, 3, 4""")
def n20(f: Frames) -> DataFrame:
    rows, _ = n.holdings(f.raw_holders(), _codes(f), code_form=LONG_TS_CODE)
    return rows.select("security_id", "holder_name", "end_date", F.col("hold_ratio").cast("double").alias("hold_ratio"), "predicate_code")


@query("n21_products_from_segments", """
    SELECT substr(sha256(raw_segment_name), 1, 10) AS product_id, raw_segment_name AS canonical_name, count(*) AS mapped
    FROM segment WHERE segment_type = 'PRODUCT' GROUP BY 2""")
def n21(f: Frames) -> DataFrame:
    segments, _, _ = n.business_segments(f.raw_segments(), _codes(f), f.links(), code_form=LONG_TS_CODE)
    products, mapped = n.products_from_segments(segments)
    counts = mapped.filter("mapping_status = 'ACCEPTED'").groupBy(F.col("mapped_product_id").alias("product_id")).agg(
        F.count(F.lit(1)).alias("mapped")
    )
    return products.join(counts, "product_id")


@query("n22_resolve_alias", """
    WITH mapping AS (SELECT lower(p_name) AS term, p_partkey AS product_id, CAST(p_size AS DOUBLE) / 50 AS confidence
        FROM part WHERE p_type <> 'SMALL'),
    top AS (SELECT term, max(confidence) AS c FROM mapping GROUP BY 1),
    best AS (SELECT m.term, top.c, count(*) AS n, min(m.product_id) AS product_id FROM mapping m JOIN top ON top.term = m.term AND top.c = m.confidence GROUP BY 1, 2)
    SELECT p.p_partkey AS id, CASE WHEN b.term IS NULL THEN 'UNRESOLVED' WHEN n > 1 OR c < 0.75 THEN 'NEEDS_REVIEW' ELSE 'RESOLVED' END AS resolution,
           CASE WHEN n = 1 AND c >= 0.75 THEN product_id END AS mapped_product_id
    FROM part p LEFT JOIN best b ON b.term = lower(p.p_name || CASE WHEN p.p_partkey % 5 = 0 THEN '!' ELSE '' END)""")
def n22(f: Frames) -> DataFrame:
    part = f.table("part")
    mappings = part.selectExpr(
        "lower(p_name) AS normalized_term", "p_partkey AS product_id", "CAST(p_size AS DOUBLE) / 50 AS confidence",
        "CASE WHEN p_type <> 'SMALL' THEN 'ACCEPTED' ELSE 'PENDING' END AS review_status",
    )
    terms = part.selectExpr("p_partkey AS id", "concat(' ', upper(p_name), CASE WHEN p_partkey % 5 = 0 THEN '!' ELSE '' END) AS raw_term")
    return n.resolve_alias(terms, mappings).select("id", "resolution", "mapped_product_id")


@query("n23_resolve_subject", """
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'UNRESOLVED' WHEN l.company_id IS NULL THEN 'NEEDS_REVIEW' ELSE 'RESOLVED' END AS resolution
    FROM orders LEFT JOIN links l ON l.security_id = o_custkey AND o_custkey IN (SELECT security_id FROM security WHERE status = 'ACTIVE')""")
def n23(f: Frames) -> DataFrame:
    candidates = f.table("orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS security_id")
    return n.resolve_subject(candidates, _active_links(f)).select("id", "resolution")


@query("n24_stamp_run", """
    SELECT 'v0.1.4' AS mapping_version, 'run-1' AS run_id, count(*) AS rows, 'VERSION_APPLIED' AS event_type FROM std_sec""")
def n24(f: Frames) -> DataFrame:
    stamped, event = n.stamp_run(_std(f), "v0.1.4", "run-1")
    counted = stamped.groupBy("mapping_version", "run_id").agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(event.select("run_id", "event_type"), "run_id")


@query("n25_normalization_summary", """
    SELECT l_suppkey AS run_id, count(*) AS rows_read, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS rows_written,
           sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS rows_rejected,
           CASE WHEN sum(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) > 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCEEDED' END AS status
    FROM lineitem GROUP BY 1""")
def n25(f: Frames) -> DataFrame:
    outcomes = f.table("lineitem").selectExpr(
        "l_suppkey AS run_id", "CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS written",
        "CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END AS rejected",
    )
    return n.normalization_summary(outcomes)


@query("n26_annotate_priority", """
    SELECT doc_id, CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 82 END AS source_priority,
           lang = 'en' AS product_candidate FROM documents""")
def n26(f: Frames) -> DataFrame:
    docs = f.table("documents").selectExpr(
        "doc_id", "CASE lang WHEN 'en' THEN 'PRODUCT' ELSE 'REGION' END AS segment_type",
        "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'ANNUAL_REPORT' WHEN 1 THEN 'PLATFORM_CONCEPT_TAG' "
        "WHEN 2 THEN 'SURVEY_RECORD' ELSE 'BLOG' END AS source_type",
    )
    return n.annotate_priority(docs).select("doc_id", "source_priority", "product_candidate")


@query("n27_reconcile_layers", """
    SELECT CASE WHEN r.k IS NULL THEN 'only_standard' WHEN s.k IS NULL THEN 'only_raw' ELSE 'both' END AS presence, count(*) AS keys,
           coalesce(sum(r.n), 0) AS raw_rows, coalesce(sum(s.n), 0) AS standard_rows
    FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) r
    FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) s ON r.k = s.k GROUP BY 1""")
def n27(f: Frames) -> DataFrame:
    raw = f.table("orders").select(F.col("o_custkey").alias("k"))
    standard = f.table("customer").select(F.col("c_custkey").alias("k"))
    return n.reconcile_layers(raw, standard, "k")


@query("n28_label_index", """
    SELECT lower(p_name) AS label, count(DISTINCT p_partkey) AS products, count(DISTINCT p_partkey) > 1 AS ambiguous FROM part GROUP BY 1
    UNION ALL SELECT lower(concat(p_brand, ' ', p_partkey)), 1, false FROM part""")
def n28(f: Frames) -> DataFrame:
    part = f.table("part")
    triples = part.selectExpr("p_partkey AS s", "'skos:prefLabel' AS p", "p_name AS o").unionByName(
        part.selectExpr("p_partkey AS s", "'skos:altLabel' AS p", "concat(' ', p_brand, ' ', p_partkey) AS o")
    )
    return n.label_index(triples).select("label", "products", "ambiguous")
