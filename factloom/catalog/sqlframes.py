"""The domain frames in SQL, for the checks that run on another engine."""

from __future__ import annotations

import re

from factloom.functions.clean import WS_CLASS

WS = WS_CLASS
_K = "CAST(json_extract(props, '$.k') AS INT)"


def _paragraphs(source: str) -> str:
    return f"""
        SELECT document_id, page_number, text, char_start, i - 1 AS paragraph_index, paras[i] AS para,
               regexp_replace(paras[i], '^{WS}+|{WS}+$', '', 'g') AS stripped
        FROM (SELECT *, unnest(generate_series(1, len(paras))) AS i FROM (
            SELECT *, list_filter(string_split_regex(text, '\\n\\s*\\n|\\n'),
                                  lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g') <> '') AS paras FROM {source}))"""


# Name -> SELECT; a frame may use frames above it
FRAMES: dict[str, str] = {
    "obs": """
        SELECT o_orderkey AS id, o_custkey AS security_id, 'NET_CF_OPERATING' AS metric_code,
               make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS period_end,
               left(o_orderpriority, 1) AS report_type,
               CAST(o_totalprice AS DECIMAL(18,2)) - 250000 AS value,
               CASE WHEN o_orderkey % 7 <> 0 THEN 'CNY' END AS currency,
               o_orderdate AS announced_at, o_orderstatus AS update_flag, o_orderdate AS recorded_at
        FROM orders""",
    "links": """
        SELECT c_custkey // 2 AS company_id, c_custkey AS security_id,
               TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(c_custkey % 24 AS INT)) AS recorded_at
        FROM customer""",
    "company": "SELECT c_custkey // 2 AS id, min(c_name) AS canonical_name FROM customer GROUP BY 1",
    "security": """
        SELECT c_custkey AS security_id, c_custkey AS id,
               concat(lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INT), '0'), '.',
                      CASE c_custkey % 3 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' ELSE 'BJ' END) AS ts_code,
               c_name AS name,
               CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'SSE' END AS exchange_code,
               CASE c_nationkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'DELISTED' ELSE 'UNKNOWN' END AS status
        FROM customer""",
    "claim": f"""
        SELECT event_id AS claim_id, 'Company' AS subject_type, user_id AS subject_id,
               CASE event_type WHEN 'click' THEN 'PRODUCES' WHEN 'view' THEN 'DEVELOPS'
                    WHEN 'purchase' THEN 'HAS_REVENUE_FROM' WHEN 'signup' THEN 'SUPPLIES_TO'
                    WHEN 'error' THEN 'DENIES_INVOLVEMENT' END AS predicate_code,
               CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 13 = 0 THEN 'Concept' ELSE 'Product' END END AS object_type,
               CASE WHEN k % 11 <> 0 THEN CAST(k // 4 + 1 AS BIGINT) END AS object_id,
               CASE WHEN k % 11 = 0 THEN concat('value-', k) END AS object_value,
               CASE WHEN k % 10 < 5 THEN 'ACCEPTED' WHEN k % 10 = 5 THEN 'NEEDS_REVIEW'
                    WHEN k % 10 = 6 THEN 'VALIDATED' WHEN k % 10 = 7 THEN 'CONTRADICTED'
                    WHEN k % 10 = 8 THEN 'SUPERSEDED' ELSE 'REJECTED' END AS claim_status,
               CASE k // 10 WHEN 0 THEN 'TECHNOLOGY_RESERVE' WHEN 1 THEN 'RESEARCH' WHEN 2 THEN 'PROTOTYPE'
                    WHEN 3 THEN 'SAMPLE_VALIDATION' WHEN 4 THEN 'SMALL_BATCH' WHEN 5 THEN 'MASS_PRODUCTION'
                    WHEN 6 THEN 'MASS_PRODUCTION' WHEN 7 THEN 'UNKNOWN' WHEN 9 THEN 'UNKNOWN' END AS business_stage,
               CASE WHEN event_type = 'error' THEN 'COMPANY_DENIAL' WHEN event_type = 'purchase' THEN 'REVENUE_DISCLOSED'
                    WHEN k % 7 = 0 THEN 'PLATFORM_CLASSIFICATION_ONLY' ELSE 'PRODUCT_DISCLOSED' END AS evidence_state,
               CAST(k AS DOUBLE) / 100 AS confidence,
               ts AS valid_from,
               CASE WHEN k % 5 <> 0 THEN ts + to_days(k) END AS valid_to,
               ts + to_hours(k) AS recorded_at,
               CASE WHEN k % 10 = 8 THEN ts + to_hours(k) + to_days(10) END AS superseded_at,
               concat('0.1.', k) AS ontology_version,
               CASE WHEN k % 3 <> 0 THEN concat('FY', year(ts)) END AS report_period,
               k % 4 = 0 AS hedged, k
        FROM (SELECT *, {_K} AS k FROM events)""",
    "ev_link": f"""
        SELECT event_id AS claim_id, user_id * 100 + {_K} % 8 AS evidence_id, 'SUPPORTS' AS support_type,
               CAST(1.0 AS DOUBLE) AS weight FROM events""",
    "fragment": """
        SELECT conv_id * 100 + turn AS evidence_id, conv_id AS document_id, conv_id AS document_version_id,
               CAST(turn + 1 AS INT) AS page_number, 0 AS char_start, CAST(length(text) AS INT) AS char_end,
               text AS quote_text, sha256(text) AS checksum
        FROM conversations""",
    "live_link": "SELECT * FROM ev_link WHERE evidence_id IN (SELECT evidence_id FROM fragment)",
    "product": """
        SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS product_id, p_brand AS canonical_name FROM part""",
    "page": """
        SELECT concat('d', doc_id) AS document_id, 1 AS page_number, text FROM documents
        UNION ALL
        SELECT concat('c', conv_id), CAST(turn + 1 AS INT), text FROM conversations""",
    "taxonomy": """
        SELECT concat('part:', p_partkey) AS child, replace(p_brand, 'Brand#', 'brand:') AS parent FROM part
        UNION ALL
        SELECT DISTINCT replace(p_brand, 'Brand#', 'brand:'), concat('type:', p_type) FROM part
        UNION ALL
        SELECT DISTINCT concat('type:', p_type), 'root:goods' FROM part""",
    "trade_edge": """
        SELECT concat('O', o_orderkey) AS edge_id, concat('customer:', o_custkey) AS src,
               concat('order:', o_orderkey) AS dst, 'PRODUCES' AS rel_type FROM orders
        UNION ALL
        SELECT DISTINCT concat('L-', l_orderkey, '-', l_suppkey), concat('order:', l_orderkey),
               concat('supplier:', l_suppkey), 'SUPPLIES_TO' FROM lineitem""",
    "trade_und": """
        SELECT edge_id, src, dst, rel_type FROM trade_edge
        UNION ALL SELECT edge_id, dst, src, rel_type FROM trade_edge WHERE src <> dst""",
    "trade_node": """
        SELECT concat('customer:', c_custkey) AS id, 'Company' AS label, c_name AS canonical_name FROM customer
        UNION ALL SELECT concat('order:', o_orderkey), 'Product', o_orderpriority FROM orders
        UNION ALL SELECT concat('supplier:', s_suppkey), 'Company', s_name FROM supplier""",
    "chain": """
        SELECT concat(conv_id, '-', turn) AS entity_id, role AS entity_type, 'turn' AS activity_id, role AS agent_id,
               CASE WHEN turn > 0 THEN concat(conv_id, '-', turn - 1) END AS parent_entity_id,
               sha256(concat(conv_id, '|', turn, '|', role, '|', text)) AS checksum,
               conv_id * 100 + turn AS sequence_id
        FROM conversations""",
    "run": """
        SELECT o_orderkey AS run_id, o_orderpriority AS dataset, o_orderdate AS started_at,
               CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'PARTIAL_SUCCESS' ELSE 'RUNNING' END AS status,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_days(CAST(o_custkey % 10 AS INT)) END AS finished_at,
               o_orderdate + to_days(1) AS lease_expires_at,
               CAST(trunc(o_totalprice) AS BIGINT) AS rows
        FROM orders""",
    "outbox": """
        SELECT o_orderkey AS seq, 'Claim' AS aggregate_type, o_orderkey AS aggregate_id, 'CLAIM_ACCEPTED' AS event_type,
               concat('claim-accepted:', o_orderkey) AS idempotency_key,
               CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'P' THEN 'PROCESSING' ELSE 'PENDING' END AS status,
               CAST(o_custkey % 6 AS INT) AS retry_count, o_orderdate AS created_at,
               o_orderdate + to_days(30) AS lease_expires_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(1) END AS processed_at
        FROM orders""",
    "task": f"""
        SELECT event_id + 1000000000 AS task_id, event_id AS claim_id,
               CASE {_K} % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status,
               CASE WHEN {_K} % 3 = 0 THEN 'HIGH' ELSE 'NORMAL' END AS priority, ts AS created_at
        FROM events""",
    # Raw records with the payload fields as columns; a NULL means no value
    "raw_sec": """
        SELECT c_custkey AS rid, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey % 1000) AS retrieved_at,
               s.ts_code AS base_code, c_custkey % 17 <> 0 AS code_ok,
               CASE WHEN c_custkey % 17 = 0 THEN concat('X', s.ts_code) ELSE concat(' ', lower(s.ts_code)) END AS ts_code_raw,
               split_part(s.ts_code, '.', 1) AS symbol, CASE WHEN c_custkey % 19 <> 0 THEN c_name END AS name,
               CASE WHEN c_custkey % 4 = 0 THEN 'SZSE'
                    ELSE CASE split_part(s.ts_code, '.', 2) WHEN 'SH' THEN 'SSE' WHEN 'SZ' THEN 'SZSE' ELSE 'BSE' END END AS exchange_code,
               CASE c_nationkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'DELISTED' WHEN 2 THEN 'PAUSED' ELSE 'UNKNOWN' END AS status
        FROM customer JOIN security s ON s.security_id = c_custkey""",
    "std_sec": "SELECT base_code AS ts_code, * EXCLUDE (base_code) FROM raw_sec WHERE code_ok AND name IS NOT NULL",
    "raw_com": """
        SELECT c_custkey AS rid, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey % 1000) AS retrieved_at,
               CASE WHEN c_custkey % 23 = 0 THEN '999999.SH' ELSE s.ts_code END AS ts_code,
               CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN concat('Com ', c_name)
                    WHEN c_custkey % 15 = 2 THEN concat('Full ', c_name) END AS canonical_name,
               concat('P', c_nationkey) AS province,
               CASE WHEN c_custkey % 41 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS reg_capital,
               c_custkey % 41 = 0 AS bad_capital,
               CASE WHEN c_custkey % 4 <> 0 THEN concat('About ', c_name) END AS introduction,
               c_mktsegment AS main_business
        FROM customer JOIN security s ON s.security_id = c_custkey""",
    "raw_stmt": """
        SELECT o_orderkey AS rid, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey % 1000) AS retrieved_at,
               CASE WHEN o_orderkey % 29 = 0 THEN '999999.SH' ELSE s.ts_code END AS ts_code,
               CASE WHEN o_orderkey % 31 <> 0 THEN make_date(CAST(year(o_orderdate) AS INT), 12, 31) END AS period_end,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS ann_date,
               CASE WHEN o_orderkey % 5 <> 0 THEN left(o_orderpriority, 1) ELSE 'UNKNOWN' END AS report_type,
               o_orderstatus AS update_flag,
               o_orderkey % 13 <> 0 AS present,
               o_orderkey % 13 <> 0 AND o_orderkey % 37 = 0 AS bad_number,
               CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 11 <> 0
                    THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS value
        FROM orders LEFT JOIN security s ON s.security_id = o_custkey""",
    "seg_row": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS rid,
               l_shipdate AS retrieved_at, s.ts_code, o_custkey, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS period_end,
               p_brand AS raw_segment_name,
               CASE l_linenumber % 5 WHEN 0 THEN 'PRODUCT' WHEN 1 THEN 'INDUSTRY' WHEN 2 THEN 'REGION' WHEN 4 THEN 'PRODUCT' END AS segment_type,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue,
               CASE WHEN l_linenumber % 2 = 0 THEN 'CNY' END AS currency
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN security s ON s.security_id = o_custkey""",
    "segment": """
        SELECT l.company_id, period_end, segment_type, raw_segment_name, max_by(revenue, (retrieved_at, rid)) AS revenue,
               count(*) AS writes
        FROM seg_row r JOIN links l ON l.security_id = r.o_custkey
        WHERE segment_type IS NOT NULL
        GROUP BY 1, 2, 3, 4""",
    "hold_row": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS rid,
               l_shipdate AS retrieved_at, o_custkey AS security_id, s.ts_code,
               CASE WHEN l_suppkey % 13 <> 0 THEN s_name END AS holder_name,
               CAST(l_shipdate AS DATE) AS end_date,
               CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_discount AS DECIMAL(10,2)) END AS hold_ratio
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN security s ON s.security_id = o_custkey""",
    "placed": """
        SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY page_number
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM page""",
    "para": _paragraphs("placed"),
    "headed": """
        SELECT document_id, page_number, char_start,
               concat('Chapter ', page_number, ' of ', document_id, chr(10), text, chr(10), '第二章 附录', chr(10), 'appendix of ', document_id) AS text
        FROM placed""",
    "headed_para": _paragraphs("headed"),
    "frag": f"""
        SELECT document_id, page_number, paragraph_index, char_start + strpos(text, para) - 1 AS char_start,
               char_start + strpos(text, para) - 1 + length(para) AS char_end, stripped AS quote_text,
               regexp_replace(regexp_replace(stripped, '{WS}+', ' ', 'g'), '^ +| +$', '', 'g') AS normalized_text
        FROM para WHERE length(stripped) >= 10""",
    "fragc": """
        SELECT *, sha256(concat(page_number, '|', char_start, '|', normalized_text)) AS checksum FROM frag""",
    "vrow": """
        SELECT security_id, ts_code, split_part(ts_code, '.', 1) AS symbol, name, page, page // 5 AS run_id, (page % 5) * 100 AS page_offset,
               CASE WHEN page % 11 = 5 THEN 2 WHEN page % 13 = 6 THEN 3 WHEN page % 7 = 3 THEN 1 ELSE 0 END AS layout
        FROM (SELECT *, security_id // 100 AS page FROM security)""",
    "vpage": """
        SELECT *, lag(sig) OVER (PARTITION BY run_id ORDER BY page_offset) AS before_sig FROM (
            SELECT DISTINCT page, run_id, page_offset, layout,
                   CASE layout WHEN 2 THEN '["ts_code","symbol"]' WHEN 3 THEN '["symbol","ts_code","name"]'
                        ELSE '["ts_code","symbol","name"]' END AS sig FROM vrow)""",
    "fy_current": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY security_id, metric_code, period_end ORDER BY
                CASE WHEN report_type IN ('1','4') THEN 1 WHEN report_type IN ('2','5','6') THEN 2 ELSE 3 END,
                announced_at DESC NULLS LAST, update_flag DESC NULLS LAST, recorded_at DESC, id DESC) AS rn
            FROM obs) WHERE rn = 1""",
    "fy_series": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT l.company_id, c.*, row_number() OVER (PARTITION BY l.company_id, c.period_end
                ORDER BY c.announced_at DESC NULLS LAST, c.security_id, c.id) AS rn
            FROM fy_current c JOIN (SELECT DISTINCT company_id, security_id FROM links) l USING (security_id)
            WHERE month(c.period_end) = 12 AND day(c.period_end) = 31 AND c.value IS NOT NULL) WHERE rn = 1""",
    "fy_ranked": """
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY period_end DESC) AS fy_rank,
               count(*) OVER (PARTITION BY company_id) AS available FROM fy_series""",
    "closure": """
        SELECT child, ancestor, min(hops) AS hops FROM (
            SELECT child, child AS ancestor, 0 AS hops FROM taxonomy
            UNION ALL SELECT parent, parent, 0 FROM taxonomy
            UNION ALL SELECT child, parent, 1 FROM taxonomy
            UNION ALL SELECT a.child, b.parent, 2 FROM taxonomy a JOIN taxonomy b ON a.parent = b.child
            UNION ALL SELECT a.child, c.parent, 3 FROM taxonomy a JOIN taxonomy b ON a.parent = b.child
                JOIN taxonomy c ON b.parent = c.child
            UNION ALL SELECT a.child, d.parent, 4 FROM taxonomy a JOIN taxonomy b ON a.parent = b.child
                JOIN taxonomy c ON b.parent = c.child JOIN taxonomy d ON c.parent = d.child)
        GROUP BY 1, 2""",
}


def with_frames(body: str) -> str:
    """Prefix the frames that ``body`` names, directly or through other frames."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in FRAMES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(FRAMES[name])

    visit(body)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in FRAMES.items() if name in needed)
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{stripped[14:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
