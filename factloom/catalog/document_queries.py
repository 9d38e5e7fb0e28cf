"""D rows over web pages, documents and conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.catalog.sqlframes import WS
from factloom.operators import documents as d
from factloom.sources.bindings import Frames

CATALOG_SQL = r"""cat AS (SELECT 'web' AS source_system, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id // 3 AS VARCHAR) END AS external_id,
    regexp_replace(url, '[?#].*$', '') AS source_url, concat('Title ', page_id) AS title, page_id AS seen_at,
    CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE sha256(html) END AS content_hash FROM pages)"""


def _catalog(f: Frames) -> DataFrame:
    return f.table("pages").selectExpr(
        "page_id", "'web' AS source_system", "CASE WHEN page_id % 3 <> 0 THEN CAST(page_id div 3 AS STRING) END AS external_id",
        "regexp_replace(url, '[?#].*$', '') AS source_url", "concat('Title ', page_id) AS title", "page_id AS seen_at",
        "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE sha2(html, 256) END AS content_hash",
    )


def _placed(f: Frames) -> DataFrame:
    pages = f.pages()
    offsets, _ = d.page_quality(pages)
    return pages.join(offsets.select("document_id", "page_number", "char_start"), ["document_id", "page_number"])


@query("d01_document_identity", f"""WITH {CATALOG_SQL}
    SELECT sha256(concat(source_system, '|', coalesce(external_id, 'None'), '|', source_url)) AS document_id,
           arg_max(title, (seen_at, title)) AS title FROM cat GROUP BY 1""")
def d01(f: Frames) -> DataFrame:
    return d.document_identity(_catalog(f)).select("document_id", "title")


@query("d02_version_documents", """
    SELECT document_id, content_hash, row_number() OVER (PARTITION BY document_id ORDER BY first_seen, content_hash) AS version
    FROM (SELECT user_id AS document_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS content_hash, min(ts) AS first_seen FROM events GROUP BY 1, 2)""")
def d02(f: Frames) -> DataFrame:
    contents = f.table("events").select(
        F.col("user_id").alias("document_id"), F.get_json_object("props", "$.k").alias("content_hash"), F.col("ts").alias("seen_at")
    )
    return d.version_documents(contents).select("document_id", "content_hash", "version")


@query("d03_provisional_hash", f"""WITH {CATALOG_SQL}
    SELECT seen_at AS page_id, CASE WHEN content_hash <> '' THEN content_hash
        ELSE sha256(concat(coalesce(external_id, 'None'), '|', source_url)) END AS content_hash FROM cat""")
def d03(f: Frames) -> DataFrame:
    return d.provisional_hash(_catalog(f)).select("page_id", "content_hash")


@query("d04_page_offsets", f"""
    SELECT document_id, page_number, char_start, char_start + length(text) AS char_end,
           length(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) < 40 AS blank FROM placed""")
def d04(f: Frames) -> DataFrame:
    return d.page_quality(f.pages())[0].select("document_id", "page_number", "char_start", "char_end", "blank")


DOCS = f"""docs AS (SELECT document_id, count(*) AS page_count, sum(n) AS total_chars, count(*) FILTER (n < 40) AS blank_page_count,
        CASE WHEN sum(n) < 120 OR count(*) FILTER (n < 40) > 0.6 * count(*) THEN 'PARSE_NEEDS_REVIEW' ELSE 'PARSED' END AS parse_status
    FROM (SELECT document_id, length(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) AS n FROM page) GROUP BY 1)"""


@query("d04_document_quality", f"WITH {DOCS} SELECT * FROM docs")
def d04b(f: Frames) -> DataFrame:
    return d.page_quality(f.pages())[1].drop("blank_page_ratio")


@query("d05_segment_pages", """
    SELECT document_id, page_number, paragraph_index, char_start, char_end, sha256(quote_text) AS quote_hash FROM frag""")
def d05(f: Frames) -> DataFrame:
    return d.segment_pages(_placed(f)).select(
        "document_id", "page_number", "paragraph_index", "char_start", "char_end", F.sha2("quote_text", 256).alias("quote_hash")
    )


@query("d05_section_titles", r"""
    WITH marked AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY paragraph_index) AS n,
            CASE WHEN regexp_matches(stripped, '^(第[一二三四五六七八九十百千0-9]+[章节部分]|[Cc]hapter\s+\d+|[Ss]ection\s+\d+|\d+(\.\d+)*\s*[、\.])')
                 THEN substr(stripped, 1, 80) END AS head FROM headed_para)
    SELECT document_id, page_number, paragraph_index, title AS section_title FROM (
        SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY paragraph_index) AS title FROM marked)
    WHERE length(stripped) >= 10 AND title IS NOT NULL""")
def d05b(f: Frames) -> DataFrame:
    headed = _placed(f).withColumn(
        "text",
        F.concat(F.lit("Chapter "), F.col("page_number").cast("string"), F.lit(" of "), "document_id", F.lit("\n"), "text",
                 F.lit("\n第二章 附录\nappendix of "), "document_id"),
    )
    return d.segment_pages(headed).filter("section_title IS NOT NULL").select(
        "document_id", "page_number", "paragraph_index", "section_title"
    )


@query("d06_dedup_fragments", """
    SELECT document_id, checksum, min(paragraph_index) AS paragraph_index FROM fragc GROUP BY 1, 2""")
def d06(f: Frames) -> DataFrame:
    return d.dedup_fragments(d.segment_pages(_placed(f))).select("document_id", "checksum", "paragraph_index")


@query("d07_admit_fragments", f"""WITH {DOCS}
    SELECT document_id, count(*) AS fragments FROM frag WHERE document_id IN (SELECT document_id FROM docs WHERE parse_status = 'PARSED') GROUP BY 1""")
def d07(f: Frames) -> DataFrame:
    _, docs = d.page_quality(f.pages())
    return d.admit_fragments(d.segment_pages(_placed(f)), docs).groupBy("document_id").agg(F.count(F.lit(1)).alias("fragments"))


@query("d08_latest_version", """
    SELECT document_id, max(version) AS version, arg_max(content_hash, version) AS content_hash FROM (
        SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_seen, content_hash) AS version FROM (
            SELECT user_id AS document_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS content_hash, min(ts) AS first_seen
            FROM events GROUP BY 1, 2)) GROUP BY 1""")
def d08(f: Frames) -> DataFrame:
    contents = f.table("events").select(
        F.col("user_id").alias("document_id"), F.get_json_object("props", "$.k").alias("content_hash"), F.col("ts").alias("seen_at")
    )
    return d.latest_version(d.version_documents(contents)).select("document_id", "version", "content_hash")


@query("d09_list_evidence", """
    SELECT document_id, page_number, char_start, checksum FROM fragc
    WHERE document_id = (SELECT concat('c', max(conv_id)) FROM conversations) ORDER BY page_number, char_start, checksum LIMIT 20""")
def d09(f: Frames) -> DataFrame:
    wanted = f.table("conversations").agg(F.concat(F.lit("c"), F.max("conv_id").cast("string"))).scalar()
    return d.list_evidence(d.segment_pages(_placed(f)), wanted, 20).select("document_id", "page_number", "char_start", "checksum")


@query("d10_reconcile_storage", """
    SELECT DISTINCT concat('key-', o_custkey) AS storage_key, 'MISSING_FILE' AS finding, 'DOWNLOAD_PENDING' AS next_status FROM orders
    WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')
    UNION ALL SELECT concat('key-', c_custkey), 'ORPHAN_FILE', NULL FROM customer
    WHERE c_mktsegment <> 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def d10(f: Frames) -> DataFrame:
    versions = f.table("orders").selectExpr(
        "concat('key-', o_custkey) AS storage_key", "CASE o_orderstatus WHEN 'F' THEN 'DOWNLOADED' ELSE 'DISCOVERED' END AS download_status"
    )
    listing = f.table("customer").filter("c_mktsegment <> 'MACHINERY'").selectExpr("concat('key-', c_custkey) AS storage_key")
    return d.reconcile_storage(versions, listing)


@query("d11_download_policy", r"""
    WITH file AS (SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'http' END AS scheme, concat('host', page_id % 4, '.example.com') AS host,
        CASE WHEN page_id % 7 = 0 THEN 60000000 ELSE length(html) END AS size, CASE WHEN page_id % 5 = 0 THEN 'text/html' ELSE 'application/pdf' END AS mime,
        page_id % 6 = 0 AS bare FROM pages)
    SELECT page_id, CASE WHEN scheme <> 'https' THEN concat('non-https scheme rejected: ', scheme)
        WHEN host NOT IN ('host0.example.com', 'host1.example.com', 'host2.example.com') THEN concat('domain not whitelisted: ', host)
        WHEN size > 52428800 THEN 'file too large' WHEN mime NOT LIKE '%pdf%' THEN 'unexpected mime type' WHEN bare THEN 'magic bytes missing' END AS rejected
    FROM file""")
def d11(f: Frames) -> DataFrame:
    files = f.table("pages").selectExpr(
        "page_id", "concat(CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'http' END, '://Host', page_id % 4, '.example.com/a?b=c') AS url",
        "CASE WHEN page_id % 7 = 0 THEN 60000000 ELSE length(html) END AS size",
        "CASE WHEN page_id % 5 = 0 THEN 'text/html' ELSE 'application/pdf' END AS mime_type",
        "CASE WHEN page_id % 6 = 0 THEN html ELSE concat('%PDF-1.7', html) END AS head",
    )
    return d.download_policy(files, [f"host{i}.example.com" for i in range(3)]).select("page_id", "rejected")


@query("d12_download_state", """
    WITH e AS (SELECT user_id * 100 + CAST(json_extract(props, '$.k') AS INT) // 10 AS version_id, ts, event_id,
        CASE event_type WHEN 'click' THEN 'DOWNLOAD_PENDING' WHEN 'view' THEN 'DOWNLOADING' WHEN 'purchase' THEN 'DOWNLOADED'
             WHEN 'signup' THEN 'DOWNLOADING' ELSE 'DOWNLOAD_FAILED_RETRYABLE' END AS status FROM events)
    SELECT version_id, count(*) FILTER (status = 'DOWNLOADING') AS attempts,
           CASE WHEN arg_max(status, (ts, event_id)) = 'DOWNLOADED' THEN 'DOWNLOADED'
                WHEN count(*) FILTER (status = 'DOWNLOADING') >= 3 THEN 'DOWNLOAD_FAILED_FINAL'
                WHEN arg_max(status, (ts, event_id)) = 'DOWNLOADING' THEN 'DOWNLOAD_FAILED_RETRYABLE'
                ELSE arg_max(status, (ts, event_id)) END AS download_status FROM e GROUP BY 1""")
def d12(f: Frames) -> DataFrame:
    events = f.table("events").selectExpr(
        "user_id * 100 + CAST(get_json_object(props, '$.k') AS INT) div 10 AS version_id", "ts AS at", "event_id",
        "CASE event_type WHEN 'click' THEN 'DOWNLOAD_PENDING' WHEN 'view' THEN 'DOWNLOADING' WHEN 'purchase' THEN 'DOWNLOADED' "
        "WHEN 'signup' THEN 'DOWNLOADING' ELSE 'DOWNLOAD_FAILED_RETRYABLE' END AS status",
    )
    return d.download_state(events).select("version_id", "attempts", "download_status")


@query("d13_document_freshness", """
    SELECT source AS source_system, max(ts) AS last_download_at, count(*) AS downloaded_versions
    FROM documents JOIN events ON event_id // 10 = doc_id GROUP BY 1""")
def d13(f: Frames) -> DataFrame:
    docs = f.table("documents").selectExpr("doc_id AS document_id", "source AS source_system")
    versions = f.table("events").selectExpr("event_id div 10 AS document_id", "ts AS downloaded_at")
    return d.document_freshness(docs, versions)


@query("d14_profile_fragments", """
    SELECT l.company_id, row_number() OVER (PARTITION BY r.rid ORDER BY o) AS page_number, t AS quote_text, length(t) AS char_end,
           sha256(concat('frag:', r.ts_code, ':', o - 1 - CASE WHEN o = 2 AND first_missing THEN 1 ELSE 0 END, ':', t)) AS checksum
    FROM (SELECT rid, ts_code, introduction AS t, 1 AS o, false AS first_missing FROM raw_com WHERE introduction IS NOT NULL
          UNION ALL SELECT rid, ts_code, main_business, 2, introduction IS NULL FROM raw_com) r
    JOIN security s ON s.ts_code = r.ts_code JOIN links l ON l.security_id = s.security_id""")
def d14(f: Frames) -> DataFrame:
    companies = f.securities().select("ts_code", "security_id").join(f.links(), "security_id").select("ts_code", "company_id")
    return d.profile_fragments(f.raw_companies(), companies).select("company_id", "page_number", "quote_text", "char_end", "checksum")
