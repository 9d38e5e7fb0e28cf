"""S rows: vendor pages, landing and run bookkeeping over customers, events and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.sources import sinks, vendor
from factloom.sources.bindings import Frames
from factloom.sources.registry import DATASETS

BASIC = DATASETS["stock_basic"]


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _rows(f: Frames) -> DataFrame:
    return vendor.page_rows(vendor.parse_vendor_pages(f.vendor_pages()))


@query("s01_vendor_page_scan", """
    SELECT run_id, page_offset AS "offset", ts_code, symbol, CASE WHEN layout <> 2 THEN name END AS name,
           CASE WHEN layout = 1 THEN NULL ELSE 'SSE' END AS exchange,
           CASE WHEN security_id % 10 <> 0 THEN 'L' END AS list_status FROM vrow""")
def s01(f: Frames) -> DataFrame:
    get = lambda name: F.try_element_at("payload", F.lit(name)).alias(name)
    return _rows(f).select("run_id", "offset", *[get(n) for n in ("ts_code", "symbol", "name", "exchange", "list_status")])


@query("s02_classify_response", """
    SELECT event_id, CASE WHEN code = 0 THEN NULL
        WHEN regexp_matches(lower(msg), '频率|每分钟|rate|limit|429') OR code = 429 THEN 'RATE_LIMITED'
        WHEN code IN (-2001, -2002, -2003) THEN 'NO_PERMISSION' WHEN code IN (-1, -2) THEN 'INVALID_REQUEST'
        WHEN code = -4001 THEN 'SCHEMA_CHANGED' ELSE 'UNKNOWN' END AS error_code
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 429 WHEN 'purchase' THEN -2002
              WHEN 'signup' THEN -1 ELSE CASE WHEN value > 20 THEN -4001 ELSE -9999 END END AS code,
          CASE WHEN value > 60 THEN 'Rate exceeded' ELSE event_type END AS msg FROM events)""")
def s02(f: Frames) -> DataFrame:
    answers = f.table("events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 429 WHEN 'purchase' THEN -2002 WHEN 'signup' THEN -1 "
        "ELSE CASE WHEN value > 20 THEN -4001 ELSE -9999 END END AS code",
        "CASE WHEN value > 60 THEN 'Rate exceeded' ELSE event_type END AS msg",
    )
    return vendor.classify_response(answers).select("event_id", "error_code")


@query("s03_payload_hash", """
    SELECT event_id, sha256(concat('{"a":"', CAST(json_extract(props, '$.k') AS INT), '","b":"', event_type, '","c":null}')) AS payload_hash
    FROM events""")
def s03(f: Frames) -> DataFrame:
    rows = f.table("events").select(
        "event_id",
        F.create_map(F.lit("b"), "event_type", F.lit("c"), F.lit(None).cast("string"), F.lit("a"), _k().cast("string")).alias("payload"),
    )
    return vendor.with_payload_hash(rows).select("event_id", "payload_hash")


@query("s04_schema_signature", """SELECT run_id, page_offset AS "offset", sha256(sig) AS schema_signature FROM vpage""")
def s04(f: Frames) -> DataFrame:
    pages = vendor.parse_vendor_pages(f.vendor_pages())
    return vendor.with_signature(pages, BASIC).select("run_id", "offset", "schema_signature")


STOP = """stop AS (SELECT run_id, min(page_offset) AS at FROM vpage WHERE layout = 2 OR before_sig <> sig GROUP BY 1)"""


@query("s05_drift_gate", f"""WITH {STOP}
    SELECT p.run_id, p.page_offset AS "offset", CASE WHEN stop.at = p.page_offset THEN 'fused'
        WHEN layout = 1 THEN 'exchange' ELSE '' END AS outcome
    FROM vpage p LEFT JOIN stop USING (run_id) WHERE stop.at IS NULL OR p.page_offset <= stop.at""")
def s05(f: Frames) -> DataFrame:
    ok, fused, _ = vendor.drift_gate(vendor.parse_vendor_pages(f.vendor_pages()), BASIC)
    return ok.select("run_id", "offset", F.array_join("missing_expected_fields", ",").alias("outcome")).unionByName(
        fused.select("run_id", "offset", F.lit("fused").alias("outcome"))
    )


@query("s06_split_rows", "SELECT ts_code, layout <> 2 AS accepted FROM vrow")
def s06(f: Frames) -> DataFrame:
    good, bad = vendor.split_rows(_rows(f), BASIC.required)
    code = F.try_element_at("payload", F.lit("ts_code")).alias("ts_code")
    return good.select(code, F.lit(True).alias("accepted")).unionByName(bad.select(code, F.lit(False).alias("accepted")))


def _batch(f: Frames) -> DataFrame:
    rows = f.table("events").select(
        F.lit("VENDOR").alias("source_system"), F.col("event_type").alias("api_name"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), _k().cast("string")).alias("payload"),
        F.col("event_id").alias("offset"), F.lit(0).alias("row_no"), "ts",
    )
    return vendor.with_payload_hash(rows)


LANDED = """
    keyed AS (SELECT event_id, ts, event_type, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
    known AS (SELECT DISTINCT event_type, user_id, k FROM keyed WHERE ts < TIMESTAMP '2024-01-08'),
    first_seen AS (SELECT event_type, user_id, k, min(event_id) AS event_id FROM keyed GROUP BY 1, 2, 3)"""


@query("s07_land_raw", f"""WITH {LANDED}
    SELECT d.event_id AS "offset", fs.event_id IS NOT NULL AND kn.k IS NULL AS inserted FROM keyed d
    LEFT JOIN first_seen fs ON fs.event_id = d.event_id
    LEFT JOIN known kn ON kn.event_type = d.event_type AND kn.user_id = d.user_id AND kn.k = d.k""")
def s07(f: Frames) -> DataFrame:
    batch = _batch(f)
    existing = batch.filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    return vendor.land_raw(batch, existing).select("offset", "inserted")


@query("s07_new_raw_rows", f"""WITH {LANDED}
    SELECT event_type AS api_name, count(*) AS rows FROM first_seen
    WHERE (event_type, user_id, k) NOT IN (SELECT (event_type, user_id, k) FROM known) GROUP BY 1""")
def s07b(f: Frames) -> DataFrame:
    batch = _batch(f)
    existing = batch.filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    return vendor.new_raw_rows(batch, existing).groupBy("api_name").agg(F.count(F.lit(1)).alias("rows"))


@query("s08_duplicate_pages", """
    SELECT c_custkey // 1000 AS run_id, c_custkey // 10 AS "offset", count(*) AS rows,
           (c_custkey // 10) % 2 = 1 AND count(*) = 10 AS duplicate_page
    FROM customer GROUP BY 1, 2, (c_custkey // 10) % 2""")
def s08(f: Frames) -> DataFrame:
    rows = f.table("customer").selectExpr(
        "'stock_basic' AS dataset", "c_custkey div 1000 AS run_id", "c_custkey div 10 AS offset",
        "CAST(c_custkey % 10 AS INT) AS row_no", "sha2(concat_ws('|', c_custkey div 20, c_custkey % 10), 256) AS payload_hash",
    )
    return vendor.mark_duplicate_pages(rows).select("run_id", "offset", "rows", "duplicate_page")


@query("s09_page_plan", """
    SELECT dataset, "offset", rows, rows < 20 AS last_page, CASE WHEN rows >= 20 THEN "offset" + rows END AS next_offset,
           rows >= 20 AND coalesce(lead("offset") OVER (PARTITION BY dataset ORDER BY "offset") <> "offset" + rows, true) AS gap
    FROM (SELECT event_type AS dataset, (event_id // 100) * 20 AS "offset", count(*) AS rows FROM events GROUP BY 1, 2)""")
def s09(f: Frames) -> DataFrame:
    pages = f.table("events").groupBy(
        F.col("event_type").alias("dataset"), F.lit("r").alias("run_id"), (F.expr("event_id div 100") * 20).alias("offset")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return vendor.page_plan(pages, 20).drop("run_id")


@query("s10_summarize_run", """
    WITH e AS (SELECT user_id AS run_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events),
    a AS (SELECT run_id, sum(k) AS rows_received, sum(k // 2) AS rows_inserted,
            sum(CASE WHEN k = 50 AND run_id % 2 = 0 THEN 1 ELSE 0 END) AS rows_rejected, count(*) AS request_count,
            bool_or(event_type = 'error' AND k = 20) AS dup,
            count(*) FILTER (event_type = 'signup' AND k = 40) AS tr, count(*) FILTER (event_type <> 'signup' AND k = 97) AS te
          FROM e GROUP BY 1)
    SELECT run_id, rows_received, rows_inserted, rows_rejected, request_count,
           concat_ws(',', CASE WHEN dup THEN 'duplicate_page' END, CASE WHEN rows_rejected > 0 THEN 'rejected_rows' END) AS anomalies,
           CASE WHEN te > 0 THEN 'FAILED_FINAL' WHEN tr > 0 THEN 'FAILED_RETRYABLE'
                WHEN dup OR rows_rejected > 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCEEDED' END AS status FROM a""")
def s10(f: Frames) -> DataFrame:
    events = f.table("events").withColumn("k", _k()).selectExpr(
        "user_id AS run_id", "CAST(k AS BIGINT) AS received", "CAST(k div 2 AS BIGINT) AS inserted",
        "CASE WHEN k = 50 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS rejected", "1 AS requests",
        "CASE WHEN event_type = 'error' AND k = 20 THEN 'duplicate_page' END AS anomaly",
        "CASE WHEN event_type = 'signup' AND k = 40 THEN 'TRANSIENT' WHEN event_type <> 'signup' AND k = 97 THEN 'TERMINAL' END AS failure_class",
    )
    return vendor.summarize_run(events).withColumn("anomalies", F.array_join("anomalies", ","))


CAPS = """caps AS (SELECT event_type AS source_system, user_id AS api_name, max(ts) AS checked_at,
        arg_max(CASE WHEN k < 30 THEN 'SCHEMA_CHANGED' WHEN k < 80 THEN 'AVAILABLE' ELSE 'NO_PERMISSION' END, ts) AS status,
        arg_max(concat('detail-', k), ts) AS detail
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY 1, 2)"""


def _caps(f: Frames) -> DataFrame:
    probes = f.table("events").withColumn("k", _k()).selectExpr(
        "event_type AS source_system", "user_id AS api_name", "ts AS checked_at",
        "CASE WHEN k < 30 THEN 'SCHEMA_CHANGED' WHEN k < 80 THEN 'AVAILABLE' ELSE 'NO_PERMISSION' END AS status",
        "concat('detail-', k) AS detail",
    )
    return vendor.latest_capability(probes)


@query("s11_latest_capability", f"WITH {CAPS} SELECT * FROM caps")
def s11(f: Frames) -> DataFrame:
    return _caps(f)


@query("s12_replay_resets", f"""WITH {CAPS}
    SELECT r.event_id AS request_id, c.status AS before_status,
        CASE WHEN c.status IS NULL THEN 'NOT_FOUND' WHEN c.status <> 'SCHEMA_CHANGED' THEN c.status
             WHEN r.probe IS NULL OR r.probe = 'AVAILABLE' THEN 'AVAILABLE' WHEN r.probe = 'RATE_LIMITED' THEN r.probe ELSE 'UNKNOWN' END AS after_status,
        coalesce(c.status = 'SCHEMA_CHANGED', false) AS reset_applied,
        CASE WHEN c.status IS NULL THEN 'not_found' WHEN c.status <> 'SCHEMA_CHANGED' THEN 'no_op' WHEN r.probe IS NULL THEN 'probe_skipped'
             WHEN r.probe = 'AVAILABLE' THEN 'probe_available' ELSE 'reset_verification_failed' END AS outcome,
        CASE WHEN c.status = 'SCHEMA_CHANGED' AND r.probe IS NULL THEN 'reset_pending'
             WHEN c.status = 'SCHEMA_CHANGED' AND r.probe = 'AVAILABLE' THEN 'reset_verified' ELSE c.detail END AS detail
    FROM (SELECT event_id, event_type, user_id, CASE WHEN value < 10 THEN 'AVAILABLE' WHEN value < 20 THEN 'RATE_LIMITED'
              WHEN value < 30 THEN 'ODD' END AS probe FROM events) r
    LEFT JOIN caps c ON c.source_system = r.event_type AND c.api_name = r.user_id""")
def s12(f: Frames) -> DataFrame:
    requests = f.table("events").selectExpr("event_id AS request_id", "event_type AS source_system", "user_id AS api_name")
    probes = f.table("events").filter("value < 30").selectExpr(
        "event_id AS request_id",
        "CASE WHEN value < 10 THEN 'AVAILABLE' WHEN value < 20 THEN 'RATE_LIMITED' ELSE 'ODD' END AS probe_status",
    )
    return vendor.replay_resets(_caps(f), requests, probes).drop("source_system", "api_name")


@query("s13_select_catalog", f"""WITH {CAPS}
    SELECT CASE WHEN coalesce(bool_or(status = 'AVAILABLE'), false) THEN 'click' ELSE 'OFFICIAL_WEB' END AS selected_source,
           CASE WHEN NOT coalesce(bool_or(status = 'AVAILABLE'), false) THEN 'click' END AS fallback_from
    FROM caps WHERE source_system = 'click'""")
def s13(f: Frames) -> DataFrame:
    caps = _caps(f).drop("api_name").withColumnRenamed("source_system", "api_name")
    return vendor.select_catalog(caps, "click", "OFFICIAL_WEB")


@query("s14_layer_round_trip", """
    SELECT period_end, count(*) AS rows, CAST(sum(value) AS DOUBLE) AS total FROM obs GROUP BY 1""")
def s14(f: Frames) -> DataFrame:
    import uuid

    from factloom.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(f.spark)}/layers/{uuid.uuid4().hex}"
    sinks.write_layer(f.observations(), path, "overwrite", ["period_end"])
    return f.spark.read.parquet(path).groupBy("period_end").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").cast("double").alias("total")
    )


@query("s15_manifest", """
    SELECT 'company' AS layer, count(*) AS rows, 'v1' AS version FROM company
    UNION ALL SELECT 'observation', count(*), 'v1' FROM obs UNION ALL SELECT 'claim', count(*), 'v1' FROM claim
    UNION ALL SELECT 'fragment', count(*), 'v1' FROM fragment""")
def s15(f: Frames) -> DataFrame:
    return sinks.build_manifest(
        {"company": f.company(), "observation": f.observations(), "claim": f.claims(), "fragment": f.fragments()}, "v1"
    )


@query("s16_field_shapes", """
    SELECT 'cashflow_vip' AS api_name, field, count(*) AS rows FROM (
        SELECT unnest(['ts_code', 'end_date', 'ann_date', 'report_type', 'update_flag']) AS field FROM raw_stmt
        UNION ALL SELECT 'n_cashflow_act' FROM raw_stmt WHERE present) GROUP BY 2""")
def s16(f: Frames) -> DataFrame:
    return vendor.field_shapes(f.raw_statements())


@query("s17_mask_secrets", r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '://([^:/@\s]+):([^@/\s]+)@', '://\1:***@', 'g'),
        '(?i)(password|passwd|token|secret|api[_-]?key)\s*[=:]\s*[''"]?([^\s''",;&]+)', '\1=***', 'g')) AS masked FROM documents""")
def s17(f: Frames) -> DataFrame:
    # The limit is far above any text, so whole texts are masked
    masked = vendor.mask_secrets(f.table("documents").select("doc_id", "text"), ["text"], 100_000_000)
    return masked.select("doc_id", F.sha2("text", 256).alias("masked"))


@query("s18_volume_gate", """
    SELECT run_id, lag(rows) OVER w AS previous_rows, coalesce(rows < lag(rows) OVER w * 0.5, false) AS blocked
    FROM run WINDOW w AS (PARTITION BY dataset ORDER BY started_at, run_id)""")
def s18(f: Frames) -> DataFrame:
    return vendor.volume_gate(f.runs(), 0.5).select("run_id", "previous_rows", "blocked")
