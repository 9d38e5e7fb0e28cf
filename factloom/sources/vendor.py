"""Vendor pages: scan, classify, gate, land."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions.hashing import payload_hash, schema_signature
from factloom.operators.scaling import neighbour
from factloom.sources.registry import Dataset

# Words that mark a rate-limit answer, and codes that mark a permission answer (fixed values)
RATE_HINTS = ["频率", "每分钟", "rate", "limit", "429"]
NO_PERMISSION_CODES = [-2001, -2002, -2003]


def read_vendor_pages(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Page files of one dataset as ``(dataset, file, offset, code, msg, fields, items)``."""
    pages = (
        spark.read.option("multiLine", True)
        .schema(schemas.VENDOR_PAGE)
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("file"))
    )
    offset = F.regexp_extract("file", r"\.page(\d+)\.json$", 1).try_cast("bigint")
    return pages.select(
        F.lit(dataset).alias("dataset"),
        "file",
        F.coalesce(offset, F.lit(0)).alias("offset"),
        "code",
        "msg",
        F.col("data.fields").alias("fields"),
        F.col("data.items").alias("items"),
    )


def parse_vendor_pages(df: DataFrame, json_col: str = "body") -> DataFrame:
    """S1 on a column of JSON bodies (a landed or streamed page table)."""
    page = F.from_json(json_col, schemas.VENDOR_PAGE)
    return (
        df.withColumn("_page", page)
        .withColumns({
            "code": F.col("_page.code"),
            "msg": F.col("_page.msg"),
            "fields": F.col("_page.data.fields"),
            "items": F.col("_page.data.items"),
        })
        .drop("_page", json_col)
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """One row per item with ``payload`` = field -> value; short items give fewer keys."""
    width = F.least(F.size("fields"), F.size("item"))
    return (
        pages.select("*", F.posexplode("items").alias("row_no", "item"))
        .withColumn(
            "payload",
            F.map_from_arrays(F.slice("fields", 1, width), F.slice("item", 1, width)),
        )
        .drop("items", "item")
    )


def classify_response(df: DataFrame) -> DataFrame:
    """``error_code`` is NULL for code 0; rate hints are tested before permission codes."""
    text = F.lower(F.coalesce("msg", F.lit("unknown error")))
    hinted = text.rlike("|".join(RATE_HINTS))
    code = F.col("code")
    return df.withColumn(
        "error_code",
        F.when(code == 0, F.lit(None).cast("string"))
        .when(hinted | (code == 429), "RATE_LIMITED")
        .when(code.isin(NO_PERMISSION_CODES), "NO_PERMISSION")
        .when(code.isin(-1, -2), "INVALID_REQUEST")
        .when(code == -4001, "SCHEMA_CHANGED")
        .otherwise("UNKNOWN"),
    )


def with_payload_hash(df: DataFrame, payload: str = "payload") -> DataFrame:
    """S3."""
    return df.withColumn("payload_hash", payload_hash(F.col(payload)))


def with_signature(pages: DataFrame, dataset: Dataset) -> DataFrame:
    """Signature over the identity fields only."""
    return pages.withColumn(
        "schema_signature", schema_signature(F.col("fields"), list(dataset.required))
    )


def drift_gate(
    pages: DataFrame, dataset: Dataset, run: str = "run_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ok, fused, markers)``.

    A page is fused when a required field is absent or its identity signature
    differs from the page before it in the same run. Pages after the first fused
    page of a run are not taken either, as the run ends there.
    """
    required = F.array(*[F.lit(f) for f in dataset.required])
    expected = F.array(*[F.lit(f) for f in dataset.expected]).cast("array<string>")
    order = Window.partitionBy("dataset", run).orderBy("offset")
    # Judged on the field names alone, so that page bodies are not shuffled
    judged = (
        with_signature(pages.select("dataset", run, "offset", "fields"), dataset)
        .withColumn("missing_required", F.array_except(required, "fields"))
        .withColumn("_previous", F.lag("schema_signature").over(order))
        .withColumn(
            "drift_reason",
            F.when(
                F.size("missing_required") > 0,
                F.concat(F.lit("required fields missing: "), F.array_join("missing_required", ",")),
            ).when(F.col("_previous") != F.col("schema_signature"), "identity signature changed"),
        )
        .drop("_previous")
    )
    stops = (
        judged.filter(F.col("drift_reason").isNotNull())
        .groupBy("dataset", run)
        .agg(F.min("offset").alias("_stop"))
    )
    fused = (
        judged.join(stops, ["dataset", run])
        .filter(F.col("offset") == F.col("_stop"))
        .withColumn("status", F.lit("SCHEMA_CHANGED"))
        .drop("_stop")
    )
    ok = (
        with_signature(pages, dataset)
        .withColumn("missing_expected_fields", F.array_except(expected, "fields"))
        .join(stops, ["dataset", run], "left")
        .filter(F.col("_stop").isNull() | (F.col("offset") < F.col("_stop")))
        .drop("_stop")
    )
    markers = ok.filter(F.size("missing_expected_fields") > 0).select(
        "dataset", run, "offset", "missing_expected_fields"
    )
    return ok, fused, markers


def row_accepted(payload: Column, required: Iterable[str]) -> Column:
    """S6 condition: every required key present, the first one not empty."""
    required = list(required)
    present = F.lit(True)
    for key in required:
        present = present & F.map_contains_key(payload, key)
    if not required:
        return present
    return present & (F.coalesce(F.try_element_at(payload, F.lit(required[0])), F.lit("")) != "")


def split_rows(df: DataFrame, required: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    good = row_accepted(F.col("payload"), required)
    return df.filter(good), df.filter(~good)


def land_raw(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``batch`` with ``inserted`` = first sight of (source, api, hash).

    The caller appends the rows flagged ``inserted``. The first row of a key in
    (offset, row_no) order wins; it is found by a partial aggregation and joined
    back on its position, so that many copies of one payload stay spread.
    """
    keys = ["source_system", "api_name", "payload_hash"]
    first = (
        batch.groupBy(*keys)
        .agg(F.min(F.struct("offset", "row_no")).alias("_at"))
        .join(existing.select(*keys), keys, "left_anti")
        .select(*keys, "_at.offset", "_at.row_no", F.lit(True).alias("inserted"))
    )
    return batch.join(first, [*keys, "offset", "row_no"], "left").withColumn(
        "inserted", F.coalesce("inserted", F.lit(False))
    )


def new_raw_rows(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Only the rows to append; partial aggregation drops copies before the shuffle."""
    keys = ["source_system", "api_name", "payload_hash"]
    return batch.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def mark_duplicate_pages(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Page hash against the page before; one row per page that has rows.

    The page hash adds up a position-salted hash per row, so that no page is
    collected into one list and rows still count in their order.
    """
    part = F.xxhash64("row_no", "payload_hash").cast("decimal(20,0)")
    pages = rows.groupBy("dataset", run, "offset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.sum(part)), 256).alias("page_hash"),
    )
    order = Window.partitionBy("dataset", run).orderBy("offset")
    return pages.withColumn(
        "duplicate_page",
        F.coalesce(F.lag("page_hash").over(order) == F.col("page_hash"), F.lit(False)),
    )


def page_plan(pages: DataFrame, page_size: int, run: str = "run_id") -> DataFrame:
    """Next offset per page, the last page, and pages whose successor is missing."""
    short = F.col("rows") < page_size
    return (
        neighbour(pages, ["dataset", run], ["offset"], "offset", "_following", ahead=True)
        .withColumn("last_page", short)
        .withColumn("next_offset", F.when(~short, F.col("offset") + F.col("rows")))
        .withColumn(
            "gap",
            ~short & F.coalesce(F.col("_following") != F.col("next_offset"), F.lit(True)),
        )
        .drop("_following")
    )


def summarize_run(events: DataFrame) -> DataFrame:
    """Counters and status per run.

    ``events``: ``run_id, received, inserted, rejected, requests, anomaly, failure_class``.
    """
    failed = F.col("failures") > 0
    return (
        events.groupBy("run_id")
        .agg(
            F.sum("received").alias("rows_received"),
            F.sum("inserted").alias("rows_inserted"),
            F.sum("rejected").alias("rows_rejected"),
            F.sum("requests").alias("request_count"),
            F.count("failure_class").alias("failures"),
            F.count_if(F.col("failure_class") == "TRANSIENT").alias("transient"),
            F.collect_set("anomaly").alias("anomalies"),
        )
        .withColumn(
            "anomalies",
            F.array_sort(
                F.when(
                    F.col("rows_rejected") > 0,
                    F.array_union("anomalies", F.array(F.lit("rejected_rows"))),
                ).otherwise(F.col("anomalies"))
            ),
        )
        .withColumn(
            "status",
            F.when(failed & (F.col("transient") == F.col("failures")), "FAILED_RETRYABLE")
            .when(failed, "FAILED_FINAL")
            .when(F.size("anomalies") > 0, "PARTIAL_SUCCESS")
            .otherwise("SUCCEEDED"),
        )
        .drop("failures", "transient")
    )


def latest_capability(probes: DataFrame) -> DataFrame:
    """Newest probe per (source, api)."""
    rest = [c for c in probes.columns if c not in ("source_system", "api_name")]
    newest = F.max_by(F.struct(*rest), F.struct("checked_at", *[c for c in rest if c != "checked_at"]))
    return probes.groupBy("source_system", "api_name").agg(newest.alias("_s")).select(
        "source_system", "api_name", "_s.*"
    )


PROBE_FAILURES = [
    "SCHEMA_CHANGED", "NO_PERMISSION", "SEPARATE_PERMISSION_REQUIRED", "RATE_LIMITED",
    "NETWORK_ERROR", "UNKNOWN",
]


def replay_resets(caps: DataFrame, requests: DataFrame, probes: DataFrame) -> DataFrame:
    """Outcome per reset request.

    ``caps``: ``source_system, api_name, status, detail`` (one row per api);
    ``requests``: ``request_id, source_system, api_name``; ``probes``:
    ``request_id, probe_status`` (absent = probe skipped). Only SCHEMA_CHANGED
    resets; an available probe verifies it, a failed one rolls back and keeps
    the earlier detail; anything else is an audited no-op.
    """
    joined = requests.join(caps, ["source_system", "api_name"], "left").join(
        probes, "request_id", "left"
    )
    probe = F.col("probe_status")
    return joined.select(
        "request_id",
        "source_system",
        "api_name",
        F.col("status").alias("before_status"),
        F.when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("status") != "SCHEMA_CHANGED", F.col("status"))
        .when(probe.isNull() | (probe == "AVAILABLE"), "AVAILABLE")
        .when(probe.isin(PROBE_FAILURES), probe)
        .otherwise("UNKNOWN")
        .alias("after_status"),
        F.coalesce(F.col("status") == "SCHEMA_CHANGED", F.lit(False)).alias("reset_applied"),
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status") != "SCHEMA_CHANGED", "no_op")
        .when(probe.isNull(), "probe_skipped")
        .when(probe == "AVAILABLE", "probe_available")
        .otherwise("reset_verification_failed")
        .alias("outcome"),
        F.when((F.col("status") == "SCHEMA_CHANGED") & probe.isNull(), "reset_pending")
        .when((F.col("status") == "SCHEMA_CHANGED") & (probe == "AVAILABLE"), "reset_verified")
        .otherwise(F.col("detail"))
        .alias("detail"),
    )


def select_catalog(caps: DataFrame, primary: str, official: str) -> DataFrame:
    """One row: the primary catalog when available, else the official one."""
    available = F.coalesce(F.bool_or(F.col("status") == "AVAILABLE"), F.lit(False))
    return caps.filter(F.col("api_name") == primary).agg(
        F.when(available, F.lit(primary)).otherwise(F.lit(official)).alias("selected_source"),
        F.when(~available, F.lit(primary)).alias("fallback_from"),
    )


def field_shapes(raw: DataFrame) -> DataFrame:
    """Distinct payload keys per api, no values."""
    return (
        raw.select("api_name", F.explode(F.map_keys("payload")).alias("field"))
        .groupBy("api_name", "field")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# Credential patterns (fixed values)
URL_CREDENTIALS = r"://([^:/@\s]+):([^@/\s]+)@"
KEY_VALUE_SECRET = (
    r"""(?i)(password|passwd|token|secret|api[_-]?key)\s*[=:]\s*['"]?([^\s'",;&]+)"""
)


def mask_text(col: Column, limit: int = 500) -> Column:
    """S17 expression."""
    masked = F.regexp_replace(col, URL_CREDENTIALS, "://$1:***@")
    return F.substring(F.regexp_replace(masked, KEY_VALUE_SECRET, "$1=***"), 1, limit)


def mask_secrets(df: DataFrame, cols: list[str], limit: int = 500) -> DataFrame:
    """S17."""
    return df.withColumns({c: mask_text(F.col(c), limit) for c in cols})


def volume_gate(runs: DataFrame, max_drop: float) -> DataFrame:
    """Runs whose row count fell by more than ``max_drop`` against the run before."""
    return neighbour(runs, ["dataset"], ["started_at", "run_id"], "rows", "previous_rows").withColumn(
        "blocked",
        F.coalesce(F.col("rows") < F.col("previous_rows") * (1 - max_drop), F.lit(False)),
    )


