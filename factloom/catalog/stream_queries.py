"""M rows: the same tables read as streams, run until they are caught up."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.catalog.review_queries import FOLD, STATUS_SQL
from factloom.catalog.source_queries import BASIC, STOP
from factloom.functions.clean import LONG_TS_CODE
from factloom.operators.standardize import securities
from factloom.session import ensure_checkpoint_dir
from factloom.sources.bindings import PREDICATE_BY_EVENT, Frames
from factloom.sources import vendor
from factloom.streaming import streams


def _work(f: Frames) -> str:
    return f"{ensure_checkpoint_dir(f.spark)}/streams/{uuid.uuid4().hex}"


def _table_stream(f: Frames, name: str) -> DataFrame:
    """A driver table as a file stream."""
    reader = f.spark.readStream.schema(f.table(name).schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(f.dir)


def _collected(stream: DataFrame, work: str) -> DataFrame:
    """Run a stateful stream to its end and read back what it wrote."""
    running = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{work}/checkpoint").option("path", f"{work}/rows")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return stream.sparkSession.read.parquet(f"{work}/rows")


LANDED_SQL = f"""WITH {STOP}
    SELECT ts_code, CAST(r.run_id AS VARCHAR) AS run_id FROM vrow r LEFT JOIN stop USING (run_id) WHERE stop.at IS NULL OR page_offset < stop.at"""


def _landed(f: Frames, files: int, files_per_batch: int) -> DataFrame:
    """Vendor pages spread over files without regard to their order, landed as a stream."""
    work = _work(f)
    f.vendor_pages().repartition(files, F.xxhash64("run_id", "offset")).write.parquet(f"{work}/landing")
    schema = f.spark.read.parquet(f"{work}/landing").schema
    stream = f.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{work}/landing")
    pages = vendor.parse_vendor_pages(stream)
    streams.land_pages(pages, BASIC, f"{work}/raw", f"{work}/checkpoint", step=100).awaitTermination()
    raw = streams.read_batches(f.spark, f"{work}/raw", "payload map<string,string>, run_id string")
    return raw.select(F.try_element_at("payload", F.lit("ts_code")).alias("ts_code"), "run_id")


@query("m01_stream_land", LANDED_SQL)
def m01(f: Frames) -> DataFrame:
    return _landed(f, 4, 1000)


@query("m01_stream_land_in_batches", LANDED_SQL)
def m01_in_batches(f: Frames) -> DataFrame:
    """The same pages, one file per micro-batch: pages of a run come in several batches, some early."""
    return _landed(f, 4, 1)


@query("m01_gate_outcomes", f"""WITH {STOP}
    SELECT CAST(p.run_id AS VARCHAR) AS run_id, p.page_offset AS "offset",
           CASE WHEN stop.at IS NULL OR p.page_offset < stop.at THEN 'taken' WHEN p.page_offset = stop.at THEN 'fused' ELSE 'skipped' END AS outcome
    FROM vpage p LEFT JOIN stop USING (run_id)""")
def m01_outcomes(f: Frames) -> DataFrame:
    """Every page with its outcome, so that no page is lost between batches."""
    work = _work(f)
    f.vendor_pages().repartition(3, F.xxhash64("run_id", "offset")).write.parquet(f"{work}/landing")
    schema = f.spark.read.parquet(f"{work}/landing").schema
    stream = f.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/landing")
    gated = streams.gate_pages(vendor.parse_vendor_pages(stream), BASIC, step=100)
    return _collected(gated, work).select("run_id", "offset", "outcome")


@query("m02_stream_normalize", "SELECT ts_code, name, status FROM std_sec")
def m02(f: Frames) -> DataFrame:
    work = _work(f)
    f.raw_securities().write.parquet(f"{work}/raw")
    schema = f.spark.read.parquet(f"{work}/raw").schema
    raw = f.spark.readStream.schema(schema).parquet(f"{work}/raw")
    streams.stream_normalize(raw, partial(securities, code_form=LONG_TS_CODE), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return f.spark.read.parquet(f"{work}/out/rows/batch=*").select("ts_code", "name", "status")


def _claim_stream(f: Frames) -> DataFrame:
    """Claims as outbox events of (subject, product), read as a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    digit = k % 10
    predicate = F.create_map(*[F.lit(x) for p in PREDICATE_BY_EVENT.items() for x in p])
    return _table_stream(f, "events").select(
        F.concat_ws(":", "user_id", F.expr("CAST(get_json_object(props, '$.k') AS INT) div 4 + 1")).alias("claim_id"),
        F.col("event_id").cast("string").alias("idempotency_key"),
        F.col("user_id").alias("subject_id"), F.lit(1).alias("object_id"),
        F.when(digit < 5, "ACCEPTED").when(digit == 5, "NEEDS_REVIEW").when(digit == 6, "VALIDATED")
        .when(digit == 7, "CONTRADICTED").when(digit == 8, "SUPERSEDED").otherwise("REJECTED").alias("claim_status"),
        F.lit("UNKNOWN").alias("business_stage"), F.lit("PRODUCT_DISCLOSED").alias("evidence_state"),
        F.element_at(predicate, F.col("event_type")).alias("predicate_code"),
        (k.cast("double") / 100).alias("confidence"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), k)).alias("recorded_at"),
        F.col("ts").alias("valid_from"), F.col("ts").alias("valid_to"),
    )


@query("m03_stream_project", """
    SELECT concat(subject_id, ':', k // 4 + 1) AS claim_id, max(recorded_at) AS recorded_at, arg_max(claim_status, (recorded_at, claim_status)) AS claim_status
    FROM claim GROUP BY 1""")
def m03(f: Frames) -> DataFrame:
    work = _work(f)
    streams.stream_project(_claim_stream(f), f"{work}/versions", f"{work}/checkpoint").awaitTermination()
    nodes, _ = streams.current_projection(f.spark, f"{work}/versions")
    return nodes.select("claim_id", "recorded_at", "claim_status")


@query("m04_latest_per_entity", """
    SELECT event_id, coalesce(recorded_at >= max(recorded_at) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted
    FROM (SELECT event_id, user_id, ts + to_hours(CAST(json_extract(props, '$.k') AS INT)) AS recorded_at FROM events)""")
def m04(f: Frames) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stream = _table_stream(f, "events").select(
        "event_id", "user_id", (F.col("ts") + F.make_dt_interval(F.lit(0), k)).alias("recorded_at")
    )
    guarded = streams.latest_per_entity(stream, "user_id", "recorded_at", "event_id")
    return _collected(guarded, _work(f)).select("event_id", "accepted")


@query("m05_enforce_states", f"""WITH RECURSIVE {FOLD} SELECT event_id, from_status, ok AS legal FROM fold""")
def m05(f: Frames) -> DataFrame:
    stream = _table_stream(f, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).selectExpr(
        "user_id AS entity_id", "event_id", f"{STATUS_SQL} AS to_status"
    )
    checked = streams.enforce_states(stream, "claim", "EXTRACTED")
    return _collected(checked, _work(f)).select("event_id", "from_status", "legal")
