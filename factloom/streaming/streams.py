"""Structured Streaming forms of the polling loops (M1-M5).

Every sink writes one folder per micro-batch with overwrite, so a batch that is
run again after a failure replaces itself and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom import schemas
from factloom.operators.graph import business_edges, claim_nodes
from factloom.sources import vendor
from factloom.sources.registry import Dataset
from factloom.vocab import STATE_MACHINES


#: Provider of state that keeps it on disk; rows of one key pass through it one by one.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All micro-batch folders of a sink; empty before the first one. A folder that cannot be read is an error."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


class LandingGate(StatefulProcessor):
    """M1: pages of one (dataset, run) in the order of their offsets, whatever the order they come in.

    The state holds the offset that comes next, the signature of the last page
    and whether the run has ended, and pages that came before their turn. A page
    without a required field, or whose signature differs from the page before,
    is fused; the run ends there and later pages are skipped. A page whose
    offset was taken before is taken again (its rows are known by their hash) if
    its signature is still the same.
    """

    OUT = (
        "dataset string, run_id string, offset long, fields array<string>, items array<array<string>>, "
        "schema_signature string, outcome string"
    )

    def __init__(self, first: int, step: int):
        self.first, self.step = first, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "next long, signature string, stopped boolean")
        self.early = handle.getMapState(
            "early", "offset long", "fields array<string>, items array<array<string>>, signature string, missing boolean"
        )

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        following, signature, stopped = self.run.get() if self.run.exists() else (self.first, None, False)

        def out(offset: int, page: tuple, outcome: str) -> Row:
            fields, items, page_signature, _ = page
            items = [list(i) for i in items] if outcome == "taken" else []
            return Row(
                dataset=key[0], run_id=key[1], offset=offset, fields=list(fields), items=items,
                schema_signature=page_signature, outcome=outcome,
            )

        for row in rows:
            offset, page = row.offset, (row.fields, row["items"], row.schema_signature, row.missing)
            if stopped:
                yield out(offset, page, "skipped")
                continue
            if offset < following:
                yield out(offset, page, "taken" if page[2] == signature and not page[3] else "skipped")
                continue
            if offset > following:
                self.early.updateValue((offset,), page)
                continue
            while page is not None:
                if page[3] or (signature is not None and page[2] != signature):
                    yield out(following, page, "fused")
                    stopped = True
                    break
                yield out(following, page, "taken")
                signature, following = page[2], following + self.step
                page = None
                if self.early.containsKey((following,)):
                    page = self.early.getValue((following,))
                    self.early.removeKey((following,))
            if stopped:
                for (offset,), page in list(self.early.iterator()):
                    yield out(offset, page, "skipped")
                self.early.clear()
        self.run.update((following, signature, stopped))

    def close(self) -> None:
        pass


def gate_pages(pages: DataFrame, dataset: Dataset, first: int = 0, step: int | None = None) -> DataFrame:
    """M1: pages ``(dataset, run_id, offset, code, msg, fields, items)`` with their outcome.

    ``outcome`` is taken, fused or skipped. Offsets of a run start at ``first`` and
    grow by ``step`` a page (the page size of the dataset, if not given); a page
    waits in the state until all before it have come.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    required = F.array(*[F.lit(name) for name in dataset.required])
    answered = vendor.classify_response(pages).filter(F.col("error_code").isNull())
    judged = vendor.with_signature(answered, dataset).select(
        "dataset", F.col("run_id").cast("string").alias("run_id"), F.col("offset").cast("long").alias("offset"),
        F.coalesce("fields", F.array().cast("array<string>")).alias("fields"),
        F.coalesce("items", F.array().cast("array<array<string>>")).alias("items"), "schema_signature",
        (F.size(F.array_except(required, F.coalesce("fields", F.array().cast("array<string>")))) > 0).alias("missing"),
    )
    gate = LandingGate(first, dataset.page_size if step is None else step)
    return judged.groupBy("dataset", "run_id").transformWithState(gate, LandingGate.OUT, "Append", "None")


def land_pages(
    pages: DataFrame, dataset: Dataset, sink: str, checkpoint: str, source_system: str = "VENDOR",
    once: bool = True, first: int = 0, step: int | None = None,
) -> StreamingQuery:
    """M1: a stream of pages ``(dataset, run_id, offset, code, msg, fields, items)`` to raw rows.

    The gate and the hashes of all rows landed before are state of the stream, so
    a batch reads no earlier one and the rows landed do not depend on how pages
    fall into batches.
    """
    taken = gate_pages(pages, dataset, first, step).filter(F.col("outcome") == "taken")
    good, _ = vendor.split_rows(vendor.page_rows(taken), dataset.required)
    tagged = good.withColumns({"source_system": F.lit(source_system), "api_name": F.col("dataset")})
    rows = vendor.with_payload_hash(tagged).dropDuplicates(["source_system", "api_name", "payload_hash"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(rows, write, checkpoint, once)


def stream_land(
    spark: SparkSession, path: str, dataset: Dataset, sink: str, checkpoint: str,
    files_per_batch: int = 1000, once: bool = True, step: int = 1,
) -> StreamingQuery:
    """M1: page files to raw rows; the stream checkpoint is the durable cursor.

    Files ``<run>.page<n>.json`` are the pages of a run, numbered from 0 in steps of
    ``step``; any other file is a run of one page.
    """
    name, numbered = F.col("_metadata.file_name"), r"\.page(\d+)\.json$"
    pages = (
        spark.readStream.schema(schemas.VENDOR_PAGE)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
        .select(
            F.lit(dataset.name).alias("dataset"),
            F.regexp_replace(name, numbered, "").alias("run_id"),
            F.coalesce(F.regexp_extract(name, numbered, 1).try_cast("bigint"), F.lit(0)).alias("offset"),
            "code", "msg",
            F.col("data.fields").alias("fields"),
            F.col("data.items").alias("items"),
        )
    )
    return land_pages(pages, dataset, sink, checkpoint, once=once, step=step)


def stream_normalize(
    raw: DataFrame, normalizer: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    sink: str, checkpoint: str, once: bool = True,
) -> StreamingQuery:
    """M2: raw stream to standard rows and rejects; position kept by the checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, rejects = normalizer(batch)
        rows.write.mode("overwrite").parquet(f"{sink}/rows/batch={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{sink}/rejects/batch={batch_id}")

    return _start(raw, write, checkpoint, once)


def project_batch(events: DataFrame) -> DataFrame:
    """Newest version per claim of one batch, as edge rows with their active flag."""
    once = events.dropDuplicates(["idempotency_key"])
    props = ["claim_status", "business_stage", "evidence_state", "predicate_code", "confidence"]
    newest = F.max_by(
        F.struct("recorded_at", *props, "subject_id", "object_id", "valid_from", "valid_to"),
        F.struct("recorded_at", "claim_status"),
    )
    versions = once.groupBy("claim_id").agg(newest.alias("s")).select("claim_id", "s.*")
    return versions.withColumn("active", F.col("claim_status") == "ACCEPTED")


def stream_project(outbox: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """M3: outbox events to claim versions, at least once with idempotent batches.

    Versions are appended and the newest is chosen on read (``current_projection``),
    so no batch rewrites the graph.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        project_batch(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(outbox, write, checkpoint, once)


def current_projection(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """M3: claim nodes and active edges from all versions; older versions never win."""
    versions = spark.read.parquet(f"{sink}/batch=*")
    nodes = claim_nodes(versions)
    newest = versions.groupBy("claim_id").agg(
        F.max_by(F.struct(*[c for c in versions.columns if c != "claim_id"]),
                 F.struct("recorded_at", "claim_status")).alias("s")
    ).select("claim_id", "s.*")
    return nodes, business_edges(newest)


def latest_per_entity(stream: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """M4: each row with ``accepted`` = not older than what its entity has seen.

    ``order`` is the arrival order inside a micro-batch. The state is one
    timestamp per entity.
    """
    names = [f.name for f in stream.schema.fields]
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields] + ["accepted boolean"])

    def guard(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = pd.Timestamp(state.get[0]) if state.exists else pd.Timestamp.min
        rows = pd.concat(list(batches)).sort_values(order)
        before = rows[at].cummax().shift(fill_value=pd.Timestamp.min).clip(lower=seen)
        rows["accepted"] = rows[at] >= before
        state.update((max(seen, rows[at].max()).to_pydatetime(),))
        yield rows[[*names, "accepted"]]

    return stream.groupBy(key).applyInPandasWithState(
        guard, out, "seen timestamp_ntz", "append", GroupStateTimeout.NoTimeout
    )


def enforce_states(
    stream: DataFrame, machine: str, initial: str, key: str = "entity_id", order: str = "event_id",
    target: str = "to_status",
) -> DataFrame:
    """M5: each move with the status before it and whether the machine allows it.

    Illegal moves change nothing; filter ``NOT legal`` for the side output.
    """
    allowed = {s: frozenset(t) for s, t in STATE_MACHINES[machine].items()}
    names = [f.name for f in stream.schema.fields]
    out = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields]
        + ["from_status string", "legal boolean"]
    )

    def enforce(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else initial
        rows = pd.concat(list(batches)).sort_values(order)
        before, legal = [], []
        for move in rows[target]:
            before.append(status)
            ok = move in allowed.get(status, frozenset())
            legal.append(ok)
            status = move if ok else status
        state.update((status,))
        yield rows.assign(from_status=before, legal=legal)[[*names, "from_status", "legal"]]

    return stream.groupBy(key).applyInPandasWithState(
        enforce, out, "status string", "append", GroupStateTimeout.NoTimeout
    )
