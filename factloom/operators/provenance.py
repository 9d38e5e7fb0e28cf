"""Provenance chain and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.hashing import struct_hash
from factloom.operators.conflicts import OPEN_END
from factloom.operators.scaling import dense_index

CHAIN_BLOCK = 1_000_000
CONTENT = ["entity_id", "activity_id", "agent_id", "used_entities", "metadata"]


def provenance_checksum(entries: DataFrame) -> DataFrame:
    """Hash over the content, without time, so that a replay gives the same value."""
    cols = []
    for name in CONTENT:
        if name not in entries.columns:
            continue
        col = F.col(name)
        cols.append((F.array_sort(col) if name == "used_entities" else col).alias(name))
    return entries.withColumn("checksum", struct_hash(*cols))


def append_chain(entries: DataFrame, chain: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """New entries with dense sequence numbers that go on from the head.

    Known (entity, activity, checksum) are skipped. The numbers come from a
    range sort, the previous checksum from a join on number - 1; neither passes
    the chain through one task.
    """
    order = order or ["entity_id", "activity_id"]
    key = ["entity_id", "activity_id", "checksum"]
    fresh = entries.dropDuplicates(key)
    base, head = 0, None
    if chain is not None:
        fresh = fresh.join(chain.select(*key), key, "left_anti")
        top = chain_head(chain).first()
        if top is not None:
            base, head = top.sequence_id, top.checksum
    numbered = dense_index(fresh, order, "_n").withColumn("sequence_id", F.col("_n") + base)
    before = numbered.select(
        (F.col("_n") + 1).alias("_n"), F.col("checksum").alias("previous_checksum")
    )
    return (
        numbered.join(before, "_n", "left")
        .withColumn("previous_checksum", F.coalesce("previous_checksum", F.lit(head).cast("string")))
        .drop("_n")
    )


def verify_chain(chain: DataFrame, block: int = CHAIN_BLOCK) -> DataFrame:
    """Entries whose previous checksum is not that of the entry before.

    The comparison runs per block of sequence numbers; the first entry of a
    block looks at the last one of the block before it. Only one row per block
    meets in one task.
    """
    rows = chain.select("sequence_id", "checksum", "previous_checksum").withColumn(
        "_block", F.floor(F.col("sequence_id") / block)
    )
    ends = rows.groupBy("_block").agg(F.max_by("checksum", "sequence_id").alias("_last"))
    carried = ends.select(
        "_block", F.lag("_last").over(Window.orderBy("_block")).alias("_carried")
    )
    inside = Window.partitionBy("_block").orderBy("sequence_id")
    linked = rows.withColumn("_n", F.row_number().over(inside)).withColumn(
        "_before", F.lag("checksum").over(inside)
    ).join(carried, "_block")
    expected = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return linked.filter(~F.col("previous_checksum").eqNullSafe(expected)).select(
        "sequence_id", "checksum", "previous_checksum", expected.alias("expected_checksum")
    )


def latest_entry(chain: DataFrame) -> DataFrame:
    """Newest entry per entity."""
    rest = [c for c in chain.columns if c != "entity_id"]
    return chain.groupBy("entity_id").agg(
        F.max_by(F.struct(*rest), "sequence_id").alias("s")
    ).select("entity_id", "s.*")


def chain_head(chain: DataFrame) -> DataFrame:
    """Last entry of the chain."""
    return chain.orderBy(F.col("sequence_id").desc_nulls_last()).limit(1)


def entries_by_type(chain: DataFrame, entity_type: str) -> DataFrame:
    """Entries of one type in chain order."""
    return chain.filter(F.col("entity_type") == entity_type).orderBy("sequence_id")


def lineage(chain: DataFrame, ids: DataFrame, max_depth: int = 10) -> DataFrame:
    """The parents of each start entity, nearest first, up to ``max_depth`` entries.

    ``ids(entity_id)``. A path that meets an entity again stops there.
    """
    newest = latest_entry(chain).select("entity_id", "parent_entity_id", "activity_id", "sequence_id")
    level = (
        ids.select(F.col("entity_id").alias("start_id")).distinct()
        .withColumn("entity_id", F.col("start_id"))
        .withColumn("_seen", F.array("start_id"))
        .join(newest, "entity_id")
        .withColumn("depth", F.lit(0))
    )
    cols = ["start_id", "depth", "entity_id", "parent_entity_id", "activity_id", "sequence_id"]
    out = level.select(*cols)
    for depth in range(1, max_depth):
        level = (
            level.filter(
                F.col("parent_entity_id").isNotNull()
                & ~F.array_contains("_seen", F.col("parent_entity_id"))
            )
            .select(
                "start_id",
                F.col("parent_entity_id").alias("entity_id"),
                F.array_append("_seen", F.col("parent_entity_id")).alias("_seen"),
            )
            .join(newest, "entity_id")
            .withColumn("depth", F.lit(depth))
        )
        out = out.unionByName(level.select(*cols))
    return out


def descendants(chain: DataFrame, entity_id, max_rows: int | None = None) -> DataFrame:
    """P5: direct children in chain order."""
    rows = chain.filter(F.col("parent_entity_id") == entity_id).orderBy("sequence_id")
    return rows if max_rows is None else rows.limit(max_rows)


def claim_lineage(
    claims: DataFrame, links: DataFrame, fragments: DataFrame, docs: DataFrame,
    versions: DataFrame | None = None,
) -> DataFrame:
    """Claim -> evidence -> document (and version), one row per piece of evidence."""
    trail = (
        claims.select("claim_id", "predicate_code", "claim_status", "business_stage", "evidence_state")
        .join(links.select("claim_id", "evidence_id"), "claim_id", "left")
        .join(
            fragments.select("evidence_id", "document_id", "document_version_id", "page_number", "quote_text"),
            "evidence_id", "left",
        )
        .join(docs.select("document_id", "source_system", "title"), "document_id", "left")
    )
    if versions is None:
        return trail
    return trail.join(
        versions.select("document_version_id", "version", "parse_status"), "document_version_id", "left"
    )


def to_bitemporal(df: DataFrame) -> DataFrame:
    """Open ends as the largest timestamp."""
    top = F.lit(OPEN_END).cast("timestamp_ntz")
    return df.withColumns(
        {"valid_to": F.coalesce("valid_to", top), "superseded_at": F.coalesce("superseded_at", top)}
    )


def from_bitemporal(df: DataFrame) -> DataFrame:
    """Back to NULL for open ends."""
    top = F.lit(OPEN_END).cast("timestamp_ntz")
    return df.withColumns(
        {c: F.when(F.col(c) != top, F.col(c)) for c in ("valid_to", "superseded_at")}
    )
