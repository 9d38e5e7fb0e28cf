"""Canonical JSON and sha256 keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(payload: Column) -> Column:
    """Map as JSON with sorted keys; NULL values stay in as ``null``."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(payload)))
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def payload_hash(payload: Column) -> Column:
    """S3: hash of a record that does not depend on the order of its keys."""
    return F.sha2(canonical_json(payload), 256)


def schema_signature(fields: Column, identity: list[str] | None = None) -> Column:
    """Hash of the distinct field names in order, optionally of identity fields only."""
    names = F.array_distinct(fields)
    if identity is not None:
        names = F.filter(names, lambda name: name.isin(identity))
    return F.sha2(F.to_json(names), 256)


def struct_hash(*cols: Column) -> Column:
    """Hash over named columns; NULLs are kept so that they count."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def stable_id(prefix: str, *cols: Column) -> Column:
    """Deterministic id of a natural key; a length prefix keeps parts apart."""
    parts = [
        F.concat(F.coalesce(F.length(c.cast("string")).cast("string"), F.lit("-")), F.lit(":"),
                 F.coalesce(c.cast("string"), F.lit("")))
        for c in cols
    ]
    return F.sha2(F.concat_ws("|", F.lit(prefix), *parts), 256)
