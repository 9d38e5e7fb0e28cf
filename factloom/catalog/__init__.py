"""Registered queries: each runs an operator over whole tables, with its SQL check."""

from __future__ import annotations

from factloom.catalog.registry import CATALOG, Query, load


def all_queries() -> dict[str, Query]:
    load()
    return CATALOG
