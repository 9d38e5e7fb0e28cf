"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from factloom.catalog.sqlframes import with_frames
from factloom.sources.bindings import Frames


@dataclass(frozen=True)
class Query:
    """One query: a function of the domain frames, and SQL over the same frames."""

    name: str
    build: Callable[[Frames], DataFrame]
    body: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Frames(spark, sf_dir))

    @property
    def sql(self) -> str | None:
        return None if self.body is None else with_frames(self.body)


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(name, build, sql)
        return build

    return add


def load() -> None:
    """Import the modules that register queries."""
    from factloom.catalog import (  # noqa: F401
        claim_queries, cleaning_queries, conflict_queries, document_queries, finance_queries,
        graph_queries, read_queries, review_queries, rule_queries, screen_queries,
        source_queries, standard_queries, stream_queries,
    )
