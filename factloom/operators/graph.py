"""Graph projection, traversal, reconciliation.

A graph is two frames: ``nodes(id, label, canonical_name)`` and
``edges(edge_id, src, dst, rel_type, claim_id, active, ...)``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.paths import relation_paths, subgraph, supply_neighbors  # noqa: F401
from factloom.operators.scaling import beside
from factloom.operators.taxonomy import taxonomy_closure, taxonomy_violations  # noqa: F401
from factloom.vocab import EDGE_PREDICATES, NODE_LABELS, RELATION_TYPES

HISTORY = ["ACCEPTED", "CONTRADICTED", "SUPERSEDED"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def entity_nodes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """G1: one node per row of each entity table ``(id, name)``."""
    for label in tables:
        if label not in NODE_LABELS:
            raise ValueError(f"label {label!r} not known")
    return _union(
        [
            df.select(
                F.col("id").cast("string").alias("id"), F.lit(label).alias("label"),
                F.col("name").alias("canonical_name"),
            )
            for label, df in tables.items()
        ]
    )


def claim_nodes(events: DataFrame) -> DataFrame:
    """Newest state per claim; an older ``recorded_at`` never overwrites a newer one."""
    props = ["claim_status", "business_stage", "evidence_state", "predicate_code", "confidence"]
    newest = F.max_by(F.struct("recorded_at", *props), F.struct("recorded_at", "claim_status"))
    return (
        events.groupBy("claim_id").agg(newest.alias("s")).select("claim_id", "s.*")
        .withColumn("active", F.col("claim_status") == "ACCEPTED")
    )


def business_edges(claims: DataFrame) -> DataFrame:
    """Edge per accepted claim with subject and object, keyed by the claim."""
    return claims.filter(
        (F.col("claim_status") == "ACCEPTED")
        & F.col("subject_id").isNotNull()
        & F.col("object_id").isNotNull()
        & F.col("predicate_code").isin(EDGE_PREDICATES)
    ).select(
        F.col("claim_id").cast("string").alias("edge_id"),
        F.col("subject_id").alias("src"),
        F.col("object_id").alias("dst"),
        F.col("predicate_code").alias("rel_type"),
        "claim_id", "business_stage", "evidence_state", "valid_from", "valid_to", "recorded_at",
        "confidence",
        F.lit(True).alias("active"),
    )


def invalidate_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges of contradicted or superseded claims stay, inactive."""
    ended = (
        events.filter(F.col("event_type").isin("CLAIM_CONTRADICTED", "CLAIM_SUPERSEDED"))
        .groupBy("claim_id")
        .agg(F.min("at").alias("invalidated_at"))
    )
    return edges.join(ended, "claim_id", "left").withColumn(
        "active", F.col("active") & F.col("invalidated_at").isNull()
    )


def membership_edges(memberships: DataFrame, rel_type: str) -> DataFrame:
    """One structural edge per pair, properties of the newest snapshot."""
    if rel_type not in RELATION_TYPES:
        raise ValueError(f"rel_type {rel_type!r} not known")
    return memberships.groupBy("src", "dst").agg(F.max("snapshot_date").alias("snapshot_date")).select(
        F.concat_ws("|", F.lit(rel_type), "src", "dst").alias("edge_id"), "src", "dst",
        F.lit(rel_type).alias("rel_type"), "snapshot_date", F.lit(True).alias("active"),
    )


def segment_edges(segments: DataFrame, products: DataFrame) -> DataFrame:
    """Company -> product from disclosed segments, with the newest period."""
    newest = (
        segments.filter((F.col("segment_type") == "PRODUCT") & F.col("raw_segment_name").isNotNull())
        .groupBy("company_id", "raw_segment_name")
        .agg(F.max("period_end").alias("period_end"))
    )
    named = products.select(F.col("canonical_name").alias("raw_segment_name"), "product_id")
    return newest.join(named, "raw_segment_name").select(
        F.col("company_id").alias("src"), F.col("product_id").alias("dst"),
        F.lit("PRODUCES").alias("rel_type"), F.lit("business_segment").alias("source"), "period_end",
        F.lit(True).alias("active"),
    )


def rebuild_graph(
    tables: Mapping[str, DataFrame], claims: DataFrame, memberships: Mapping[str, DataFrame]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, stats)`` recomputed from the tables, hence idempotent."""
    past = claims.filter(F.col("claim_status").isin(HISTORY))
    nodes = entity_nodes(tables).unionByName(
        claim_nodes(past).select(
            F.col("claim_id").cast("string").alias("id"), F.lit("Claim").alias("label"),
            F.lit(None).cast("string").alias("canonical_name"),
        )
    )
    keep = ["edge_id", "src", "dst", "rel_type", "active"]
    as_text = [F.col(c).cast("string").alias(c) if c in ("src", "dst") else F.col(c) for c in keep]
    parts = [business_edges(past).select(*as_text)] + [
        membership_edges(df, rel).select(*as_text) for rel, df in memberships.items()
    ]
    edges = _union(parts)
    stats = _union(
        [
            nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")),
            edges.groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n")),
        ]
    )
    return nodes, edges, stats


def consume_outbox(
    outbox: DataFrame, claims: DataFrame, now: Column, max_retries: int = 5, batch: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(results, edges)`` of one pass over due events: all, or the ``batch`` oldest.

    Due are pending events and those whose lease ran out. An event whose claim
    is not there fails its verification: it is retried, and dead-lettered at the
    retry limit, without holding up the others.
    """
    due = outbox.filter(
        (F.col("status") == "PENDING")
        | ((F.col("status") == "PROCESSING") & (F.col("lease_expires_at") < now))
    )
    if batch is not None:
        due = due.orderBy("created_at", "seq").limit(batch)
    known = claims.withColumn("_known", F.lit(True))
    joined = due.join(known, due["aggregate_id"] == known["claim_id"], "left")
    tried = F.col("retry_count") + 1
    ok = F.col("_known").isNotNull()
    results = joined.select(
        "seq", "aggregate_id", "event_type",
        F.when(ok, "PROCESSED").when(tried >= max_retries, "DEAD_LETTERED").otherwise("PENDING")
        .alias("next_status"),
        F.when(ok, F.col("retry_count")).otherwise(tried).alias("retry_count"),
    )
    edges = business_edges(
        known.drop("_known").join(
            due.filter(F.col("event_type") == "CLAIM_ACCEPTED").select(F.col("aggregate_id").alias("claim_id")),
            "claim_id", "left_semi",
        )
    )
    return results, edges


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.round(part / whole * 100, 1))


def reconcile_graph(
    claims: DataFrame, claim_node_df: DataFrame, edges: DataFrame, outbox: DataFrame,
    companies: DataFrame, now: Column, sample: int = 5,
) -> DataFrame:
    """One row: coverage, claim-id share, backlog, oldest wait, sample hash.

    The same accepted set is counted on both sides, so coverage stays within 100 %.
    """
    accepted = claims.filter(F.col("claim_status") == "ACCEPTED").agg(
        F.count(F.lit(1)).alias("accepted_claims")
    )
    nodes = claim_node_df.filter(F.col("claim_status") == "ACCEPTED").agg(
        F.count(F.lit(1)).alias("accepted_nodes")
    )
    business = edges.filter(F.col("active") & F.col("rel_type").isin("PRODUCES", "DEVELOPS", "SUPPLIES_TO")).agg(
        F.count(F.lit(1)).alias("business_edges"), F.count("claim_id").alias("with_claim_id")
    )
    waiting = outbox.filter(F.col("status").isin("PENDING", "PROCESSING")).agg(
        F.count(F.lit(1)).alias("outbox_pending"), F.min("created_at").alias("_oldest")
    )
    # The sample is the first few ids, as the report defines it
    ids = companies.select(F.col("id").cast("string").alias("id")).orderBy("id").limit(sample).agg(
        F.substring(F.sha2(F.to_json(F.array_sort(F.collect_list("id"))), 256), 1, 16).alias("sample_hash")
    )
    report = beside(accepted, nodes, business, waiting, ids)
    return report.select(
        "accepted_claims", "accepted_nodes",
        _pct(F.col("accepted_nodes"), F.col("accepted_claims")).alias("coverage_pct"),
        "business_edges", "with_claim_id",
        _pct(F.col("with_claim_id"), F.col("business_edges")).alias("claim_id_pct"),
        "outbox_pending",
        F.coalesce(
            F.timestamp_diff("SECOND", F.col("_oldest"), now), F.lit(0)
        ).cast("bigint").alias("oldest_wait_seconds"),
        "sample_hash",
    )


def companies_by_concept(nodes: DataFrame, edges: DataFrame, concept: str) -> DataFrame:
    """G10."""
    wanted = nodes.filter((F.col("label") == "Concept") & (F.col("canonical_name") == concept)).select(
        F.col("id").alias("dst"), F.col("canonical_name").alias("concept")
    )
    return edges.filter(F.col("rel_type") == "TAGGED_AS").join(wanted, "dst").select(
        F.col("src").alias("company_id"), "concept"
    ).distinct()


def companies_by_stage(edges: DataFrame, stage: str) -> DataFrame:
    """G11."""
    return edges.filter(
        (F.col("rel_type") == "PRODUCES") & (F.col("business_stage") == stage) & F.col("active")
    ).select(F.col("src").alias("company_id")).distinct()


def company_edges(edges: DataFrame, company_id) -> DataFrame:
    """Production edges of one company, oldest first."""
    return edges.filter((F.col("src") == company_id) & (F.col("rel_type") == "PRODUCES")).select(
        "claim_id", F.col("business_stage").alias("stage"), "valid_from", "valid_to", "recorded_at",
        "dst",
    ).orderBy("recorded_at", "claim_id")


def subgraph_status(
    company_id, node_rows: DataFrame | None, companies: DataFrame, claims: DataFrame
) -> DataFrame:
    """One row; an empty graph for a known company is stale, not an answer."""
    if company_id is None:
        return companies.sparkSession.range(1).select(
            F.lit("REJECTED").alias("status"), F.lit(0).cast("bigint").alias("nodes"),
            F.lit(0).cast("bigint").alias("accepted_claims"),
        )
    accepted = claims.filter(
        (F.col("subject_id") == company_id) & (F.col("claim_status") == "ACCEPTED")
    ).agg(F.count(F.lit(1)).alias("accepted_claims"))
    known = companies.filter(F.col("id") == company_id).agg(F.count(F.lit(1)).alias("_known"))
    if node_rows is None:
        found = companies.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("nodes"))
        status = F.lit("DEGRADED")
    else:
        found = node_rows.agg(F.count(F.lit(1)).alias("nodes"))
        status = F.when((F.col("nodes") == 0) & (F.col("_known") > 0), "STALE").otherwise("SUCCEEDED")
    return beside(found, known, accepted).select(status.alias("status"), "nodes", "accepted_claims")


def fallback_claims(claims: DataFrame, company_id, limit: int = 50) -> DataFrame:
    """Newest accepted claims of the company, shown beside a stale graph."""
    return claims.filter(
        (F.col("subject_id") == company_id) & (F.col("claim_status") == "ACCEPTED")
    ).orderBy(F.col("recorded_at").desc(), "claim_id").limit(limit).select(
        "claim_id", "predicate_code", "business_stage", "claim_status"
    )


def claims_for(claims: DataFrame, subject_id, predicate: str) -> DataFrame:
    """G17."""
    return claims.filter((F.col("subject_id") == subject_id) & (F.col("predicate_code") == predicate))


def _active_at(as_of) -> Column:
    at = F.lit(as_of).cast("timestamp_ntz")
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (
        F.col("valid_to").isNull() | (F.col("valid_to") > at)
    )


def verified_products(edges: DataFrame, claims: DataFrame, links: DataFrame, as_of) -> DataFrame:
    """Production edges backed by an accepted claim active then, with evidence counts."""
    live = claims.filter((F.col("claim_status") == "ACCEPTED") & _active_at(as_of)).select("claim_id")
    proof = links.groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence"))
    return (
        edges.filter(F.col("rel_type") == "PRODUCES")
        .select("claim_id", F.col("src").alias("company_id"), F.col("dst").alias("product_id"))
        .join(live, "claim_id", "left_semi")
        .join(proof, "claim_id")
    )


def companies_in_theme(
    claims: DataFrame, closure: DataFrame, themes: DataFrame, theme, stages: list[str], as_of
) -> DataFrame:
    """``themes(product_id, theme)`` names the products that are part of a theme."""
    members = (
        closure.join(
            themes.filter(F.col("theme") == theme).select(F.col("product_id").alias("ancestor")),
            "ancestor", "left_semi",
        )
        .select(F.col("child").alias("object_id"))
        .distinct()
    )
    return (
        claims.filter(
            (F.col("claim_status") == "ACCEPTED")
            & (F.col("predicate_code") == "PRODUCES")
            & F.col("business_stage").isin(stages)
            & _active_at(as_of)
        )
        .join(members, "object_id", "left_semi")
        .select(F.col("subject_id").alias("company_id"), F.col("object_id").alias("product_id"), "claim_id")
    )


def classification_only(memberships: DataFrame, claims: DataFrame) -> DataFrame:
    """Classified companies without an accepted operating claim."""
    operating = claims.filter(
        (F.col("claim_status") == "ACCEPTED")
        & F.col("predicate_code").isin("PRODUCES", "DEVELOPS", "HAS_REVENUE_FROM")
    ).select(F.col("subject_id").alias("company_id"))
    return (
        memberships.join(operating, "company_id", "left_anti")
        .groupBy("company_id")
        .agg(F.count_distinct("concept_id").alias("concepts"))
    )


def theme_paths(
    edges: DataFrame, taxonomy: DataFrame, company_id, theme, limit: int = 10, max_hops: int = 4
) -> DataFrame:
    """Company -> product -> ... -> theme, shortest first; ``limit`` is the report size."""
    up = taxonomy.select("child", "parent").distinct()
    level = (
        edges.filter((F.col("src") == company_id) & (F.col("rel_type") == "PRODUCES"))
        .select("dst").distinct()
        .select(F.col("dst").alias("_at"), F.array("dst").alias("path"))
    )
    parts = [level]
    for _ in range(max_hops):
        level = level.join(up, F.col("_at") == F.col("child")).filter(
            ~F.array_contains("path", F.col("parent"))
        ).select(F.col("parent").alias("_at"), F.array_append("path", F.col("parent")).alias("path"))
        parts.append(level)
    return (
        _union(parts)
        .filter(F.col("_at") == theme)
        .select(F.size("path").alias("length"), F.array_join("path", ">").alias("path"))
        .orderBy("length", "path")
        .limit(limit)
    )


def edge_integrity(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Operating edges without a claim id, and claim ids without a claim."""
    bare = edges.filter(F.col("rel_type").isin(EDGE_PREDICATES) & F.col("claim_id").isNull()).select(
        "edge_id", "rel_type", F.lit("missing_claim_id").alias("finding")
    )
    dangling = edges.filter(F.col("claim_id").isNotNull()).join(
        claims.select("claim_id"), "claim_id", "left_anti"
    ).select("edge_id", "rel_type", F.lit("dangling_claim_id").alias("finding"))
    return bare.unionByName(dangling)


def verify_write(expected: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """What was to be written and is not there."""
    return expected.join(stored.select(*key), key, "left_anti")


BUILTIN_CLASSES = [
    "owl:Thing", "rdfs:Resource", "rdfs:Literal", "skos:Concept", "skos:ConceptScheme", "prov:Entity",
]


def ontology_issues(triples: DataFrame) -> DataFrame:
    """Structure checks on ``triples(s, p, o)`` with prefixed names."""
    typed = triples.filter(F.col("p") == "rdf:type")
    props = typed.filter(F.col("o") == "owl:ObjectProperty").select(F.col("s").alias("focus")).distinct()
    classes = typed.filter(F.col("o").isin("owl:Class", "rdfs:Class")).select(F.col("s").alias("target"))
    parents = triples.filter(F.col("p") == "rdfs:subClassOf").select(F.col("o").alias("target"))

    def outside(df: DataFrame, *known: DataFrame) -> DataFrame:
        df = df.filter(~F.col("target").isin(BUILTIN_CLASSES))
        for other in known:
            df = df.join(other.distinct(), "target", "left_anti")
        return df

    def scoped(path: str) -> DataFrame:
        return triples.filter(F.col("p") == path).select(
            F.col("s").alias("focus"), F.col("o").alias("target")
        )

    parts = []
    for path, name in (("rdfs:domain", "MISSING_DOMAIN"), ("rdfs:range", "MISSING_RANGE")):
        refs = scoped(path).join(props, "focus", "left_semi")
        parts.append(
            props.join(refs.select("focus"), "focus", "left_anti").select(
                "focus", F.lit(path).alias("path"), F.lit(name).alias("issue")
            )
        )
        parts.append(
            outside(refs, classes, parents).select(
                "focus", F.lit(path).alias("path"), F.lit("UNRESOLVED_REFERENCE").alias("issue")
            )
        )
    parts.append(
        outside(scoped("sh:targetClass"), classes).select(
            "focus", F.lit("sh:targetClass").alias("path"), F.lit("UNRESOLVED_TARGET_CLASS").alias("issue")
        )
    )
    parts.append(
        typed.filter(F.col("o") == "skos:Concept").select(F.col("s").alias("focus")).distinct()
        .join(scoped("skos:prefLabel").select("focus"), "focus", "left_anti")
        .select("focus", F.lit("skos:prefLabel").alias("path"), F.lit("MISSING_PREFLABEL").alias("issue"))
    )
    return _union(parts)


ENTITY_CLASSES = ["Company", "Security", "Exchange", "Concept", "Product", "Theme", "Industry"]


def claims_to_triples(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(triples, rejected)``; a claim that names an unknown entity type is rejected."""
    known = F.initcap(F.coalesce("subject_type", F.lit("Company"))).isin(ENTITY_CLASSES) & (
        F.col("object_id").isNull()
        | F.initcap(F.coalesce("object_type", F.lit("Product"))).isin(ENTITY_CLASSES)
    )
    subject = F.concat_ws(
        "/", F.lit("stock"), F.lower(F.coalesce("subject_type", F.lit("company"))), F.col("subject_id").cast("string")
    )
    target = F.when(
        F.col("object_id").isNotNull(),
        F.concat_ws("/", F.lit("stock"), F.lower(F.coalesce("object_type", F.lit("product"))),
                    F.col("object_id").cast("string")),
    ).otherwise(F.concat(F.lit("stock:claimObjectValue/"), F.col("claim_id").cast("string")))
    entries = {
        "rdf:type": F.lit("stock:Claim"),
        "stock:claimSubject": subject,
        "stock:predicateCode": F.col("predicate_code"),
        "stock:claimObject": target,
        "stock:claimStatus": F.col("claim_status"),
        "stock:businessStage": F.col("business_stage"),
        "stock:evidenceState": F.col("evidence_state"),
        "stock:confidence": F.col("confidence").cast("string"),
        "stock:recordedAt": F.col("recorded_at").cast("string"),
        "stock:validFrom": F.col("valid_from").cast("string"),
        "stock:validTo": F.col("valid_to").cast("string"),
        "stock:supersededAt": F.col("superseded_at").cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in entries.items()])
    triples = claims.filter(known).select(
        F.concat(F.lit("stock:claim/"), F.col("claim_id").cast("string")).alias("s"),
        F.inline(F.filter(pairs, lambda e: e["o"].isNotNull())),
    )
    return triples, claims.filter(~known).select("claim_id", "subject_type", "object_type")


def projection_status(outbox: DataFrame, now: Column) -> DataFrame:
    """Count, oldest wait and last processing time per status."""
    return outbox.groupBy("status").agg(
        F.count(F.lit(1)).alias("events"),
        F.timestamp_diff("SECOND", F.min("created_at"), now).alias("oldest_seconds"),
        F.max("processed_at").alias("last_processed"),
    )


def companies_of_product(edges: DataFrame, product_id) -> DataFrame:
    """G29."""
    return edges.filter(
        (F.col("dst") == product_id) & (F.col("rel_type") == "PRODUCES") & F.col("active")
    ).select(F.col("src").alias("company_id")).distinct()
