"""Plan execution: candidates, windows, claims, evidence, reasons (Q1-Q16)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.hashing import struct_hash
from factloom.operators import finance
from factloom.operators.conflicts import conflict_warnings
from factloom.operators.graph import companies_by_concept, companies_by_stage
from factloom.operators.paths import relation_paths
from factloom.plans.model import NumericFilter, QueryPlan
from factloom.session import ensure_checkpoint_dir

FRESHNESS = {
    "graph": "graph+pg",
    "pg-stale": "pg-only (graph stale)",
    "pg-unavailable": "pg-only (graph unavailable)",
    "pg": "pg",
}


def number_text(value: Column) -> Column:
    """Number as plain text with at least one decimal."""
    text = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def bitemporal_claims(
    claims: DataFrame,
    as_of: dt.datetime | None = None,
    known_at: dt.datetime | None = None,
    strict: bool = False,
) -> DataFrame:
    """Q1/Q2: accepted claims that hold at ``as_of`` and were known at ``known_at``."""
    rows = claims.filter(F.col("claim_status") == "ACCEPTED")
    if as_of is not None:
        at = F.lit(as_of).cast("timestamp_ntz")
        rows = rows.filter(
            (F.col("valid_from").isNull() | (F.col("valid_from") <= at))
            & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
        )
    if known_at is not None:
        known = F.lit(known_at).cast("timestamp_ntz")
        rows = rows.filter(F.col("recorded_at") <= known)
        if strict:
            rows = rows.filter(F.col("superseded_at").isNull() | (F.col("superseded_at") > known))
    return rows


def _table_candidates(plan: QueryPlan, claims: DataFrame) -> DataFrame | None:
    """Candidates from tables alone; None when the filter needs the graph."""
    if plan.concept_name:
        return None
    accepted = claims.filter(F.col("claim_status") == "ACCEPTED")
    if plan.subject_id is not None and not plan.business_stage:
        kind = claims.schema["subject_id"].dataType
        return claims.sparkSession.range(1).select(F.lit(plan.subject_id).cast(kind).alias("company_id"))
    if plan.business_stage:
        accepted = accepted.filter(F.col("business_stage") == plan.business_stage)
    return accepted.select(F.col("subject_id").alias("company_id")).distinct()


def candidates(
    plan: QueryPlan, claims: DataFrame, graph: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, str, list[str]]:
    """Q3: ``(company ids, source, notes)``.

    A graph answer stands, unless it is empty while the tables hold candidates;
    a concept cannot be judged without the graph, so nothing is returned then.
    """
    notes: list[str] = []
    table = _table_candidates(plan, claims)
    if not plan.needs_graph:
        assert table is not None
        return table, "pg", notes
    if graph is not None:
        nodes, edges = graph
        found = (
            companies_by_concept(nodes, edges, plan.concept_name).select("company_id")
            if plan.concept_name
            else companies_by_stage(edges, plan.business_stage)
        )
        if table is not None and found.isEmpty() and not table.isEmpty():
            notes.append("graph projection stale: graph returned 0 candidates - degraded to tables")
            return table, "pg-stale", notes
        return found, "graph", notes
    notes.append("graph backend not configured - degraded to table candidates")
    if table is None:
        notes.append("concept filter needs the graph - returning no candidates")
        return claims.select(F.col("subject_id").alias("company_id")).limit(0), "pg-unavailable", notes
    return table, "pg-unavailable", notes


def financial_evaluation(
    obs: DataFrame, links: DataFrame, numeric: NumericFilter,
    as_of: dt.datetime | None = None, known_at: dt.datetime | None = None, pit: bool = False,
) -> DataFrame:
    """F1-F10 for the companies in ``links``: judgement plus yearly detail."""
    day = as_of.date() if as_of is not None else None
    mine = obs.filter(F.col("metric_code") == numeric.metric)
    if pit and known_at is not None:
        series = finance.point_in_time_series(mine, links, numeric.metric, day, known_at)
    else:
        series = finance.company_fy_series(
            finance.current_observations(mine), links, numeric.metric, day, known_at
        )
    window = finance.last_n_years(finance.dedup_listings(series), numeric.fiscal_years)
    judged = finance.evaluate(window, numeric.operator, numeric.fiscal_years, numeric.threshold)
    return judged.join(finance.fy_detail(window), "company_id")


def ranked_claims(claims: DataFrame, max_claims: int) -> DataFrame:
    """Newest claims per company; Spark keeps that many per key and task before the shuffle."""
    order = Window.partitionBy("subject_id").orderBy(F.col("recorded_at").desc(), F.col("claim_id"))
    return claims.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_claims)


def exclusion_reason(df: DataFrame, numeric: NumericFilter | None) -> Column:
    """Q4: first reason that applies, NULL for a company that stays."""
    reason = F.when(F.coalesce("claims_loaded", F.lit(0)) == 0, F.lit("no matching claims"))
    if numeric is not None:
        reason = (
            reason.when(
                F.col("sufficient").isNull(),
                F.lit(f"no financial observations for metric {numeric.metric}"),
            )
            .when(
                ~F.col("sufficient"),
                F.concat(
                    F.lit("insufficient financial data ("), "reason", F.lit(": "),
                    F.col("available").cast("string"),
                    F.lit(f" complete FY, need {numeric.fiscal_years})"),
                ),
            )
            .when(
                ~F.col("passed"),
                F.concat(
                    F.lit(f"financial filter not passed ({numeric.operator}="),
                    number_text(F.col("value")), F.lit(")"),
                ),
            )
        )
    return reason


def unknown_reason(evidence_count: Column) -> Column:
    """Q5."""
    return F.when(evidence_count == 0, F.lit("claim without evidence (excluded from results)"))


def top_evidence(
    claims: DataFrame, links: DataFrame, fragments: DataFrame, n: int = 5
) -> DataFrame:
    """Q6: up to ``n`` pieces per claim; ``claims`` carries ``subject_id`` and the rank ``_n``."""
    wanted = claims.select("claim_id", "subject_id", "_n")
    pairs = links.select("claim_id", "evidence_id").join(wanted, "claim_id").join(
        fragments.select("evidence_id", "page_number", "quote_text"), "evidence_id"
    )
    order = Window.partitionBy("claim_id").orderBy("evidence_id")
    return pairs.withColumn("_e", F.row_number().over(order)).filter(F.col("_e") <= n)


def evidence_quotes(proof: DataFrame, companies: DataFrame, fragments: DataFrame, n: int = 5) -> DataFrame:
    """Q6: the first ``n`` quotes of each company, newest claim first; quotes are fetched for these alone.

    ``proof(subject_id, claim_id, recorded_at, evidence_id)``, ``companies(company_id)``.
    """
    mine = proof.join(companies.select(F.col("company_id").alias("subject_id")), "subject_id", "left_semi")
    order = Window.partitionBy("subject_id").orderBy(F.col("recorded_at").desc(), "claim_id", "evidence_id")
    first = mine.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= n)
    item = F.struct("_p", "evidence_id", "page_number", "quote_text")
    return (
        first.join(fragments.select("evidence_id", "page_number", "quote_text"), "evidence_id")
        .groupBy(F.col("subject_id").alias("company_id"))
        .agg(F.array_sort(F.collect_list(item)).alias("evidence_quotes"))
    )


def display_fields(
    company_ids: DataFrame, links: DataFrame, securities: DataFrame, ranked: DataFrame, products: DataFrame
) -> DataFrame:
    """Q7: first security code, and the product of the newest claim that names one."""
    codes = (
        links.join(company_ids, "company_id", "left_semi")
        .join(securities.select("security_id", "ts_code"), "security_id")
        .groupBy("company_id")
        .agg(F.min("ts_code").alias("security_code"))
    )
    named = (
        ranked.join(company_ids.select(F.col("company_id").alias("subject_id")), "subject_id", "left_semi")
        .join(products.select(F.col("product_id").alias("object_id"), "canonical_name"), "object_id")
        .groupBy(F.col("subject_id").alias("company_id"))
        .agg(F.min_by("canonical_name", "_n").alias("standard_product"))
    )
    return company_ids.join(codes, "company_id", "left").join(named, "company_id", "left")


def candidate_step(plan: QueryPlan, source: str) -> str:
    """First reasoning step: what was actually applied."""
    if source == "graph":
        if plan.concept_name:
            return f"graph concept filter applied: {plan.concept_name}"
        return f"graph stage filter applied: {plan.business_stage}"
    if source == "pg-stale":
        return (
            f"graph projection stale - PG fallback (business_stage={plan.business_stage} verified in PG)"
        )
    if source == "pg-unavailable":
        return "graph unavailable - PG fallback candidates"
    return "PG candidates (no graph query required)"


def reasoning_path(plan: QueryPlan, source: str) -> Column:
    """Q9."""
    steps = [F.lit(candidate_step(plan, source))]
    numeric = plan.numeric
    if numeric is not None:
        passed = F.when(F.col("passed"), F.lit("True")).otherwise(F.lit("False"))
        steps.append(
            F.concat(
                F.lit(
                    f"financial filter applied: metric={numeric.metric} operator={numeric.operator} "
                    f"window={numeric.fiscal_years}FY period_rule={numeric.rule} -> value="
                ),
                number_text(F.col("value")), F.lit(" passed="), passed,
            )
        )
    steps.append(F.concat(F.lit("claims loaded: "), F.col("claims_loaded").cast("string"),
                          F.lit(" (ACCEPTED, as_of/known_at applied)")))
    steps.append(F.concat(F.lit("evidence attached: "), F.col("evidence_count").cast("string")))
    return F.array(*steps)


@dataclass(frozen=True)
class Screen:
    """Answer of a screen: results, and every candidate left out with its reason."""

    results: DataFrame
    excluded: DataFrame
    unknowns: DataFrame
    conflicts: DataFrame
    status: str
    source: str
    notes: list[str]


def _stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def screen(tables: Mapping[str, DataFrame], plan: QueryPlan) -> Screen:
    """Q8/Q10: from candidates to grounded results.

    ``tables``: ``company, links, securities, observations, claims,
    claim_evidence, fragments, products`` and optionally ``nodes, edges``.
    Filters run before the limit, companies in id order; so a result set is
    never cut short by candidates that would have been excluded. Claims and
    evidence are counted whole; ids, verdicts and counts are stored first, then
    the page is fixed, and only for its companies quotes, codes and names are
    fetched.
    """
    graph = (tables["nodes"], tables["edges"]) if "edges" in tables else None
    ids, source, notes = candidates(plan, tables["claims"], graph)
    names = tables["company"].select(F.col("id").alias("company_id"), F.col("canonical_name").alias("company_name"))
    live = bitemporal_claims(tables["claims"], plan.as_of, plan.known_at).select(
        "claim_id", "subject_id", "object_id", "business_stage", "evidence_state", "valid_from", "valid_to", "recorded_at"
    )
    if plan.needs_graph or plan.subject_id is not None:
        # Without a filter every accepted claim belongs to a candidate
        live = live.join(ids.select(F.col("company_id").alias("subject_id")), "subject_id", "left_semi")
    live = _stored(live)
    counts = live.groupBy(F.col("subject_id").alias("company_id")).agg(F.count(F.lit(1)).alias("claims_loaded"))
    newest = F.min_by(F.struct("business_stage", "evidence_state", "valid_from", "valid_to"), "_n")
    per_company = counts.join(
        ranked_claims(live, 5).groupBy(F.col("subject_id").alias("company_id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_n", "claim_id"))), lambda e: e["claim_id"]).alias("claim_ids"),
            newest.alias("_newest"),
        ), "company_id",
    ).select("company_id", "claims_loaded", "claim_ids", "_newest.*")
    judged = ids.join(names, "company_id", "left").withColumn(
        "company_name", F.coalesce("company_name", F.lit("Unknown"))
    ).join(per_company, "company_id", "left")
    if plan.numeric is not None:
        pairs = tables["links"].join(ids, "company_id", "left_semi")
        fin = financial_evaluation(
            tables["observations"], pairs, plan.numeric, plan.as_of, plan.known_at
        )
        judged = judged.join(fin, "company_id", "left")
    judged = _stored(judged.withColumn("exclusion", exclusion_reason(judged, plan.numeric)))
    excluded = judged.filter(F.col("exclusion").isNotNull()).select(
        "company_id", "company_name", F.col("exclusion").alias("reason"),
        F.concat_ws(": ", "company_name", "exclusion").alias("message"),
    )
    staying = judged.filter(F.col("exclusion").isNull())
    proof = _stored(
        live.join(staying.select(F.col("company_id").alias("subject_id")), "subject_id", "left_semi")
        .select("subject_id", "claim_id", "recorded_at")
        .join(tables["claim_evidence"].select("claim_id", "evidence_id"), "claim_id")
        .join(tables["fragments"].select("evidence_id"), "evidence_id", "left_semi")
    )
    attached = proof.groupBy(F.col("subject_id").alias("company_id")).agg(F.count(F.lit(1)).alias("evidence_count"))
    grounded = staying.join(attached, "company_id", "left").withColumn(
        "evidence_count", F.coalesce("evidence_count", F.lit(0))
    )
    missing = unknown_reason(F.col("evidence_count"))
    unknowns = grounded.filter(missing.isNotNull()).select(
        "company_id", "company_name", missing.alias("reason"),
        F.concat(F.col("company_name"), F.lit(": "), missing).alias("message"),
    )
    if plan.evidence_required:
        grounded = grounded.filter(missing.isNull())
    else:
        unknowns = unknowns.limit(0)
    warned = grounded.select("company_id", "company_name").join(
        conflict_warnings(tables["claims"]), "company_id"
    )
    conflicts = warned.withColumn(
        "message",
        F.concat(
            F.col("company_name"), F.lit(": "), F.col("conflicted").cast("string"),
            F.lit(" contradicted/superseded claim(s) present - results carry this warning"),
        ),
    )
    page = _stored(grounded.orderBy("company_id").limit(plan.max_results))
    shown_ids = page.select("company_id")
    if plan.numeric is None:
        page = page.withColumns(
            {
                "value": F.lit(None).cast("double"), "passed": F.lit(None).cast("boolean"),
                "report_period": F.lit(None).cast("string"), "currency": F.lit(None).cast("string"),
                "financial_detail": F.lit(None).cast("array<struct<period_end:date,value:double,currency:string>>"),
            }
        )
    named = live.join(shown_ids.select(F.col("company_id").alias("subject_id")), "subject_id", "left_semi").join(
        tables["products"].select(F.col("product_id").alias("object_id")), "object_id", "left_semi"
    )
    shown = display_fields(shown_ids, tables["links"], tables["securities"], ranked_claims(named, 1), tables["products"])
    quotes = evidence_quotes(proof, shown_ids, tables["fragments"])
    results = page.join(shown, "company_id").join(quotes, "company_id", "left").select(
        "company_id", "company_name", "security_code", "standard_product", "claim_ids",
        "business_stage", "evidence_state", "valid_from", "valid_to",
        F.col("value").alias("financial_value"), "report_period", "currency", "financial_detail",
        F.transform("evidence_quotes", lambda e: e["evidence_id"]).alias("evidence_ids"),
        "evidence_quotes",
        reasoning_path(plan, source).alias("reasoning_path"),
        F.lit(FRESHNESS[source]).alias("data_freshness"),
    )
    degraded = source in ("pg-stale", "pg-unavailable")
    return Screen(
        results, excluded, unknowns, conflicts, "DEGRADED" if degraded else "SUCCEEDED", source, notes
    )


def explain_relation(tables: Mapping[str, DataFrame], plan: QueryPlan) -> tuple[DataFrame, DataFrame]:
    """Q11: the shortest path as text, and both ends with their newest claims."""
    first = relation_paths(
        tables["edges"], plan.subject_id, plan.object_id, plan.max_hops, limit=1
    )
    nodes = F.transform("path_nodes", lambda n: n.cast("string"))
    pieces = F.transform(
        nodes,
        lambda n, i: F.when(i == 0, n).otherwise(
            F.concat(F.lit("-["), F.get("path_rels", i - 1), F.lit("]-> - "), n)
        ),
    )
    path = first.select(
        "hops",
        F.concat(
            F.lit("graph path: "), F.array_join(pieces, " - "),
            F.lit(" ("), F.col("hops").cast("string"), F.lit(" hops)"),
        ).alias("reasoning"),
    )
    ends = tables["company"].filter(F.col("id").isin([plan.subject_id, plan.object_id]))
    live = bitemporal_claims(tables["claims"], plan.as_of, plan.known_at).join(
        ends.select(F.col("id").alias("subject_id")), "subject_id", "left_semi"
    )
    newest = ranked_claims(live, 5).groupBy("subject_id").agg(
        F.min_by("business_stage", "_n").alias("business_stage"),
        F.count(F.lit(1)).alias("claims"),
    )
    both = ends.select(F.col("id").alias("subject_id"), "canonical_name").join(newest, "subject_id", "left")
    return path, both


def entity_lookup(tables: Mapping[str, DataFrame], subject_id) -> DataFrame:
    """Q12."""
    return tables["company"].filter(F.col("id") == subject_id)


def compare(tables: Mapping[str, DataFrame], ids: list, plan: QueryPlan) -> DataFrame:
    """Q13: the companies side by side, one row each."""
    wanted = tables["company"].filter(F.col("id").isin(ids)).select(F.col("id").alias("company_id"), "canonical_name")
    live = bitemporal_claims(tables["claims"], plan.as_of, plan.known_at).join(
        wanted.select(F.col("company_id").alias("subject_id")), "subject_id", "left_semi"
    )
    counts = live.groupBy(F.col("subject_id").alias("company_id")).agg(
        F.count(F.lit(1)).alias("accepted_claims"),
        F.max_by("business_stage", F.struct("recorded_at", "claim_id")).alias("newest_stage"),
    )
    out = wanted.join(counts, "company_id", "left")
    if plan.numeric is not None:
        pairs = tables["links"].join(wanted, "company_id", "left_semi")
        fin = financial_evaluation(tables["observations"], pairs, plan.numeric, plan.as_of, plan.known_at)
        out = out.join(fin.select("company_id", "value", "passed", "report_period"), "company_id", "left")
    return out


def search_evidence(fragments: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Q13: fragments ranked by the number of distinct query words they hold; top ``k``."""
    words = sorted({w for w in query.lower().split() if w})
    if not words:
        raise ValueError("query has no words")
    hits = sum(
        (F.contains(F.lower("quote_text"), F.lit(w)).cast("int") for w in words), F.lit(0)
    )
    return (
        fragments.withColumn("score", hits)
        .filter(F.col("score") > 0)
        .select("evidence_id", "document_id", "score")
        .orderBy(F.col("score").desc(), "evidence_id")
        .limit(k)
    )


def dedup_audit(audit: DataFrame) -> DataFrame:
    """Q14: the first record per query id, and whether another plan reused the id."""
    rest = [c for c in audit.columns if c != "query_id"]
    return audit.groupBy("query_id").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "audit_id")).alias("s"),
        F.count(F.lit(1)).alias("records"),
        (F.count_distinct("plan") > 1).alias("plan_conflict"),
    ).select("query_id", "s.*", "records", "plan_conflict")


def response_status(runs: DataFrame) -> DataFrame:
    """Q15: ``runs(query_id, error_category, candidate_source)`` to the final status."""
    return runs.withColumn(
        "status",
        F.when(F.col("error_category") == "plan_validation", "REJECTED")
        .when(F.col("error_category").isNotNull(), "FAILED")
        .when(F.col("candidate_source").isin("pg-stale", "pg-unavailable"), "DEGRADED")
        .otherwise("SUCCEEDED"),
    )


def plan_key(plans: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Q16: replay key of a normalised plan and the versions it ran on."""
    text = [F.trim(F.upper(F.col(c).cast("string"))).alias(c) for c in sorted(plans.columns) if c != "query_id"]
    fixed = [F.lit(v).alias(f"version_{k}") for k, v in sorted(versions.items())]
    return plans.withColumn("plan_key", struct_hash(*text, *fixed))
