"""Read models and operational aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.clean import contains_ci
from factloom.operators.scaling import beside


def company_list(
    companies: DataFrame, links: DataFrame, securities: DataFrame, claims: DataFrame,
    q: str | None = None, stage: str | None = None, limit: int = 50, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """``(page, total)``; codes and counts are built for the page alone."""
    rows = companies
    accepted = claims.filter(F.col("claim_status") == "ACCEPTED")
    if q is not None:
        rows = rows.filter(contains_ci(F.col("canonical_name"), q))
    if stage is not None:
        staged = accepted.filter(F.col("business_stage") == stage).select(F.col("subject_id").alias("id"))
        rows = rows.join(staged, "id", "left_semi")
    page = rows.orderBy("canonical_name", "id").offset(offset).limit(limit)
    ids = page.select("id")
    codes = (
        links.join(ids.withColumnRenamed("id", "company_id"), "company_id", "left_semi")
        .join(securities.select("security_id", "ts_code"), "security_id")
        .groupBy(F.col("company_id").alias("id"))
        .agg(F.min("ts_code").alias("security_code"))
    )
    produces = (
        accepted.filter(F.col("predicate_code") == "PRODUCES")
        .join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
        .groupBy(F.col("subject_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("produces_claims"))
    )
    shown = (
        page.join(codes, "id", "left").join(produces, "id", "left")
        .select("id", "canonical_name", "security_code",
                F.coalesce("produces_claims", F.lit(0)).cast("bigint").alias("produces_claims"))
        .orderBy("canonical_name", "id")
    )
    return shown, rows.agg(F.count(F.lit(1)).alias("total"))


def detail(df: DataFrame, id_col: str, value) -> DataFrame:
    """T2."""
    return df.filter(F.col(id_col) == value)


def company_claims(claims: DataFrame, company_id, limit: int = 50) -> DataFrame:
    """Newest first."""
    return claims.filter(F.col("subject_id") == company_id).orderBy(
        F.col("recorded_at").desc(), "claim_id"
    ).limit(limit)


def timeline(claims: DataFrame, company_id) -> DataFrame:
    """T4: accepted claims as they became known."""
    return claims.filter(
        (F.col("subject_id") == company_id) & (F.col("claim_status") == "ACCEPTED")
    ).orderBy("recorded_at", "claim_id").select(
        "claim_id", "predicate_code", "business_stage", "evidence_state", "valid_from", "valid_to", "recorded_at"
    )


def overview(companies: DataFrame, claims: DataFrame, fragments: DataFrame, obs: DataFrame) -> DataFrame:
    """T5: one row; each table is read once and reduced to one row before they meet."""
    one = F.count(F.lit(1))
    parts = [
        companies.agg(one.alias("companies")),
        claims.agg(
            F.count_if(F.col("claim_status") == "ACCEPTED").alias("accepted_claims"),
            F.count_if(F.col("claim_status") == "NEEDS_REVIEW").alias("pending_reviews"),
            F.max("recorded_at").alias("latest_claim_at"),
        ),
        fragments.agg(one.alias("evidence_fragments")),
        obs.agg(one.alias("financial_observations"), F.max("recorded_at").alias("latest_observation_at")),
    ]
    return beside(*parts)


def recent_runs(ingest: DataFrame, normalization: DataFrame, limit: int = 10) -> DataFrame:
    """Newest finished runs of each kind."""
    def newest(df: DataFrame, kind: str) -> DataFrame:
        return (
            df.filter(F.col("finished_at").isNotNull())
            .orderBy(F.col("finished_at").desc(), "run_id")
            .limit(limit)
            .select(F.lit(kind).alias("kind"), "run_id", "dataset", "status", "finished_at")
        )

    return newest(ingest, "ingest").unionByName(newest(normalization, "normalization"))


def dataset_freshness(runs: DataFrame, raw: DataFrame) -> DataFrame:
    """Newest raw row of a dataset, else its last success."""
    done = runs.filter(F.col("status").isin("SUCCEEDED", "PARTIAL_SUCCESS")).groupBy("dataset").agg(
        F.max("finished_at").alias("last_success_at")
    )
    seen = raw.groupBy(F.col("api_name").alias("dataset")).agg(F.max("retrieved_at").alias("last_raw_at"))
    return done.join(seen, "dataset", "left").select(
        "dataset", F.coalesce("last_raw_at", "last_success_at").alias("fresh_at")
    )


def run_history(runs: DataFrame, events: DataFrame, dataset: str, limit: int = 20) -> DataFrame:
    """Newest runs of a dataset with their event counts."""
    page = runs.filter(F.col("dataset") == dataset).orderBy(
        F.col("started_at").desc(), "run_id"
    ).limit(limit)
    counts = events.join(page.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events")
    )
    return page.join(counts, "run_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))


def stale_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Running, but the lease is over."""
    return runs.filter((F.col("status") == "RUNNING") & (F.col("lease_expires_at") < now))


def master_stats(
    securities: DataFrame, companies: DataFrame, obs: DataFrame, segments: DataFrame, products: DataFrame
) -> DataFrame:
    """T10."""
    one = F.count(F.lit(1))
    parts = [
        securities.agg(
            one.alias("security_total"),
            F.count_if(F.col("status") == "UNKNOWN").alias("security_unknown"),
            F.count_if(F.col("status") == "ACTIVE").alias("security_active"),
        ),
        companies.agg(one.alias("company_total")),
        obs.agg(one.alias("observation_total"), F.count_if(F.col("value").isNull()).alias("observation_null")),
        segments.agg(one.alias("segment_total")),
        products.agg(one.alias("product_total")),
    ]
    return beside(*parts)


def invariant_failures(stats: DataFrame, floors: dict[str, int]) -> DataFrame:
    """One row per total that is below its floor."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.col(name).cast("bigint").alias("actual"),
                F.lit(floor).cast("bigint").alias("floor"),
            )
            for name, floor in floors.items()
        ]
    )
    return stats.select(F.inline(F.filter(entries, lambda e: e["actual"] < e["floor"])))


def golden_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall, grounding and leaks per case.

    ``results(case_id, name, grounded)``; ``expected(case_id, name, forbidden)``.
    """
    wanted = expected.filter(~F.col("forbidden")).select("case_id", "name", F.lit(1).alias("_want")).distinct()
    banned = expected.filter("forbidden").select("case_id", "name", F.lit(1).alias("_ban")).distinct()
    # Several rows of one name count as one hit, but each counts as a result
    got = results.groupBy("case_id", "name").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("grounded").alias("_grounded")
    )
    joined = got.join(wanted, ["case_id", "name"], "full").join(banned, ["case_id", "name"], "left")
    cases = joined.groupBy("case_id").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("returned"),
        F.coalesce(F.sum("_want"), F.lit(0)).alias("expected"),
        F.count_if(F.col("_rows").isNotNull() & F.col("_want").isNotNull()).alias("hits"),
        F.coalesce(F.sum("_grounded"), F.lit(0)).alias("grounded"),
        F.count_if(F.col("_rows").isNotNull() & F.col("_ban").isNotNull()).alias("leaks"),
        F.count_if(F.col("_rows").isNotNull() & F.col("_want").isNull()).alias("unexpected"),
    )
    return cases.select(
        "case_id", "returned", "expected", "hits", "leaks", "unexpected",
        F.when(F.col("returned") > 0, F.round(F.col("hits") / F.col("returned"), 4))
        .when(F.col("expected") == 0, 1.0).otherwise(0.0).alias("precision"),
        F.when(F.col("expected") > 0, F.round(F.col("hits") / F.col("expected"), 4)).otherwise(1.0).alias("recall"),
        F.when(F.col("returned") > 0, F.round(F.col("grounded") / F.col("returned"), 4)).otherwise(1.0)
        .alias("evidence_grounding"),
    )


def list_by(df: DataFrame, condition: Column, order: list, limit: int = 50) -> DataFrame:
    """Filtered, sorted page of a table."""
    return df.filter(condition).orderBy(*order).limit(limit)


def quality_metrics(claims: DataFrame, links: DataFrame, grounding: DataFrame, tasks: DataFrame) -> DataFrame:
    """T14."""
    accepted = F.col("claim_status") == "ACCEPTED"
    rates = claims.agg(F.count(F.lit(1)).alias("claims"), F.count_if(accepted).alias("accepted"))
    failures = grounding.agg(F.count_if(F.col("grounding") != "OK").alias("grounding_failures"))
    backlog = tasks.filter(F.col("status").isin("OPEN", "IN_PROGRESS")).agg(
        F.count(F.lit(1)).alias("review_backlog")
    )
    proven = claims.filter(accepted).join(links.select("claim_id"), "claim_id", "left_semi").agg(
        F.count(F.lit(1)).alias("accepted_with_evidence")
    )
    row = beside(rates, failures, backlog, proven)
    return row.withColumn("acceptance_rate", F.round(F.col("accepted") / F.col("claims"), 4))
