"""Review, acceptance and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.hashing import stable_id
from factloom.operators.folds import fold_states, state_before  # noqa: F401
from factloom.session import ensure_checkpoint_dir
from factloom.vocab import STATE_MACHINES, transitions

OPEN_TASK = ["OPEN", "IN_PROGRESS"]


def illegal_transitions(moves: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """V1: ``moves(machine, from_status, to_status, ...)`` that no machine allows."""
    table = transitions(moves.sparkSession) if table is None else table
    return moves.join(table, ["machine", "from_status", "to_status"], "left_anti")


def review_tasks(claims: DataFrame, auto_accept: bool = True, max_reasons: int | None = None) -> DataFrame:
    """V3: task per claim whose verdict asks for one, with all reasons or the first ``max_reasons``."""
    status = F.col("verdict")
    wanted = status.isin("NEEDS_REVIEW", "REJECTED")
    reasons = F.col("reasons") if max_reasons is None else F.slice("reasons", 1, max_reasons)
    if not auto_accept:
        wanted = wanted | (status == "VALIDATED")
        reasons = F.when(status == "VALIDATED", F.array(F.lit("auto_accept_disabled"))).otherwise(reasons)
    return claims.filter(wanted).select(
        stable_id("review", F.col("claim_id")).alias("task_id"),
        F.lit("CLAIM_REVIEW").alias("task_type"),
        "claim_id",
        F.when(status == "NEEDS_REVIEW", "HIGH").otherwise("NORMAL").alias("priority"),
        reasons.alias("reason_codes"),
        F.lit("OPEN").alias("status"),
    )


def auto_accept(claims: DataFrame, tasks: DataFrame, enabled: bool = True) -> DataFrame:
    """V4: validated claims without reasons and without an open task."""
    if not enabled:
        return claims.limit(0)
    waiting = tasks.filter(F.col("status").isin(OPEN_TASK)).select("claim_id")
    return claims.filter((F.col("verdict") == "VALIDATED") & (F.size("reasons") == 0)).join(
        waiting, "claim_id", "left_anti"
    )


def strict_accept_policy(claims: DataFrame) -> DataFrame:
    """V5: the declared stricter thresholds, as columns beside the claim."""
    manual = (
        F.col("conflict_severity").isin("HIGH", "CRITICAL")
        | F.col("predicate_code").isin("CONTROLS", "SUPPLIES_TO")
        | (F.col("business_stage") == "MASS_PRODUCTION")
        | F.col("evidence_state").isin("REVENUE_DISCLOSED", "COMPANY_DENIAL")
        | (F.col("mapping_status") == "AMBIGUOUS")
        | ~F.col("grounded")
    )
    auto = (
        (F.col("grounded") | (F.col("evidence_state") == "STRUCTURED_SOURCE"))
        & (F.col("entity_confidence") >= 0.98)
        & (F.col("mapping_confidence") >= 0.95)
        & (F.col("confidence") >= 0.92)
    )
    out = claims.withColumn("manual_review", F.coalesce(manual, F.lit(False)))
    return out.withColumn("strict_auto_accept", F.coalesce(auto, F.lit(False)) & ~F.col("manual_review"))


def evidence_links(pairs: DataFrame) -> DataFrame:
    """One link per (claim, evidence, support type)."""
    return pairs.withColumns(
        {
            "support_type": F.coalesce("support_type", F.lit("SUPPORTS")),
            "weight": F.coalesce("weight", F.lit(1.0)),
        }
    ).groupBy("claim_id", "evidence_id", "support_type").agg(F.max("weight").alias("weight"))


def outbox_events(accepted: DataFrame, outbox: DataFrame | None = None) -> DataFrame:
    """One event per accepted claim; a key already in the outbox adds nothing."""
    key = F.concat(F.lit("claim-accepted:"), F.col("claim_id").cast("string"))
    events = accepted.select(
        F.lit("Claim").alias("aggregate_type"),
        F.col("claim_id").alias("aggregate_id"),
        F.lit("CLAIM_ACCEPTED").alias("event_type"),
        key.alias("idempotency_key"),
        F.lit("PENDING").alias("status"),
    ).dropDuplicates(["idempotency_key"])
    if outbox is None:
        return events
    return events.join(outbox.select("idempotency_key"), "idempotency_key", "left_anti")


def audit_events(changes: DataFrame, reason_chars: int | None = None) -> DataFrame:
    """``changes(claim_id, before_status, after_status, actor, reason)``; the reason whole, or its first characters."""
    return changes.select(
        F.lit("ClaimReview").alias("entity_type"),
        F.col("claim_id").alias("entity_id"),
        F.concat(F.lit("REVIEW_"), "after_status").alias("event_type"),
        "before_status", "after_status", "actor",
        F.col("reason") if reason_chars is None else F.substring("reason", 1, reason_chars).alias("reason"),
    )


def evidenced(links: DataFrame, fragments: DataFrame) -> DataFrame:
    """``claim_id`` of the claims that have evidence, all of which exists."""
    present = fragments.select("evidence_id").distinct().withColumn("_there", F.lit(1))
    return (
        links.join(present, "evidence_id", "left")
        .groupBy("claim_id")
        .agg(F.count(F.lit(1)).alias("_links"), F.count("_there").alias("_found"))
        .filter("_links = _found")
        .select("claim_id")
    )


def _acceptance(moved: DataFrame, links: DataFrame, outbox: DataFrame | None) -> dict[str, DataFrame]:
    """The five outputs of an acceptance of ``moved(claim_id, before_status, after_status, actor, activity_id)``."""
    return {
        "claims": moved.select("claim_id", "before_status", "after_status", "actor"),
        "links": evidence_links(links.join(moved.select("claim_id"), "claim_id", "left_semi")),
        "provenance": moved.select(
            F.col("claim_id").cast("string").alias("entity_id"), F.lit("Claim").alias("entity_type"), "activity_id",
            F.col("actor").alias("agent_id"),
        ),
        "audit": moved.select("claim_id", "before_status", "after_status", "actor", F.lit("CLAIM_ACCEPTED").alias("event_type")),
        "outbox": outbox_events(moved, outbox),
    }


def accept_batch(
    claims: DataFrame,
    links: DataFrame,
    fragments: DataFrame,
    actor: str,
    outbox: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """V6: the five outputs of one acceptance, all derived from one accepted set.

    A claim is accepted when the move is legal, it has evidence, and all of it
    exists. The accepted set is formed once and stored; write the outputs with
    ``sinks.write_commit``, which shows them together or not at all.
    """
    sources = [s for s, targets in STATE_MACHINES["claim"].items() if "ACCEPTED" in targets]
    accepted = claims.filter(F.col("claim_status").isin(sources)).join(evidenced(links, fragments), "claim_id", "left_semi")
    ensure_checkpoint_dir(claims.sparkSession)
    moved = accepted.select(
        "claim_id", F.col("claim_status").alias("before_status"), F.lit("ACCEPTED").alias("after_status"),
        F.lit(actor).alias("actor"), F.concat(F.lit("accept-"), F.col("claim_id").cast("string")).alias("activity_id"),
    ).checkpoint()
    return _acceptance(moved, links, outbox)


def dedup_decisions(decisions: DataFrame) -> DataFrame:
    """V8: the first result per (task, idempotency key) stands."""
    rest = [c for c in decisions.columns if c not in ("task_id", "idempotency_key")]
    first = F.min_by(F.struct(*rest), F.struct("decided_at", "decision_id"))
    return decisions.groupBy("task_id", "idempotency_key").agg(first.alias("s")).select(
        "task_id", "idempotency_key", "s.*"
    )


def apply_decisions(
    tasks: DataFrame, claims: DataFrame, decisions: DataFrame, proven: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """V7: ``(applied, conflicts)``; the first legal decision of a claim wins.

    With ``proven(claim_id)``, an acceptance of any other claim is refused too.

    A decision that the claim's status forbids is refused and leaves its task open, so a later
    legal one is applied. The winner moves the claim to a status from which no decision leads on:
    later ones of its task were decided before, those of the claim's other tasks are illegal.
    """
    table = transitions(tasks.sparkSession).filter(F.col("machine") == "claim").select(
        F.col("from_status").alias("claim_status"), F.col("to_status").alias("decision"),
        F.lit(True).alias("_legal"),
    )
    seen = (
        decisions
        .join(tasks.select("task_id", "claim_id", F.col("status").alias("task_status")), "task_id", "left")
        .join(claims.select("claim_id", "claim_status"), "claim_id", "left")
        .join(table, ["claim_status", "decision"], "left")
    )
    if proven is None:
        seen = seen.withColumn("_bare", F.lit(False))
    else:
        marked = proven.select("claim_id").distinct().withColumn("_proven", F.lit(True))
        seen = seen.join(marked, "claim_id", "left").withColumn("_bare", (F.col("decision") == "ACCEPTED") & F.col("_proven").isNull()).drop("_proven")
    place = F.struct("decided_at", "decision_id", "task_id")
    legal = F.col("_legal").isNotNull() & F.col("task_status").isin(OPEN_TASK) & ~F.col("_bare")
    winners = seen.filter(legal).groupBy("claim_id").agg(F.min(place).alias("_won"))
    judged = (
        seen.join(winners, "claim_id", "left")
        .withColumn(
            "conflict",
            F.when(F.col("task_status").isNull(), "task not found")
            .when(~F.col("task_status").isin(OPEN_TASK), "task closed")
            .when(F.col("claim_status").isNull(), "claim not found")
            .when((F.col("task_id") == F.col("_won.task_id")) & (place > F.col("_won")), "decided before")
            .when(F.col("_legal").isNotNull() & F.col("_bare"), "evidence missing")
            .when(~F.coalesce(place == F.col("_won"), F.lit(False)), "illegal transition"),
        )
        .drop("_won", "_legal", "_bare")
    )
    applied = judged.filter(F.col("conflict").isNull()).select(
        "task_id", "decision_id", "claim_id",
        F.col("claim_status").alias("before_status"),
        F.col("decision").alias("after_status"),
        F.lit("COMPLETED").alias("task_status"),
        "reviewer", "decided_at",
    )
    conflicts = judged.filter(F.col("conflict").isNotNull()).select(
        "task_id", "decision_id", "decision", "claim_status", "conflict"
    )
    return applied, conflicts


def decide(
    tasks: DataFrame, claims: DataFrame, decisions: DataFrame, links: DataFrame, fragments: DataFrame,
    outbox: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """V7 to V6: decisions with all that an acceptance brings about.

    An accepted claim needs evidence that exists, and gives its links, a provenance
    entry, an audit event and an outbox event; a rejected one moves only. Every
    applied decision gives a review event and completes its task. Refused
    decisions are in ``conflicts``. Write the outputs with ``sinks.write_commit``.
    """
    applied, conflicts = apply_decisions(tasks, claims, decisions, evidenced(links, fragments))
    ensure_checkpoint_dir(claims.sparkSession)
    applied = applied.checkpoint()
    moved = applied.select(
        "claim_id", "before_status", "after_status", F.col("reviewer").alias("actor"),
        F.concat(F.lit("review-"), F.col("task_id").cast("string")).alias("activity_id"),
    )
    out = _acceptance(moved.filter("after_status = 'ACCEPTED'"), links, outbox)
    reviews = moved.select(
        "claim_id", "before_status", "after_status", "actor", F.concat(F.lit("REVIEW_"), "after_status").alias("event_type")
    )
    return {
        **out, "claims": moved.select("claim_id", "before_status", "after_status", "actor"),
        "audit": out["audit"].unionByName(reviews), "tasks": applied.select("task_id", "decision_id", "task_status", "decided_at"),
        "conflicts": conflicts,
    }


def review_queue(
    tasks: DataFrame, claims: DataFrame, links: DataFrame, status: str = "OPEN", limit: int = 50
) -> tuple[DataFrame, DataFrame]:
    """V9: oldest open tasks with claim and evidence count, and the total.

    The page is cut before the joins, so evidence is counted for its claims only.
    """
    if status not in STATE_MACHINES["review_task"]:
        raise ValueError(f"status {status!r} not known")
    waiting = tasks.filter(F.col("status") == status).join(
        claims.select("claim_id"), "claim_id", "left_semi"
    )
    page = waiting.orderBy("created_at", "task_id").limit(limit)
    counts = (
        links.join(page.select("claim_id"), "claim_id", "left_semi")
        .groupBy("claim_id")
        .agg(F.count(F.lit(1)).alias("evidence_count"))
    )
    rows = (
        page.join(claims, "claim_id")
        .join(counts, "claim_id", "left")
        .select(
            "task_id", "priority", "created_at", "claim_id", "predicate_code", "claim_status",
            "business_stage", "evidence_state", "confidence", "subject_id",
            F.coalesce("evidence_count", F.lit(0)).cast("bigint").alias("evidence_count"),
        )
        .orderBy("created_at", "task_id")
    )
    total = tasks.filter(F.col("status") == status).agg(F.count(F.lit(1)).alias("total"))
    return rows, total
