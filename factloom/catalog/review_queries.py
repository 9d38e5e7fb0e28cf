"""V and P rows: event claims, review tasks, and the conversation chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.claim_queries import VERDICT, judged
from factloom.catalog.registry import query
from factloom.operators import provenance as p
from factloom.operators import review as v
from factloom.sources.bindings import Frames
from factloom.vocab import STATE_MACHINES

MOVES_SQL = ", ".join(
    f"('{m}', '{s}', '{t}')" for m, states in STATE_MACHINES.items() for s, ts in states.items() for t in ts
)
LEGAL = f"legal AS (SELECT * FROM (VALUES {MOVES_SQL}) t(machine, from_status, to_status))"
STATUS_SQL = """CASE k % 7 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'VALIDATED' WHEN 2 THEN 'NEEDS_REVIEW' WHEN 3 THEN 'ACCEPTED'
    WHEN 4 THEN 'CONTRADICTED' WHEN 5 THEN 'SUPERSEDED' ELSE 'REJECTED' END"""


@query("v01_illegal_transitions", f"""
    WITH {LEGAL}, moves AS (SELECT claim_id AS move_id, 'claim' AS machine, claim_status AS from_status, {STATUS_SQL} AS to_status FROM claim)
    SELECT move_id, from_status, to_status FROM moves m WHERE NOT EXISTS (SELECT 1 FROM legal l WHERE l.machine = m.machine
        AND l.from_status = m.from_status AND l.to_status = m.to_status)""")
def v01(f: Frames) -> DataFrame:
    moves = f.claims().selectExpr(
        "claim_id AS move_id", "'claim' AS machine", "claim_status AS from_status", f"{STATUS_SQL} AS to_status"
    )
    return v.illegal_transitions(moves).select("move_id", "from_status", "to_status")


def state_moves(f: Frames) -> DataFrame:
    return f.claims().selectExpr(
        "subject_id AS entity_id", "valid_from AS at", "claim_id AS event_id", f"{STATUS_SQL} AS to_status"
    )


# A fold by recursion over the rows of each entity
FOLD = f"""{LEGAL},
    ev AS (SELECT subject_id AS entity_id, claim_id AS event_id, {STATUS_SQL} AS to_status,
           row_number() OVER (PARTITION BY subject_id ORDER BY valid_from, claim_id) AS n FROM claim),
    fold(entity_id, n, event_id, from_status, state, ok) AS (
        SELECT e.entity_id, e.n, e.event_id, 'EXTRACTED', CASE WHEN e.to_status IN ('VALIDATED', 'NEEDS_REVIEW', 'REJECTED') THEN e.to_status ELSE 'EXTRACTED' END,
               e.to_status IN ('VALIDATED', 'NEEDS_REVIEW', 'REJECTED') FROM ev e WHERE n = 1
        UNION ALL
        SELECT e.entity_id, e.n, e.event_id, fold.state, CASE WHEN l.to_status IS NOT NULL THEN e.to_status ELSE fold.state END, l.to_status IS NOT NULL
        FROM fold JOIN ev e ON e.entity_id = fold.entity_id AND e.n = fold.n + 1
        LEFT JOIN legal l ON l.machine = 'claim' AND l.from_status = fold.state AND l.to_status = e.to_status)"""


@query("v02_fold_states", f"""WITH RECURSIVE {FOLD}
    SELECT entity_id, count(*) AS events, arg_max(state, n) AS final_status, count(*) FILTER (NOT ok) AS illegal_moves FROM fold GROUP BY 1""")
def v02(f: Frames) -> DataFrame:
    return v.fold_states(state_moves(f), "claim", "EXTRACTED")


@query("v02_state_before", f"""WITH RECURSIVE {FOLD} SELECT entity_id, event_id, from_status, ok AS legal FROM fold""")
def v02b(f: Frames) -> DataFrame:
    return v.state_before(state_moves(f), "claim", "EXTRACTED").select("entity_id", "event_id", "from_status", "legal")


@query("v03_review_tasks", f"""WITH {VERDICT}
    SELECT claim_id, CASE WHEN verdict = 'NEEDS_REVIEW' THEN 'HIGH' ELSE 'NORMAL' END AS priority, reasons FROM verdict WHERE verdict <> 'VALIDATED'""")
def v03(f: Frames) -> DataFrame:
    return v.review_tasks(judged(f)).select("claim_id", "priority", F.array_join("reason_codes", " | ").alias("reasons"))


@query("v03_review_tasks_all", f"""WITH {VERDICT}
    SELECT CASE WHEN verdict = 'NEEDS_REVIEW' THEN 'HIGH' ELSE 'NORMAL' END AS priority,
           CASE WHEN verdict = 'VALIDATED' THEN 'auto_accept_disabled' ELSE reasons END AS reasons, count(*) AS tasks FROM verdict GROUP BY 1, 2""")
def v03b(f: Frames) -> DataFrame:
    return v.review_tasks(judged(f), auto_accept=False).groupBy(
        "priority", F.array_join("reason_codes", " | ").alias("reasons")
    ).agg(F.count(F.lit(1)).alias("tasks"))


@query("v04_auto_accept", f"""WITH {VERDICT}
    SELECT claim_id FROM verdict WHERE verdict = 'VALIDATED' AND reasons = ''
      AND claim_id NOT IN (SELECT claim_id FROM task WHERE status IN ('OPEN', 'IN_PROGRESS'))""")
def v04(f: Frames) -> DataFrame:
    return v.auto_accept(judged(f), f.tasks()).select("claim_id")


@query("v05_strict_policy", """
    WITH c AS (SELECT *, predicate_code = 'SUPPLIES_TO' OR coalesce(business_stage, '') = 'MASS_PRODUCTION' OR evidence_state IN ('REVENUE_DISCLOSED', 'COMPANY_DENIAL')
        OR k % 17 = 0 OR k % 19 = 0 AS manual FROM claim)
    SELECT claim_id, manual AS manual_review, confidence >= 0.92 AND NOT manual AS strict_auto_accept FROM c""")
def v05(f: Frames) -> DataFrame:
    claims = f.claims().selectExpr(
        "*", "CASE WHEN k % 17 = 0 THEN 'HIGH' ELSE 'LOW' END AS conflict_severity", "'ACCEPTED' AS mapping_status",
        "k % 19 <> 0 AS grounded", "0.99D AS entity_confidence", "0.96D AS mapping_confidence",
    )
    return v.strict_accept_policy(claims).select("claim_id", "manual_review", "strict_auto_accept")


ACCEPTABLE = """acc AS (SELECT claim_id, claim_status FROM claim WHERE claim_status IN ('VALIDATED', 'NEEDS_REVIEW', 'CONTRADICTED')
    AND claim_id IN (SELECT claim_id FROM live_link))"""


def _accepted(f: Frames) -> dict[str, DataFrame]:
    return v.accept_batch(f.claims(), f.claim_evidence(), f.fragments(), "reviewer")


@query("v06_accept_batch", f"""WITH {ACCEPTABLE}
    SELECT claim_id, claim_status AS before_status, 'ACCEPTED' AS after_status, 'reviewer' AS actor FROM acc""")
def v06(f: Frames) -> DataFrame:
    return _accepted(f)["claims"]


@query("v06_accept_outputs", f"""WITH {ACCEPTABLE}
    SELECT * FROM (VALUES ('claims'), ('links'), ('provenance'), ('audit'), ('outbox')) t(frame) CROSS JOIN (SELECT count(*) AS rows FROM acc)""")
def v06b(f: Frames) -> DataFrame:
    import uuid

    from factloom.session import ensure_checkpoint_dir
    from factloom.sources import sinks

    root = f"{ensure_checkpoint_dir(f.spark)}/commits/{uuid.uuid4().hex}"
    frames = _accepted(f)
    sinks.write_commit(frames, root, "batch-1")
    parts = [
        sinks.read_commits(f.spark, root, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("frame"), "rows")
        for name in frames
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decided(proven: str) -> str:
    """Decisions with their outcome; ``proven`` is the condition on a claim that may be accepted."""
    return f"""dec AS (SELECT event_id AS decision_id, event_id + 1000000000 - CAST(round(value) AS INT) % 3 AS task_id,
        CASE WHEN user_id % 3 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS decision, ts AS decided_at FROM events),
    mov AS (SELECT d.*, t.claim_id, t.status AS task_status, c.claim_status,
            (decision = 'ACCEPTED' AND claim_status IN ('VALIDATED', 'NEEDS_REVIEW', 'CONTRADICTED'))
             OR (decision = 'REJECTED' AND claim_status IN ('NEEDS_REVIEW', 'EXTRACTED')) AS may
        FROM dec d LEFT JOIN task t USING (task_id) LEFT JOIN claim c ON c.claim_id = t.claim_id),
    jud AS (SELECT *, may AND (decision <> 'ACCEPTED' OR {proven}) AS legal FROM mov),
    won AS (SELECT claim_id, task_id AS won_task, decision_id AS won_by, decided_at AS won_at FROM jud
        WHERE legal AND task_status IN ('OPEN', 'IN_PROGRESS')
        QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY decided_at, decision_id) = 1),
    fin AS (SELECT *, CASE WHEN task_status IS NULL THEN 'task not found' WHEN task_status NOT IN ('OPEN', 'IN_PROGRESS') THEN 'task closed'
        WHEN claim_status IS NULL THEN 'claim not found' WHEN decision_id = won_by THEN NULL
        WHEN task_id = won_task AND (decided_at > won_at OR decided_at = won_at AND decision_id > won_by) THEN 'decided before'
        WHEN may AND NOT legal THEN 'evidence missing' ELSE 'illegal transition' END AS conflict FROM jud LEFT JOIN won USING (claim_id))"""


DECIDED = decided("true")
DECIDE = decided("claim_id IN (SELECT claim_id FROM live_link)")


def _decisions(f: Frames) -> DataFrame:
    return f.table("events").selectExpr(
        "event_id AS decision_id", "event_id + 1000000000 - CAST(round(value) AS INT) % 3 AS task_id",
        "CASE WHEN user_id % 3 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS decision", "ts AS decided_at", "'r' AS reviewer",
    )


@query("v07_apply_decisions", f"""WITH {DECIDED}
    SELECT task_id, decision_id, claim_id, claim_status AS before_status, decision AS after_status FROM fin WHERE conflict IS NULL""")
def v07(f: Frames) -> DataFrame:
    return v.apply_decisions(f.tasks(), f.claims(), _decisions(f))[0].select(
        "task_id", "decision_id", "claim_id", "before_status", "after_status"
    )


@query("v07_decision_conflicts", f"""WITH {DECIDED} SELECT task_id, decision_id, conflict FROM fin WHERE conflict IS NOT NULL""")
def v07b(f: Frames) -> DataFrame:
    return v.apply_decisions(f.tasks(), f.claims(), _decisions(f))[1].select("task_id", "decision_id", "conflict")


def _decide(f: Frames) -> dict[str, DataFrame]:
    return v.decide(f.tasks(), f.claims(), _decisions(f), f.claim_evidence(), f.fragments(), f.outbox().filter("status = 'PROCESSED'"))


@query("v07_decide_outcomes", f"""WITH {DECIDE}
    SELECT decision_id, task_id, coalesce(conflict, decision) AS outcome FROM fin""")
def v07c(f: Frames) -> DataFrame:
    """Every decision with its outcome, acceptances checked for evidence."""
    out = _decide(f)
    done = out["tasks"].join(_decisions(f), ["decision_id", "task_id"]).select("decision_id", "task_id", F.col("decision").alias("outcome"))
    return done.unionByName(out["conflicts"].select("decision_id", "task_id", F.col("conflict").alias("outcome")))


@query("v07_decide_outputs", f"""WITH {DECIDE}, app AS (SELECT * FROM fin WHERE conflict IS NULL), yes AS (SELECT * FROM app WHERE decision = 'ACCEPTED')
    SELECT 'claims' AS output, CAST(claim_id AS VARCHAR) AS key, concat(claim_status, '>', decision) AS content FROM app
    UNION ALL SELECT 'links', CAST(claim_id AS VARCHAR), CAST(evidence_id AS VARCHAR) FROM ev_link WHERE claim_id IN (SELECT claim_id FROM yes)
    UNION ALL SELECT 'provenance', CAST(claim_id AS VARCHAR), concat('review-', task_id) FROM yes
    UNION ALL SELECT 'audit', CAST(claim_id AS VARCHAR), 'CLAIM_ACCEPTED' FROM yes
    UNION ALL SELECT 'audit', CAST(claim_id AS VARCHAR), concat('REVIEW_', decision) FROM app
    UNION ALL SELECT 'outbox', CAST(claim_id AS VARCHAR), concat('claim-accepted:', claim_id) FROM yes
        WHERE claim_id NOT IN (SELECT aggregate_id FROM outbox WHERE status = 'PROCESSED')
    UNION ALL SELECT 'tasks', CAST(task_id AS VARCHAR), 'COMPLETED' FROM app""")
def v07d(f: Frames) -> DataFrame:
    out = _decide(f)
    content = {
        "claims": ("claim_id", F.concat_ws(">", "before_status", "after_status")), "links": ("claim_id", F.col("evidence_id")),
        "provenance": ("entity_id", F.col("activity_id")), "audit": ("claim_id", F.col("event_type")),
        "outbox": ("aggregate_id", F.col("idempotency_key")), "tasks": ("task_id", F.col("task_status")),
    }
    parts = [
        out[name].select(F.lit(name).alias("output"), F.col(key).cast("string").alias("key"), value.cast("string").alias("content"))
        for name, (key, value) in content.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@query("v08_dedup_decisions", """
    SELECT user_id AS task_id, event_type AS idempotency_key, arg_min(event_id, (ts, event_id)) AS decision_id FROM events GROUP BY 1, 2""")
def v08(f: Frames) -> DataFrame:
    rows = f.table("events").selectExpr("user_id AS task_id", "event_type AS idempotency_key", "event_id AS decision_id", "ts AS decided_at")
    return v.dedup_decisions(rows).select("task_id", "idempotency_key", "decision_id")


@query("v09_review_queue", """
    SELECT t.task_id, t.priority, c.claim_id, c.predicate_code, c.claim_status,
           (SELECT count(*) FROM ev_link k WHERE k.claim_id = c.claim_id) AS evidence_count,
           (SELECT count(*) FROM task WHERE status = 'OPEN') AS total
    FROM task t JOIN claim c USING (claim_id) WHERE t.status = 'OPEN' ORDER BY t.created_at, t.task_id LIMIT 50""")
def v09(f: Frames) -> DataFrame:
    rows, total = v.review_queue(f.tasks(), f.claims(), f.claim_evidence())
    return rows.select("task_id", "priority", "claim_id", "predicate_code", "claim_status", "evidence_count",
                       total.scalar().alias("total"))


@query("v10_outbox_events", f"""WITH {ACCEPTABLE}
    SELECT claim_id AS aggregate_id, concat('claim-accepted:', claim_id) AS idempotency_key FROM acc
    WHERE claim_id NOT IN (SELECT aggregate_id FROM outbox WHERE status = 'PROCESSED')""")
def v10(f: Frames) -> DataFrame:
    accepted = _accepted(f)["claims"]
    return v.outbox_events(accepted, f.outbox().filter("status = 'PROCESSED'")).select("aggregate_id", "idempotency_key")


@query("v11_audit_events", f"""WITH {ACCEPTABLE}
    SELECT claim_id AS entity_id, 'REVIEW_ACCEPTED' AS event_type, claim_status AS before_status FROM acc""")
def v11(f: Frames) -> DataFrame:
    changes = _accepted(f)["claims"].withColumn("reason", F.lit("checked"))
    return v.audit_events(changes).select("entity_id", "event_type", "before_status")


@query("v12_evidence_links", """
    SELECT user_id AS claim_id, event_type AS evidence_id, 'SUPPORTS' AS support_type, max(value) AS weight FROM events GROUP BY 1, 2""")
def v12(f: Frames) -> DataFrame:
    pairs = f.table("events").selectExpr("user_id AS claim_id", "event_type AS evidence_id", "CAST(NULL AS STRING) AS support_type", "value AS weight")
    return v.evidence_links(pairs)


@query("p01_provenance_checksum", """
    SELECT concat(conv_id, '-', turn) AS entity_id, sha256(concat('{"entity_id":"', conv_id, '-', turn, '","activity_id":"turn","agent_id":"', role,
        '","used_entities":["a","b"],"metadata":"', length(text), '"}')) AS checksum FROM conversations""")
def p01(f: Frames) -> DataFrame:
    entries = f.table("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("entity_id"), F.lit("turn").alias("activity_id"), F.col("role").alias("agent_id"),
        F.array(F.lit("b"), F.lit("a")).alias("used_entities"), F.length("text").cast("string").alias("metadata"),
    )
    return p.provenance_checksum(entries).select("entity_id", "checksum")


@query("p02_append_chain", """
    WITH base AS (SELECT * FROM chain WHERE entity_type <> 'assistant'),
    fresh AS (SELECT *, row_number() OVER (ORDER BY sequence_id) AS n FROM chain WHERE entity_type = 'assistant'),
    head AS (SELECT max(sequence_id) AS s, arg_max(checksum, sequence_id) AS c FROM base)
    SELECT entity_id, checksum, n + (SELECT s FROM head) AS sequence_id,
           coalesce(lag(checksum) OVER (ORDER BY n), (SELECT c FROM head)) AS previous_checksum FROM fresh""")
def p02(f: Frames) -> DataFrame:
    entries = f.chain().withColumnRenamed("sequence_id", "arrival")
    base = f.chain().filter("entity_type <> 'assistant'")
    return p.append_chain(entries, base, ["arrival"]).select("entity_id", "checksum", "sequence_id", "previous_checksum")


@query("p03_verify_chain", """
    SELECT sequence_id FROM (SELECT sequence_id, checksum, lag(checksum) OVER (ORDER BY sequence_id) AS expected,
        CASE WHEN sequence_id % 50 = 3 THEN 'broken' ELSE lag(checksum) OVER (ORDER BY sequence_id) END AS previous FROM chain)
    WHERE previous IS DISTINCT FROM expected""")
def p03(f: Frames) -> DataFrame:
    chain = p.append_chain(f.chain().withColumnRenamed("sequence_id", "arrival"), None, ["arrival"])
    linked = chain.select(
        F.col("arrival").alias("sequence_id"), "checksum",
        F.when(F.col("arrival") % 50 == 3, "broken").otherwise(F.col("previous_checksum")).alias("previous_checksum"),
    )
    # A small block makes the checks run across blocks at every size
    return p.verify_chain(linked, 1000).select("sequence_id")


@query("p04_lineage", """
    WITH RECURSIVE up(start_id, depth, entity_id, parent_entity_id) AS (
        SELECT entity_id, 0, entity_id, parent_entity_id FROM chain WHERE entity_type = 'user'
        UNION ALL SELECT up.start_id, up.depth + 1, c.entity_id, c.parent_entity_id FROM up JOIN chain c ON c.entity_id = up.parent_entity_id
        WHERE up.depth < 9)
    SELECT start_id, depth, entity_id FROM up""")
def p04(f: Frames) -> DataFrame:
    ids = f.chain().filter("entity_type = 'user'").select("entity_id")
    return p.lineage(f.chain(), ids, 10).select("start_id", "depth", "entity_id")


@query("p05_descendants", """
    SELECT entity_id, sequence_id FROM chain WHERE parent_entity_id = (SELECT concat(max(conv_id), '-0') FROM conversations)
    ORDER BY sequence_id LIMIT 5""")
def p05(f: Frames) -> DataFrame:
    parent = f.table("conversations").agg(F.concat(F.max("conv_id").cast("string"), F.lit("-0"))).scalar()
    return p.descendants(f.chain(), parent, 5).select("entity_id", "sequence_id")


@query("p06_latest_entry", """
    SELECT split_part(entity_id, '-', 1) AS entity_id, max(sequence_id) AS sequence_id, arg_max(checksum, sequence_id) AS checksum FROM chain GROUP BY 1""")
def p06(f: Frames) -> DataFrame:
    chain = f.chain().withColumn("entity_id", F.split("entity_id", "-")[0])
    return p.latest_entry(chain).select("entity_id", "sequence_id", "checksum")


@query("p06_chain_head", "SELECT sequence_id, checksum FROM chain ORDER BY sequence_id DESC LIMIT 1")
def p06b(f: Frames) -> DataFrame:
    return p.chain_head(f.chain()).select("sequence_id", "checksum")


@query("p06_entries_by_type", "SELECT entity_id, sequence_id FROM chain WHERE entity_type = 'system'")
def p06c(f: Frames) -> DataFrame:
    return p.entries_by_type(f.chain(), "system").select("entity_id", "sequence_id")


@query("p07_claim_lineage", """
    SELECT c.claim_id, k.evidence_id, f.page_number, f.document_id, d.source AS source_system
    FROM claim c LEFT JOIN ev_link k USING (claim_id) LEFT JOIN fragment f ON f.evidence_id = k.evidence_id
    LEFT JOIN documents d ON d.doc_id = f.document_id""")
def p07(f: Frames) -> DataFrame:
    docs = f.table("documents").selectExpr("doc_id AS document_id", "source AS source_system", "lang AS title")
    trail = p.claim_lineage(f.claims(), f.claim_evidence(), f.fragments(), docs)
    return trail.select("claim_id", "evidence_id", "page_number", "document_id", "source_system")


@query("p08_open_ends_closed", """
    SELECT claim_id, coalesce(valid_to, TIMESTAMP '9999-12-31 00:00:00') AS valid_to,
           coalesce(superseded_at, TIMESTAMP '9999-12-31 00:00:00') AS superseded_at FROM claim""")
def p08b(f: Frames) -> DataFrame:
    return p.to_bitemporal(f.claims()).select("claim_id", "valid_to", "superseded_at")


@query("p08_bitemporal_round_trip", "SELECT claim_id, valid_to, superseded_at FROM claim")
def p08(f: Frames) -> DataFrame:
    return p.from_bitemporal(p.to_bitemporal(f.claims())).select("claim_id", "valid_to", "superseded_at")
