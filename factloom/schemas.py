"""One schema per table of the fact layers (DDL strings Spark parses itself)."""

RAW_RECORD = (
    "source_record_id string, source_system string, api_name string, source_key string, "
    "payload_hash string, payload map<string,string>, request_params map<string,string>, "
    "schema_signature string, retrieved_at timestamp_ntz, run_id string"
)
VENDOR_PAGE = (
    "code int, msg string, data struct<fields: array<string>, items: array<array<string>>>"
)
COMPANY = "id string, canonical_name string, uscc string"
SECURITY = "id string, ts_code string, symbol string, name string, exchange_code string, status string"
COMPANY_SECURITY = "company_id string, security_id string, recorded_at timestamp_ntz"
OBSERVATION = (
    "id string, security_id string, metric_code string, period_end date, report_type string, "
    "value decimal(38,6), currency string, announced_at timestamp_ntz, update_flag string, "
    "recorded_at timestamp_ntz"
)
CLAIM = (
    "claim_id string, subject_type string, subject_id string, predicate_code string, "
    "object_type string, object_id string, object_value string, claim_status string, "
    "business_stage string, evidence_state string, confidence double, valid_from timestamp_ntz, "
    "valid_to timestamp_ntz, recorded_at timestamp_ntz, superseded_at timestamp_ntz"
)
CLAIM_EVIDENCE = "claim_id string, evidence_id string, support_type string, weight double"
FRAGMENT = (
    "evidence_id string, document_id string, document_version_id string, page_number int, "
    "char_start int, char_end int, quote_text string, checksum string"
)
PROVENANCE = (
    "entity_id string, entity_type string, activity_id string, agent_id string, "
    "parent_entity_id string, checksum string, sequence_id long, previous_checksum string"
)
OUTBOX = (
    "seq long, aggregate_type string, aggregate_id string, event_type string, payload string, "
    "idempotency_key string, status string, retry_count int, created_at timestamp_ntz, "
    "lease_expires_at timestamp_ntz"
)
EDGE = "edge_id string, src string, dst string, rel_type string, claim_id string, active boolean"
NODE = "id string, label string, canonical_name string"
