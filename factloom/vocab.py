"""Closed vocabularies and state machines (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLAIM_STATUS = [
    "EXTRACTED", "VALIDATED", "NEEDS_REVIEW", "ACCEPTED", "CONTRADICTED", "SUPERSEDED", "REJECTED",
]
BUSINESS_STAGES = [
    "TECHNOLOGY_RESERVE", "RESEARCH", "PROTOTYPE", "SAMPLE_VALIDATION", "SMALL_BATCH",
    "MASS_PRODUCTION", "UNKNOWN",
]
EVIDENCE_STATES = [
    "STRUCTURED_SOURCE", "PLATFORM_CLASSIFICATION_ONLY", "PRODUCT_DISCLOSED",
    "REVENUE_DISCLOSED", "COMPANY_DENIAL", "EVIDENCE_INSUFFICIENT",
]
PREDICATES = [
    "ISSUES", "LISTED_ON", "CLASSIFIED_AS", "TAGGED_AS", "PRODUCES", "DEVELOPS",
    "HAS_TECHNOLOGY_RESERVE", "SAMPLES_TO", "SUPPLIES_TO", "USES_TECHNOLOGY",
    "HAS_REVENUE_FROM", "DENIES_INVOLVEMENT", "CONTROLS", "HOLDS", "HAS_SEGMENT",
    "MAPPED_TO_PRODUCT", "VERIFIED_RELEVANT_TO", "DIRECT_EXPOSURE_TO",
    "SECOND_ORDER_EXPOSURE_TO",
]
RELATION_TYPES = PREDICATES + ["BELONGS_TO_INDUSTRY", "PART_OF_PRODUCT"]
NODE_LABELS = [
    "Company", "Security", "Exchange", "Industry", "Concept", "Theme", "Product", "Claim",
    "Evidence", "Document",
]
# Predicates that become edges with a claim id
EDGE_PREDICATES = ["PRODUCES", "DEVELOPS", "SUPPLIES_TO", "HAS_REVENUE_FROM"]
METRICS = ["NET_CF_OPERATING", "TOTAL_REVENUE", "NET_INCOME", "ROE", "NET_PROFIT_YOY"]
SEGMENT_TYPES = {"P": "PRODUCT", "I": "INDUSTRY", "D": "REGION", "M": "SALES_MODE"}
LIST_STATUS = {"L": "ACTIVE", "D": "DELISTED", "P": "PAUSED"}
EXCHANGE_BY_SUFFIX = {"SH": "SSE", "SZ": "SZSE", "BJ": "BSE"}
CONCEPT_PLATFORMS = ["EASTMONEY", "THS", "TUSHARE", "OTHER"]
SOURCE_PRIORITY = {
    "ANNUAL_REPORT": 100,
    "SEMI_ANNUAL_REPORT": 98,
    "PROSPECTUS": 98,
    "EXCHANGE_ANNOUNCEMENT": 97,
    "TUSHARE_STRUCTURED": 90,
    "INTERACTION_REPLY": 90,
    "SURVEY_RECORD": 82,
    "COMPANY_WEBSITE": 78,
    "PLATFORM_CONCEPT_TAG": 60,
    "OTHER_THIRD_PARTY": 50,
}
# metric field -> (code, display name, unit, aggregation, statement)
METRIC_FIELDS = {
    "n_cashflow_act": ("NET_CF_OPERATING", "经营活动产生的现金流量净额", "CNY", "SUM", "CASHFLOW"),
    "revenue": ("TOTAL_REVENUE", "营业总收入", "CNY", "SUM", "INCOME"),
    "n_income": ("NET_INCOME", "净利润", "CNY", "SUM", "INCOME"),
    "roe": ("ROE", "净资产收益率", "RATIO", "LATEST", "INDICATOR"),
    "netprofit_yoy": ("NET_PROFIT_YOY", "净利润同比增长率", "RATIO", "LATEST", "INDICATOR"),
}

# Legal moves of the seven state machines: state -> next states
STATE_MACHINES: dict[str, dict[str, list[str]]] = {
    "ingest_run": {
        "CREATED": ["RUNNING"],
        "RUNNING": ["PARTIAL_SUCCESS", "SUCCEEDED", "FAILED_RETRYABLE", "FAILED_FINAL", "CANCELLED"],
        "FAILED_RETRYABLE": ["RUNNING", "FAILED_FINAL", "CANCELLED"],
        "PARTIAL_SUCCESS": ["RUNNING", "SUCCEEDED", "FAILED_FINAL"],
        "SUCCEEDED": [], "FAILED_FINAL": [], "CANCELLED": [],
    },
    "claim": {
        "EXTRACTED": ["VALIDATED", "NEEDS_REVIEW", "REJECTED"],
        "VALIDATED": ["ACCEPTED", "NEEDS_REVIEW"],
        "NEEDS_REVIEW": ["ACCEPTED", "REJECTED"],
        "ACCEPTED": ["CONTRADICTED", "SUPERSEDED"],
        "CONTRADICTED": ["ACCEPTED", "SUPERSEDED"],
        "REJECTED": [], "SUPERSEDED": [],
    },
    "review_task": {
        "OPEN": ["IN_PROGRESS", "COMPLETED", "CANCELLED"],
        "IN_PROGRESS": ["COMPLETED", "CANCELLED"],
        "COMPLETED": [], "CANCELLED": [],
    },
    "graph_outbox": {
        "PENDING": ["PROCESSING"],
        "PROCESSING": ["PROCESSED", "PENDING", "DEAD_LETTERED"],
        "PROCESSED": [], "DEAD_LETTERED": [],
    },
    "document_parse": {
        "PENDING": ["PARSING", "SKIPPED"],
        "PARSING": ["PARSED", "PARSE_NEEDS_REVIEW", "FAILED_RETRYABLE", "FAILED_FINAL"],
        "PARSE_NEEDS_REVIEW": ["PENDING", "SKIPPED"],
        "FAILED_RETRYABLE": ["PENDING", "PARSING", "FAILED_FINAL", "SKIPPED"],
        "PARSED": [], "FAILED_FINAL": [], "SKIPPED": [],
    },
    "document_download": {
        "DISCOVERED": ["DOWNLOAD_PENDING"],
        "DOWNLOAD_PENDING": ["DOWNLOADING"],
        "DOWNLOADING": ["DOWNLOADED", "DOWNLOAD_FAILED_RETRYABLE", "DOWNLOAD_FAILED_FINAL"],
        "DOWNLOADED": ["DOWNLOAD_PENDING"],
        "DOWNLOAD_FAILED_RETRYABLE": ["DOWNLOAD_PENDING"],
        "DOWNLOAD_FAILED_FINAL": [],
    },
    "query": {
        "RECEIVED": ["PLANNED", "REJECTED"],
        "PLANNED": ["RUNNING", "REJECTED"],
        "RUNNING": ["SUCCEEDED", "DEGRADED", "FAILED", "CANCELLED"],
        "SUCCEEDED": [], "DEGRADED": [], "FAILED": [], "CANCELLED": [], "REJECTED": [],
    },
}


def transitions(spark: SparkSession) -> DataFrame:
    """All legal moves as ``(machine, from_status, to_status)``: about 50 fixed rows."""
    rows = [
        (machine, state, target)
        for machine, states in STATE_MACHINES.items()
        for state, targets in states.items()
        for target in targets
    ]
    return spark.createDataFrame(rows, "machine string, from_status string, to_status string")
