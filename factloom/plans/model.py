"""Query plan: the closed set of questions a screen may ask."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from factloom.vocab import BUSINESS_STAGES, METRICS

INTENTS = [
    "ENTITY_LOOKUP", "SEMANTIC_SCREEN", "EXPLAIN_RELATION", "TIMELINE", "COMPARE", "EVIDENCE_SEARCH",
]
OPERATORS = ["TOTAL_POSITIVE", "CONSECUTIVE_POSITIVE", "MIN_VALUE", "MAX_VALUE"]
# period rule -> (required years, required operator)
PERIOD_RULES = {
    "LAST_1_FY": (1, None),
    "LAST_3_FY": (3, None),
    "LAST_5_FY": (5, None),
    "LAST_3_FY_TOTAL_POSITIVE": (3, "TOTAL_POSITIVE"),
    "CONSECUTIVE_3_FY_POSITIVE": (3, "CONSECUTIVE_POSITIVE"),
}


@dataclass(frozen=True)
class NumericFilter:
    metric: str
    operator: str = "TOTAL_POSITIVE"
    fiscal_years: int = 3
    threshold: float | None = None
    period_rule: str | None = None

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric {self.metric!r} not in allowed catalog")
        if self.operator not in OPERATORS:
            raise ValueError(f"operator {self.operator!r} not supported")
        if not 1 <= self.fiscal_years <= 10:
            raise ValueError("fiscal_years must be 1..10")
        if self.operator in ("MIN_VALUE", "MAX_VALUE") and self.threshold is None:
            raise ValueError(f"operator {self.operator} requires threshold")
        rule = self.rule
        if rule is None:
            return
        if rule not in PERIOD_RULES:
            raise ValueError(f"period_rule {rule!r} not supported")
        years, operator = PERIOD_RULES[rule]
        if self.fiscal_years != years or operator not in (None, self.operator):
            raise ValueError(f"period_rule {rule} does not fit {self.operator} over {self.fiscal_years} years")

    @property
    def rule(self) -> str | None:
        """The given period rule, or the one that follows from years and operator."""
        if self.period_rule:
            return self.period_rule
        if self.fiscal_years == 3:
            return {
                "TOTAL_POSITIVE": "LAST_3_FY_TOTAL_POSITIVE",
                "CONSECUTIVE_POSITIVE": "CONSECUTIVE_3_FY_POSITIVE",
            }.get(self.operator, "LAST_3_FY")
        return {1: "LAST_1_FY", 5: "LAST_5_FY"}.get(self.fiscal_years)


@dataclass(frozen=True)
class QueryPlan:
    intent: str = "SEMANTIC_SCREEN"
    subject_id: object | None = None
    object_id: object | None = None
    concept_name: str | None = None
    business_stage: str | None = None
    max_hops: int = 2
    numeric: NumericFilter | None = None
    evidence_required: bool = True
    as_of: dt.datetime | None = None
    known_at: dt.datetime | None = None
    max_results: int = 50

    def __post_init__(self) -> None:
        if self.intent not in INTENTS:
            raise ValueError(f"intent {self.intent!r} not supported")
        if not 1 <= self.max_results <= 100:
            raise ValueError("max_results must be 1..100")
        if not 1 <= self.max_hops <= 4:
            raise ValueError("max_hops must be 1..4")
        if self.business_stage is not None and self.business_stage not in BUSINESS_STAGES:
            raise ValueError(f"business_stage {self.business_stage!r} not known")
        if self.intent == "EXPLAIN_RELATION" and (self.subject_id is None or self.object_id is None):
            raise ValueError("EXPLAIN_RELATION requires both subject and object")
        if self.intent == "TIMELINE" and self.subject_id is None:
            raise ValueError("TIMELINE requires a subject")

    @property
    def needs_graph(self) -> bool:
        return self.concept_name is not None or self.business_stage is not None
