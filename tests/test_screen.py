"""Screen semantics on literal rows: sums, every year, too few years, evidence, two time axes."""

import datetime as dt

import pytest

from factloom.plans.model import NumericFilter, QueryPlan
from factloom.plans.screen import screen

FY = {
    "ok": {2024: 100, 2023: 200, 2022: 300, 2021: 400, 2020: 500},
    "loss": {2024: 100, 2023: -50, 2022: 200},
    "short": {2024: 100, 2023: 200},
}
COMPANIES = ["prod_a", "prod_b", "research", "no_evidence", "ok", "loss", "short"]


@pytest.fixture(scope="module")
def tables(spark):
    day = dt.datetime(2024, 6, 1)
    claims, links, obs = [], [], []
    for i, c in enumerate(COMPANIES):
        stage = "MASS_PRODUCTION" if c.startswith("prod") else "RESEARCH"
        claims.append((f"c{i}", c, "PRODUCES", "p1", "ACCEPTED", stage, "PRODUCT_DISCLOSED", None, None, day, None))
        if c not in ("no_evidence",):
            links.append((f"c{i}", f"e{i}"))
    for c, years in FY.items():
        for year, value in years.items():
            obs.append((f"{c}{year}", f"s-{c}", "NET_CF_OPERATING", dt.date(year, 12, 31), "1", float(value), "CNY",
                        dt.datetime(year + 1, 4, 1), None, day))
    return {
        "company": spark.createDataFrame([(c, c) for c in COMPANIES], "id string, canonical_name string"),
        "links": spark.createDataFrame([(c, f"s-{c}", day) for c in COMPANIES], "company_id string, security_id string, recorded_at timestamp_ntz"),
        "securities": spark.createDataFrame([(f"s-{c}", f"00000{i}.SZ") for i, c in enumerate(COMPANIES)], "security_id string, ts_code string"),
        "observations": spark.createDataFrame(
            obs, "id string, security_id string, metric_code string, period_end date, report_type string, value double, "
            "currency string, announced_at timestamp_ntz, update_flag string, recorded_at timestamp_ntz"),
        "claims": spark.createDataFrame(
            claims, "claim_id string, subject_id string, predicate_code string, object_id string, claim_status string, "
            "business_stage string, evidence_state string, valid_from timestamp_ntz, valid_to timestamp_ntz, "
            "recorded_at timestamp_ntz, superseded_at timestamp_ntz"),
        "claim_evidence": spark.createDataFrame(links, "claim_id string, evidence_id string"),
        "fragments": spark.createDataFrame([(f"e{i}", 1, "text") for i in range(len(COMPANIES))], "evidence_id string, page_number int, quote_text string"),
        "products": spark.createDataFrame([("p1", "Gear")], "product_id string, canonical_name string"),
    }


def values(answer):
    return {r.company_id: r.financial_value for r in answer.results.collect()}


def test_sum_over_three_years(tables):
    answer = screen(tables, QueryPlan(numeric=NumericFilter("NET_CF_OPERATING")))
    assert values(answer) == {"ok": 600.0, "loss": 250.0}
    reasons = {r.company_id: r.reason for r in answer.excluded.collect()}
    assert reasons["short"].startswith("insufficient financial data (insufficient_complete_fiscal_years: 2")
    assert reasons["research"] == "no financial observations for metric NET_CF_OPERATING"


def test_every_year_positive_differs_from_sum(tables):
    answer = screen(tables, QueryPlan(numeric=NumericFilter("NET_CF_OPERATING", "CONSECUTIVE_POSITIVE")))
    assert values(answer) == {"ok": 100.0}
    reasons = {r.company_id: r.reason for r in answer.excluded.collect()}
    assert reasons["loss"] == "financial filter not passed (CONSECUTIVE_POSITIVE=-50.0)"


def test_business_time_moves_the_window(tables):
    plan = QueryPlan(numeric=NumericFilter("NET_CF_OPERATING"), as_of=dt.datetime(2023, 6, 30))
    assert values(screen(tables, plan)) == {"ok": 1200.0}


def test_nothing_was_known_earlier(tables):
    plan = QueryPlan(numeric=NumericFilter("NET_CF_OPERATING"), known_at=dt.datetime(2020, 1, 1))
    answer = screen(tables, plan)
    assert values(answer) == {}
    assert {r.reason for r in answer.excluded.collect()} == {"no matching claims"}


def test_missing_evidence_is_unknown_not_false(tables):
    answer = screen(tables, QueryPlan())
    assert "no_evidence" not in values(answer)
    assert [r.company_id for r in answer.unknowns.collect()] == ["no_evidence"]


def test_stage_without_graph_degrades(tables):
    answer = screen(tables, QueryPlan(business_stage="MASS_PRODUCTION"))
    assert set(values(answer)) == {"prod_a", "prod_b"}
    assert answer.status == "DEGRADED" and answer.notes


def test_concept_without_graph_returns_nothing(tables):
    assert values(screen(tables, QueryPlan(concept_name="robots"))) == {}


def test_result_carries_display_fields(tables):
    row = screen(tables, QueryPlan(numeric=NumericFilter("NET_CF_OPERATING", "CONSECUTIVE_POSITIVE"))).results.first()
    assert row.security_code == "000004.SZ" and row.standard_product == "Gear"
    assert row.report_period == "2022-12-31..2024-12-31" and row.currency == "CNY"
    assert row.evidence_ids == ["e4"] and len(row.reasoning_path) == 4


def test_dual_listing_counts_a_year_once(spark, tables):
    extra = tables["links"].filter("company_id = 'ok'").selectExpr("company_id", "'s-second' AS security_id", "recorded_at")
    second = tables["observations"].filter("security_id = 's-ok'").selectExpr(
        "concat(id, 'b') AS id", "'s-second' AS security_id", *tables["observations"].columns[2:])
    both = {**tables, "links": tables["links"].union(extra), "observations": tables["observations"].union(second)}
    assert values(screen(both, QueryPlan(numeric=NumericFilter("NET_CF_OPERATING"))))["ok"] == 600.0


def test_later_restatement_wins(spark, tables):
    newer = tables["observations"].filter("id = 'ok2024'").selectExpr(
        "'ok2024r' AS id", "security_id", "metric_code", "period_end", "report_type", "999.0D AS value", "currency",
        "announced_at + interval 30 days AS announced_at", "update_flag", "recorded_at")
    changed = {**tables, "observations": tables["observations"].union(newer)}
    assert values(screen(changed, QueryPlan(numeric=NumericFilter("NET_CF_OPERATING"))))["ok"] == 1499.0


@pytest.mark.parametrize("bad", [
    dict(metric="PRICE"), dict(metric="ROE", operator="MIN_VALUE"), dict(metric="ROE", fiscal_years=0),
    dict(metric="ROE", period_rule="LAST_5_FY"), dict(metric="ROE", operator="MAX_VALUE", threshold=1.0, period_rule="CONSECUTIVE_3_FY_POSITIVE"),
])
def test_bad_plans_are_refused(bad):
    with pytest.raises(ValueError):
        NumericFilter(**bad)


def test_plan_limits():
    for bad in (dict(max_results=101), dict(max_hops=5), dict(intent="EXPLAIN_RELATION"), dict(business_stage="DROP")):
        with pytest.raises(ValueError):
            QueryPlan(**bad)
