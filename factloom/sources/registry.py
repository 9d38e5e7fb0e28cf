"""Dataset registry: key, required and expected fields per vendor dataset (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dataset:
    name: str
    target: str
    required: tuple[str, ...]
    expected: tuple[str, ...] = ()
    paginated: bool = False
    page_size: int = 1000


_STATEMENT_KEYS = (
    "ts_code", "end_date", "ann_date", "f_ann_date", "report_type", "comp_type", "end_type",
    "update_flag",
)
DATASETS = {
    d.name: d
    for d in [
        Dataset("stock_basic", "master.security", ("ts_code", "symbol", "name"),
                ("exchange", "list_status"), True),
        Dataset("stock_company", "master.company", ("ts_code",), ("fullname",)),
        Dataset("namechange", "master.security_name_history", ("ts_code", "name")),
        Dataset("index_classify", "master.industry", ("index_code", "industry_name", "level")),
        Dataset("index_member_all", "master.company_industry_membership", ("ts_code",)),
        Dataset("ths_index", "master.concept", ("ts_code", "name")),
        Dataset("ths_member", "master.company_concept_membership", ("ts_code",)),
        Dataset("dc_index", "master.concept", ("ts_code", "name")),
        Dataset("dc_member", "master.company_concept_membership", ("con_code",)),
        Dataset("fina_mainbz_vip", "finance.business_segment_observation",
                ("ts_code", "end_date", "bz_item", "bz_code"), (), True),
        Dataset("income_vip", "finance.financial_observation", _STATEMENT_KEYS, (), True),
        Dataset("balancesheet_vip", "finance.financial_observation", _STATEMENT_KEYS, (), True),
        Dataset("cashflow_vip", "finance.financial_observation", _STATEMENT_KEYS, (), True),
        Dataset("fina_indicator_vip", "finance.financial_observation",
                ("ts_code", "end_date", "ann_date"), (), True),
        Dataset("top10_holders", "fact.holding_observation",
                ("ts_code", "end_date", "holder_name")),
    ]
}
