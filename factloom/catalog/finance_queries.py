"""F rows over the order history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.functions.clean import LONG_TS_CODE
from factloom.operators import finance
from factloom.operators.standardize import business_segments, products_from_segments
from factloom.sources.bindings import Frames

METRIC = "NET_CF_OPERATING"


def _window(f: Frames, n: int, **times) -> DataFrame:
    series = finance.company_fy_series(
        finance.current_observations(f.observations()), f.links(), METRIC, **times
    )
    return finance.last_n_years(finance.dedup_listings(series), n)


@query("f01_current_version", """
    SELECT security_id, metric_code, period_end, id, report_type, CAST(value AS DOUBLE) AS value, announced_at FROM fy_current""")
def f01(f: Frames) -> DataFrame:
    return finance.current_observations(f.observations()).select(
        "security_id", "metric_code", "period_end", "id", "report_type",
        F.col("value").cast("double").alias("value"), "announced_at",
    )


@query("f02_security_observations", """
    SELECT id, period_end, CAST(value AS DOUBLE) AS value FROM fy_current
    WHERE security_id = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 7)""")
def f02(f: Frames) -> DataFrame:
    wanted = f.table("customer").filter("c_nationkey = 7").agg(F.max("c_custkey")).scalar()
    return finance.security_observations(f.observations(), wanted, METRIC).select(
        "id", "period_end", F.col("value").cast("double").alias("value")
    )


@query("f03_company_fy_series", """
    SELECT l.company_id, c.security_id, c.period_end, CAST(c.value AS DOUBLE) AS value
    FROM fy_current c JOIN links l USING (security_id)
    WHERE c.period_end <= DATE '1999-06-30' AND c.announced_at <= TIMESTAMP '1999-03-01 00:00:00'""")
def f03(f: Frames) -> DataFrame:
    return finance.company_fy_series(
        finance.current_observations(f.observations()), f.links(), METRIC,
        dt.date(1999, 6, 30), dt.datetime(1999, 3, 1),
    ).select("company_id", "security_id", "period_end", F.col("value").cast("double").alias("value"))


@query("f03_point_in_time", """
    SELECT l.company_id, c.security_id, c.period_end, CAST(c.value AS DOUBLE) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY security_id, period_end ORDER BY
            CASE WHEN report_type IN ('1','4') THEN 1 WHEN report_type IN ('2','5','6') THEN 2 ELSE 3 END,
            announced_at DESC, update_flag DESC, recorded_at DESC, id DESC) AS rn
        FROM obs WHERE announced_at <= TIMESTAMP '1999-03-01 00:00:00') c
    JOIN links l USING (security_id) WHERE rn = 1""")
def f03p(f: Frames) -> DataFrame:
    return finance.point_in_time_series(
        f.observations(), f.links(), METRIC, None, dt.datetime(1999, 3, 1)
    ).select("company_id", "security_id", "period_end", F.col("value").cast("double").alias("value"))


@query("f04_dedup_listings", """
    SELECT company_id, period_end, security_id, CAST(value AS DOUBLE) AS value FROM fy_series""")
def f04(f: Frames) -> DataFrame:
    series = finance.company_fy_series(finance.current_observations(f.observations()), f.links(), METRIC)
    return finance.dedup_listings(series).select(
        "company_id", "period_end", "security_id", F.col("value").cast("double").alias("value")
    )


@query("f05_last_n_years", """
    SELECT company_id, period_end, fy_rank, available FROM fy_ranked WHERE fy_rank <= 5""")
def f05(f: Frames) -> DataFrame:
    return _window(f, 5).select("company_id", "period_end", "fy_rank", "available")


@query("f06_sufficiency", """
    SELECT company_id, count(*) AS years, max(available) AS available, count(*) = 7 AS sufficient,
           CASE WHEN count(*) <> 7 THEN 'insufficient_complete_fiscal_years' END AS reason
    FROM fy_ranked WHERE fy_rank <= 7 GROUP BY 1""")
def f06(f: Frames) -> DataFrame:
    return finance.sufficiency(_window(f, 7), 7)


def _judged(n: int, value: str, passed: str) -> str:
    return f"""
    SELECT company_id, count(*) AS years, max(available) AS available, count(*) = {n} AS sufficient,
           CASE WHEN count(*) = {n} THEN CAST({value} AS DOUBLE) END AS value,
           CASE WHEN count(*) = {n} THEN {passed} ELSE false END AS passed,
           CASE WHEN count(*) <> {n} THEN 'insufficient_complete_fiscal_years' END AS reason
    FROM fy_ranked WHERE fy_rank <= {n} GROUP BY 1"""


@query("f07_total_positive", _judged(7, "sum(value)", "sum(value) > 150000"))
def f07(f: Frames) -> DataFrame:
    return finance.total_positive(_window(f, 7), 7, 150000)


@query("f08_consecutive_positive", _judged(3, "min(value)", "min(value) > 0"))
def f08(f: Frames) -> DataFrame:
    return finance.consecutive_positive(_window(f, 3), 3)


@query("f09_min_value", _judged(1, "max_by(value, period_end)", "max_by(value, period_end) >= 100000"))
def f09a(f: Frames) -> DataFrame:
    return finance.latest_bound(_window(f, 1), 1, "MIN_VALUE", 100000)


@query("f09_max_value", _judged(3, "max_by(value, period_end)", "max_by(value, period_end) <= -50000"))
def f09b(f: Frames) -> DataFrame:
    return finance.latest_bound(_window(f, 3), 3, "MAX_VALUE", -50000)


@query("f10_fy_detail", """
    SELECT company_id,
           CASE WHEN min(period_end) = max(period_end) THEN CAST(max(period_end) AS VARCHAR)
                ELSE concat(min(period_end), '..', max(period_end)) END AS report_period,
           max_by(currency, period_end) FILTER (currency IS NOT NULL) AS currency,
           string_agg(CAST(period_end AS VARCHAR), ',' ORDER BY period_end DESC) AS periods,
           CAST(sum(value) AS DOUBLE) AS total
    FROM fy_ranked WHERE fy_rank <= 3 GROUP BY 1""")
def f10(f: Frames) -> DataFrame:
    detail = finance.fy_detail(_window(f, 3))
    periods = F.transform("financial_detail", lambda e: e["period_end"].cast("string"))
    total = F.aggregate(
        F.transform("financial_detail", lambda e: e["value"].cast("decimal(18,2)")),
        F.lit(0).cast("decimal(20,2)"), lambda a, x: (a + x).cast("decimal(20,2)"),
    )
    return detail.select(
        "company_id", "report_period", "currency", F.array_join(periods, ",").alias("periods"),
        total.cast("double").alias("total"),
    )


@query("f11_recent_three_fy", """
    SELECT security_id, fy_rank, period_end, CAST(value AS DOUBLE) AS value, currency, report_type, announced_at, update_flag
    FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) AS fy_rank FROM fy_current)
    WHERE fy_rank <= 3""")
def f11(f: Frames) -> DataFrame:
    return finance.recent_three_fy(f.observations()).withColumn("value", F.col("value").cast("double"))


@query("f12_cagr", """
    SELECT company_id, years, round(cagr, 9) AS cagr FROM (
        SELECT company_id, count(*) AS years,
               CASE WHEN count(*) = 3 AND min_by(value, period_end) > 0 AND max_by(value, period_end) > 0
                    THEN power(CAST(max_by(value, period_end) AS DOUBLE) / CAST(min_by(value, period_end) AS DOUBLE), 0.5) - 1 END AS cagr
        FROM fy_ranked WHERE fy_rank <= 3 GROUP BY 1)""")
def f12(f: Frames) -> DataFrame:
    return finance.cagr(_window(f, 3), 3).withColumn("cagr", F.round("cagr", 9))


@query("f12_latest_period", """
    SELECT security_id, max(period_end) AS period_end, CAST(max_by(value, period_end) AS DOUBLE) AS value
    FROM fy_current GROUP BY 1""")
def f12b(f: Frames) -> DataFrame:
    return finance.latest_period(finance.current_observations(f.observations())).select(
        "security_id", "period_end", F.col("value").cast("double").alias("value")
    )


@query("f13_numeric_predicates", """
    SELECT id, value > 0 AS gt, value >= 0 AS gte, value < -100000 AS lt, value <= -100000 AS lte,
           value = 1000 AS eq, value BETWEEN -1000 AND 1000 AS between_ FROM obs""")
def f13(f: Frames) -> DataFrame:
    value, op = F.col("value"), finance.numeric_predicate
    return f.observations().select(
        "id", op(value, "gt", 0).alias("gt"), op(value, "gte", 0).alias("gte"),
        op(value, "lt", -100000).alias("lt"), op(value, "lte", -100000).alias("lte"),
        op(value, "eq", 1000).alias("eq"), op(value, "between", (-1000, 1000)).alias("between_"),
    )


@query("f14_revenue_evidence", """
    SELECT company_id AS subject_id, substr(sha256(raw_segment_name), 1, 10) AS object_id, period_end AS report_period,
           CAST(revenue AS DOUBLE) AS revenue
    FROM segment WHERE segment_type = 'PRODUCT' AND revenue > 0""")
def f14(f: Frames) -> DataFrame:
    segments, _, _ = business_segments(f.raw_segments(), f.securities(), f.links(), code_form=LONG_TS_CODE)
    _, mapped = products_from_segments(segments)
    return finance.revenue_evidence(mapped).select(
        "subject_id", "object_id", "report_period", F.col("revenue").cast("double").alias("revenue")
    )


