"""Financial versions, fiscal-year windows and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.clean import is_complete_fy

INSUFFICIENT = "insufficient_complete_fiscal_years"
# Policy echoed with the chosen version
VERSION_POLICY = "scope consolidated > parent > unknown; latest announcement; latest update flag"


def scope_rank(report_type: Column) -> Column:
    """Consolidated before parent before anything else."""
    return (
        F.when(report_type.isin("1", "4"), 1).when(report_type.isin("2", "5", "6"), 2).otherwise(3)
    )


def current_observations(obs: DataFrame) -> DataFrame:
    """one version per (security, metric, period).

    Spark limits each map task to its best row per key before the shuffle, so a
    hot security does not arrive whole in one task.
    """
    rank = Window.partitionBy("security_id", "metric_code", "period_end").orderBy(
        scope_rank(F.col("report_type")),
        F.col("announced_at").desc_nulls_last(),
        F.col("update_flag").desc_nulls_last(),
        F.col("recorded_at").desc(),
        F.col("id").desc(),
    )
    return obs.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def security_observations(obs: DataFrame, security_id, metric: str | None = None) -> DataFrame:
    """the filter goes below the ranking, so only one security is read."""
    mine = obs.filter(F.col("security_id") == security_id)
    if metric:
        mine = mine.filter(F.col("metric_code") == metric)
    return current_observations(mine).withColumn("version_policy", F.lit(VERSION_POLICY))


def company_fy_series(
    current: DataFrame,
    links: DataFrame,
    metric: str,
    as_of: dt.date | None = None,
    known_at: dt.datetime | None = None,
) -> DataFrame:
    """complete fiscal years per company; both time axes are separate filters."""
    rows = current.filter(
        (F.col("metric_code") == metric) & is_complete_fy(F.col("period_end"), F.col("value"))
    )
    if as_of is not None:
        rows = rows.filter(F.col("period_end") <= F.lit(as_of))
    if known_at is not None:
        rows = rows.filter(
            F.col("announced_at").isNull()
            | (F.col("announced_at") <= F.lit(known_at).cast("timestamp_ntz"))
        )
    pairs = links.select("company_id", "security_id").distinct()
    return rows.join(pairs, "security_id")


def point_in_time_series(
    obs: DataFrame,
    links: DataFrame,
    metric: str,
    as_of: dt.date | None,
    known_at: dt.datetime,
) -> DataFrame:
    """F3 with ``known_at`` applied before versions are chosen (option ``pit``)."""
    known = obs.filter(
        F.col("announced_at").isNull()
        | (F.col("announced_at") <= F.lit(known_at).cast("timestamp_ntz"))
    )
    return company_fy_series(current_observations(known), links, metric, as_of)


def dedup_listings(series: DataFrame) -> DataFrame:
    """a company listed twice counts each year once, latest announcement first."""
    rank = Window.partitionBy("company_id", "period_end").orderBy(
        F.col("announced_at").desc_nulls_last(), F.col("security_id"), F.col("id")
    )
    return series.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def last_n_years(series: DataFrame, n: int) -> DataFrame:
    """the newest N years per company, with the number of years available."""
    company = Window.partitionBy("company_id")
    rank = company.orderBy(F.col("period_end").desc())
    return (
        series.withColumn("available", F.count(F.lit(1)).over(company))
        .withColumn("fy_rank", F.row_number().over(rank))
        .filter(F.col("fy_rank") <= n)
    )


def sufficiency(window: DataFrame, n: int) -> DataFrame:
    """too few years is *insufficient*, not a failed test and not 0."""
    return (
        window.groupBy("company_id")
        .agg(F.count(F.lit(1)).alias("years"), F.max("available").alias("available"))
        .withColumn("sufficient", F.col("years") == n)
        .withColumn("reason", F.when(~F.col("sufficient"), INSUFFICIENT))
    )


def _judge(window: DataFrame, n: int, value: Column, passed: Column) -> DataFrame:
    enough = F.col("years") == n
    return (
        window.groupBy("company_id")
        .agg(
            F.count(F.lit(1)).alias("years"),
            F.max("available").alias("available"),
            value.alias("_value"),
        )
        .select(
            "company_id", "years", "available",
            enough.alias("sufficient"),
            F.when(enough, F.col("_value").cast("double")).alias("value"),
            F.when(enough, passed).otherwise(F.lit(False)).alias("passed"),
            F.when(~enough, F.lit(INSUFFICIENT)).alias("reason"),
        )
    )


def total_positive(window: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """the sum over the window is above the threshold."""
    return _judge(window, n, F.sum("value"), F.col("_value") > threshold)


def consecutive_positive(window: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """F8: every year is above the threshold; the weakest year is the value."""
    return _judge(window, n, F.min("value"), F.col("_value") > threshold)


def latest_bound(window: DataFrame, n: int, op: str, threshold: float) -> DataFrame:
    """newest year at least (MIN_VALUE) or at most (MAX_VALUE) the threshold."""
    value = F.max_by("value", "period_end")
    passed = F.col("_value") >= threshold if op == "MIN_VALUE" else F.col("_value") <= threshold
    return _judge(window, n, value, passed)


def evaluate(window: DataFrame, op: str, n: int, threshold: float | None) -> DataFrame:
    """F6-F9 by operator name."""
    if op == "TOTAL_POSITIVE":
        return total_positive(window, n, threshold or 0.0)
    if op == "CONSECUTIVE_POSITIVE":
        return consecutive_positive(window, n, threshold or 0.0)
    if op in ("MIN_VALUE", "MAX_VALUE"):
        if threshold is None:
            raise ValueError(f"operator {op} requires threshold")
        return latest_bound(window, n, op, threshold)
    raise ValueError(f"operator {op!r} not supported")


def fy_detail(window: DataFrame) -> DataFrame:
    """years newest first, report-period label, first known currency."""
    entry = F.struct("period_end", F.col("value").cast("double").alias("value"), "currency")
    detail = F.sort_array(F.collect_list(entry), asc=False)
    newest, oldest = F.max("period_end"), F.min("period_end")
    return window.groupBy("company_id").agg(
        detail.alias("financial_detail"),
        F.when(newest == oldest, newest.cast("string"))
        .otherwise(F.concat_ws("..", oldest.cast("string"), newest.cast("string")))
        .alias("report_period"),
    ).withColumn(
        "currency",
        F.get(F.filter("financial_detail", lambda e: e["currency"].isNotNull()), F.lit(0))["currency"],
    )


def recent_three_fy(obs: DataFrame, metric: str = "NET_CF_OPERATING") -> DataFrame:
    """newest three complete years per security, with the version columns chosen."""
    rows = current_observations(obs.filter(F.col("metric_code") == metric)).filter(
        is_complete_fy(F.col("period_end"), F.col("value"))
    )
    rank = Window.partitionBy("security_id").orderBy(F.col("period_end").desc())
    return (
        rows.withColumn("fy_rank", F.row_number().over(rank))
        .filter("fy_rank <= 3")
        .select(
            "security_id", "fy_rank", "period_end", "value", "currency", "report_type",
            "announced_at", "update_flag",
        )
    )


def cagr(window: DataFrame, n: int = 3) -> DataFrame:
    """yearly growth from first to last; NULL when the first value is not positive."""
    first, last = F.min_by("value", "period_end"), F.max_by("value", "period_end")
    ratio = F.col("_last").cast("double") / F.col("_first").cast("double")
    return (
        window.groupBy("company_id")
        .agg(F.count(F.lit(1)).alias("years"), first.alias("_first"), last.alias("_last"))
        .select(
            "company_id",
            "years",
            F.when(
                (F.col("years") == n) & (F.col("_first") > 0) & (F.col("_last") > 0),
                F.pow(ratio, F.lit(1.0 / (n - 1))) - 1,
            ).alias("cagr"),
        )
    )


def latest_period(current: DataFrame) -> DataFrame:
    """newest period per security and metric, fiscal year or not."""
    rank = Window.partitionBy("security_id", "metric_code").orderBy(F.col("period_end").desc())
    return (
        current.filter(F.col("value").isNotNull())
        .withColumn("_rank", F.row_number().over(rank))
        .filter("_rank = 1")
        .drop("_rank")
    )


def numeric_predicate(col: Column, op: str, value) -> Column:
    """F13."""
    if op == "gt":
        return col > value
    if op == "gte":
        return col >= value
    if op == "lt":
        return col < value
    if op == "lte":
        return col <= value
    if op == "eq":
        return col == value
    if op == "between":
        return col.between(*value)
    raise ValueError(f"operator {op!r} not supported")


def revenue_evidence(segments: DataFrame) -> DataFrame:
    """F14 (rule R005): disclosed revenue of a mapped product, not a production start."""
    return segments.filter(
        (F.col("mapping_status") == "ACCEPTED")
        & (F.col("revenue") > 0)
        & F.col("period_end").isNotNull()
    ).select(
        F.col("company_id").alias("subject_id"),
        F.lit("HAS_REVENUE_FROM").alias("predicate_code"),
        F.col("mapped_product_id").alias("object_id"),
        F.lit("UNKNOWN").alias("business_stage"),
        F.lit("REVENUE_DISCLOSED").alias("evidence_state"),
        F.col("period_end").alias("report_period"),
        F.col("period_end").alias("valid_from"),
        "revenue",
    )
