"""Conflict detection.

A finding is one row per conflicting group; ``finding_claims`` lists every
claim behind it, one row each, so that no group is gathered into one value.
Nothing is resolved automatically.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.scaling import running_max, split_running_sum

LIVE = ["ACCEPTED", "NEEDS_REVIEW"]
OPEN_START = "0001-01-01 00:00:00"
OPEN_END = "9999-12-31 00:00:00"


def _start(col: str = "valid_from") -> Column:
    return F.coalesce(F.col(col), F.lit(OPEN_START).cast("timestamp_ntz"))


def _end(col: str = "valid_to") -> Column:
    return F.coalesce(F.col(col), F.lit(OPEN_END).cast("timestamp_ntz"))


def _object() -> Column:
    return F.coalesce(F.col("object_id").cast("string"), F.col("object_value"), F.lit(""))


def _finding(df: DataFrame, kind: str, key: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        "subject_id",
        F.col(key).cast("string").alias("group_key"),
        "claims",
        F.col("variants").cast("bigint").alias("variants"),
    )


def value_conflicts(claims: DataFrame) -> DataFrame:
    """K1: several objects for one (subject, predicate)."""
    groups = claims.groupBy("subject_id", "predicate_code").agg(
        F.count(F.lit(1)).alias("claims"), F.count_distinct(_object()).alias("variants")
    )
    return _finding(groups.filter("variants > 1"), "VALUE", "predicate_code")


def type_conflicts(claims: DataFrame) -> DataFrame:
    """K2: several object types for one (subject, predicate)."""
    kind = F.when(F.col("object_id").isNotNull(), F.coalesce("object_type", F.lit("")))
    groups = claims.groupBy("subject_id", "predicate_code").agg(
        F.count(F.lit(1)).alias("claims"), F.count_distinct(kind).alias("variants")
    )
    return _finding(groups.filter("variants > 1"), "TYPE", "predicate_code")


def relation_conflicts(claims: DataFrame) -> DataFrame:
    """K3: several predicates for one (subject, object)."""
    groups = claims.filter(F.col("object_id").isNotNull()).groupBy("subject_id", "object_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_distinct("predicate_code").alias("variants")
    )
    return _finding(groups.filter("variants > 1"), "RELATION", "object_id")


def logical_conflicts(claims: DataFrame) -> DataFrame:
    """K4: a subject denies and also affirms with a stage."""
    denial = F.col("predicate_code") == "DENIES_INVOLVEMENT"
    affirms = ~denial & F.col("business_stage").isNotNull()
    groups = (
        claims.groupBy("subject_id")
        .agg(F.count_if(denial).alias("denials"), F.count_if(affirms).alias("affirmations"))
        .filter("denials > 0 and affirmations > 0")
        .select(
            "subject_id",
            F.lit("DENIES_INVOLVEMENT").alias("group_key"),
            (F.col("denials") + F.col("affirmations")).alias("claims"),
            F.lit(2).alias("variants"),
        )
    )
    return _finding(groups, "LOGICAL", "group_key")


def is_production() -> Column:
    return F.coalesce(F.col("business_stage") == "MASS_PRODUCTION", F.lit(False))


def is_denial() -> Column:
    """A denial in either column counts, as extracted denials carry stage UNKNOWN."""
    return F.coalesce(F.col("business_stage") == "COMPANY_DENIAL", F.lit(False)) | F.coalesce(
        F.col("evidence_state") == "COMPANY_DENIAL", F.lit(False)
    )


def temporal_conflicts(
    claims: DataFrame, keys: tuple[str, ...] = ("subject_id", "predicate_code")
) -> DataFrame:
    """K5: production and denial in one group whose validity intervals overlap somewhere.

    Sorting runs per group and month of start, so a hot group is spread; months
    of a group are then compared by their earliest start and the latest end
    before them. Exact while every interval ends after it starts.
    """
    live = (
        claims.filter(F.col("claim_status").isin(LIVE))
        .select(
            *keys, is_production().alias("_made"), is_denial().alias("_denied"),
            _start().alias("_from"), _end().alias("_to"),
        )
        .filter(F.col("_made") | F.col("_denied"))
        .withColumn("_month", F.date_trunc("month", "_from"))
    )
    inside = Window.partitionBy(*keys, "_month").orderBy("_from", "_to")
    reach = F.max("_to").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    months = (
        live.withColumn("_hit", F.coalesce(F.col("_from") < reach, F.lit(False)))
        .groupBy(*keys, "_month")
        .agg(
            F.bool_or("_hit").alias("_hit"),
            F.min("_from").alias("_first"),
            F.max("_to").alias("_last"),
            F.count(F.lit(1)).alias("n"),
            F.bool_or("_made").alias("_made"),
            F.bool_or("_denied").alias("_denied"),
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    across = F.coalesce(F.col("_first") < F.max("_last").over(earlier), F.lit(False))
    groups = (
        months.withColumn("_hit", F.col("_hit") | across)
        .groupBy(*keys)
        .agg(
            F.bool_or("_hit").alias("_hit"), F.bool_or("_made").alias("_made"),
            F.bool_or("_denied").alias("_denied"), F.sum("n").alias("claims"),
        )
        .filter(F.col("_hit") & F.col("_made") & F.col("_denied"))
        .withColumn("variants", F.lit(2))
    )
    return _finding(groups, "TEMPORAL_OVERLAP", keys[1])


def all_conflicts(claims: DataFrame) -> DataFrame:
    """K1-K5 as one list of findings."""
    parts = [
        value_conflicts(claims), type_conflicts(claims), relation_conflicts(claims),
        logical_conflicts(claims), temporal_conflicts(claims),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def finding_claims(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """Every claim behind a finding, one row per pair of kind and claim."""
    denial = F.col("predicate_code") == "DENIES_INVOLVEMENT"
    affirms = ~denial & F.col("business_stage").isNotNull()
    temporal = F.col("claim_status").isin(LIVE) & (is_production() | is_denial())
    predicate, target = F.col("predicate_code"), F.col("object_id").cast("string")

    def entry(kind: Column, key: Column) -> Column:
        return F.struct(kind.alias("kind"), key.alias("group_key"))

    keyed = claims.select(
        "claim_id", "subject_id",
        F.inline(
            F.filter(
                F.array(
                    entry(F.lit("VALUE"), predicate),
                    entry(F.lit("TYPE"), predicate),
                    entry(F.lit("RELATION"), target),
                    entry(F.when(denial | affirms, F.lit("LOGICAL")), F.lit("DENIES_INVOLVEMENT")),
                    entry(F.when(temporal, F.lit("TEMPORAL_OVERLAP")), predicate),
                ),
                lambda e: e["kind"].isNotNull() & e["group_key"].isNotNull(),
            )
        ),
    )
    return keyed.join(findings.select("kind", "subject_id", "group_key"), ["kind", "subject_id", "group_key"])


def incoming_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """K6: CRITICAL review task per incoming claim whose subject has a finding.

    Siblings are all live claims of the subject, without a cap; the incoming
    claim takes part as live, with its resolved subject.
    """
    cols = [
        "claim_id", "subject_id", "predicate_code", "object_id", "object_type", "object_value",
        "business_stage", "evidence_state", "valid_from", "valid_to", "claim_status",
    ]
    fresh = incoming.withColumn("claim_status", F.lit("NEEDS_REVIEW")).select(*cols)
    subjects = incoming.select("subject_id").distinct()
    siblings = (
        existing.filter(F.col("claim_status").isin(LIVE))
        .select(*cols)
        .join(subjects, "subject_id", "left_semi")
        .select(*cols)
    )
    kinds = (
        all_conflicts(siblings.unionByName(fresh))
        .groupBy("subject_id")
        .agg(F.array_sort(F.collect_set("kind")).alias("reason_codes"))
    )
    return incoming.select("claim_id", "subject_id").join(kinds, "subject_id").select(
        "claim_id", "subject_id",
        F.lit("CONFLICT_REVIEW").alias("task_type"),
        F.lit("CRITICAL").alias("priority"),
        "reason_codes",
    )


def overlap_counts(df: DataFrame, keys: list[str], row_id: str, side: str) -> DataFrame:
    """Rows of the other side whose interval overlaps, per row, without building pairs.

    ``df``: keys, ``row_id``, boolean ``side``, ``start``, ``end`` (not NULL,
    ``end > start``). Overlapping = others that start before my end, less others
    that end by my start; both are running counts over time, summed per month so
    that a hot key is spread.
    """
    before_end, at_start, at_end, after_start = 0, 1, 2, 3

    def point(at: str, rank: int) -> Column:
        return F.struct(F.col(at).alias("_t"), F.lit(rank).alias("_ord"))

    four = F.array(
        point("end", before_end), point("start", at_start), point("end", at_end),
        point("start", after_start),
    )
    points = df.select(*keys, row_id, side, F.inline(four))
    is_start, is_end = F.col("_ord") == at_start, F.col("_ord") == at_end
    mine = F.col(side)
    counted = split_running_sum(
        points, keys, F.date_trunc("month", "_t"), ["_t", "_ord"],
        {
            "s1": (is_start & mine).cast("bigint"), "s0": (is_start & ~mine).cast("bigint"),
            "e1": (is_end & mine).cast("bigint"), "e0": (is_end & ~mine).cast("bigint"),
        },
    )
    starts = F.when(mine, F.col("s0")).otherwise(F.col("s1"))
    ends = F.when(mine, F.col("e0")).otherwise(F.col("e1"))
    change = F.when(F.col("_ord") == before_end, starts).when(F.col("_ord") == after_start, -ends)
    return (
        counted.filter(F.col("_ord").isin(before_end, after_start))
        .groupBy(*keys, row_id, side)
        .agg(F.sum(change).alias("overlaps"))
    )


def denial_overlap(claims: DataFrame) -> DataFrame:
    """K7 (rule R007): production or revenue against denial on one subject and object.

    One row per claim in conflict, with the number of opposing claims whose
    validity overlaps.
    """
    denies = F.col("evidence_state") == "COMPANY_DENIAL"
    affirms = (F.col("business_stage") == "MASS_PRODUCTION") | (
        F.col("evidence_state") == "REVENUE_DISCLOSED"
    )
    sides = claims.filter(
        F.col("claim_status").isin(LIVE) & F.col("object_id").isNotNull() & (denies | affirms)
    ).select(
        "subject_id", "object_id", "claim_id", denies.alias("denial"),
        _start().alias("start"), _end().alias("end"),
    ).filter(F.col("end") > F.col("start"))
    return (
        overlap_counts(sides, ["subject_id", "object_id"], "claim_id", "denial")
        .filter("overlaps > 0")
        .withColumn("severity", F.lit("CRITICAL"))
    )


def conflict_warnings(claims: DataFrame) -> DataFrame:
    """K8: contradicted or superseded claims per company."""
    return (
        claims.filter(F.col("claim_status").isin("CONTRADICTED", "SUPERSEDED"))
        .groupBy(F.col("subject_id").alias("company_id"))
        .agg(F.count(F.lit(1)).alias("conflicted"))
    )


def issuer_conflicts(links: DataFrame) -> DataFrame:
    """K9: securities linked to several companies at one time.

    ``links(security_id, company_id, valid_from, valid_to)``. Intervals of one
    company are merged first; after that any overlap within a security is one
    between two companies.
    """
    spans = links.select("security_id", "company_id", _start().alias("_from"), _end().alias("_to"))
    seen = running_max(spans, ["security_id", "company_id"], ["_from", "_to"], "_to", "_seen")
    fresh = F.coalesce(F.col("_from") > F.col("_seen"), F.lit(True)).cast("int")
    islands = split_running_sum(
        seen.withColumnRenamed("_block", "_part"), ["security_id", "company_id"], F.col("_part"), ["_idx"], {"_island": fresh}
    )
    merged = islands.groupBy("security_id", "company_id", "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    reach = running_max(merged, ["security_id"], ["_from", "_to", "company_id"], "_to", "_reach")
    return (
        reach.withColumn("_hit", F.coalesce(F.col("_from") < F.col("_reach"), F.lit(False)))
        .groupBy("security_id")
        .agg(F.bool_or("_hit").alias("_hit"), F.count_distinct("company_id").alias("issuers"))
        .filter("_hit")
        .drop("_hit")
    )


def numeric_conflicts(obs: DataFrame) -> DataFrame:
    """Several values for one metric and period across sources."""
    return (
        obs.filter(F.col("value").isNotNull())
        .groupBy("security_id", "metric_code", "period_end")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.count_distinct("value").alias("distinct_values"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        )
        .filter("distinct_values > 1")
    )
