"""Raw rows to master and finance tables.

Raw frames carry ``source_record_id, payload (map<string,string>), retrieved_at``.
Each normalizer returns its rows plus a reject frame ``(reason,
source_record_id, ref)``; unresolved references are rejects, never guesses.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.clean import (
    clean_str, decimal_or_null, exchange_code, first_non_null, map_value, parse_date, read_fields,
    TS_CODE,
    valid_ts_code,
)
from factloom.functions.hashing import stable_id
from factloom.vocab import (
    EXCHANGE_BY_SUFFIX, LIST_STATUS, METRIC_FIELDS, SEGMENT_TYPES, SOURCE_PRIORITY,
)

# Placeholder key of a company whose registry code is unknown (fixed value)
PLACEHOLDER_PREFIX = "TUSHARE-UNVERIFIED-"


def field(name: str) -> Column:
    """Value of a payload key, NULL when the key is absent."""
    return F.try_element_at("payload", F.lit(name))


def _quoted(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))


def _ts_code_reason(bad: Column) -> Column:
    return F.when(bad, F.concat(F.lit("invalid ts_code: "), _quoted(field("ts_code"))))


def _date_reason(bad: Column, name: str) -> Column:
    return F.when(bad, F.concat(F.lit("unparseable date: "), _quoted(field(name))))


def _number_reason(bad: Column, name: str) -> Column:
    return F.when(bad, F.concat(F.lit("unparseable decimal: "), _quoted(field(name))))


def _missing(value: Column, reason: str) -> Column:
    return F.when(value.isNull(), F.lit(reason))


def _split(df: DataFrame, *reasons: Column, ref: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the rejects of the others (first reason wins).

    The reason is a generated column, so it is computed once in a projection; as
    a plain alias the filter would repeat every parse without sharing them.
    """
    reason = F.coalesce(*reasons, F.lit(None).cast("string"))
    judged = (
        df.withColumn("_r", reason).select("*", F.explode(F.array("_r")).alias("_reason")).drop("_r")
    )
    rejects = judged.filter(F.col("_reason").isNotNull()).select(
        F.col("_reason").alias("reason"),
        "source_record_id",
        (ref if ref is not None else field("ts_code")).cast("string").alias("ref"),
    )
    return judged.filter(F.col("_reason").isNull()).drop("_reason"), rejects


def _resolve(
    df: DataFrame, refs: DataFrame, on: str, reason: Column, ref: Column
) -> tuple[DataFrame, DataFrame]:
    """Join a reference that must exist; ``refs`` has one row per key."""
    probe = refs.withColumn("_hit", F.lit(True))
    joined = df.join(probe, on, "left")
    return (
        joined.filter(F.col("_hit")).drop("_hit"),
        joined.filter(F.col("_hit").isNull()).select(
            reason.alias("reason"), "source_record_id", ref.cast("string").alias("ref")
        ),
    )


# Order in which the reference applied the rows
ARRIVAL = ("retrieved_at", "source_record_id")


def _first(col: str) -> Column:
    return F.min_by(col, F.struct(*ARRIVAL)).alias(col)


def _last(col: str) -> Column:
    return F.max_by(col, F.struct(*ARRIVAL)).alias(col)


def raw_since(
    raw: DataFrame, dataset: str, watermark: tuple | None = None, limit: int | None = None
) -> DataFrame:
    """Rows after the stored ``(retrieved_at, id)`` position, in order."""
    rows = raw.filter(F.col("api_name") == dataset)
    if watermark is not None:
        at, record = F.lit(watermark[0]).cast("timestamp_ntz"), F.lit(watermark[1])
        rows = rows.filter(
            (F.col("retrieved_at") > at)
            | ((F.col("retrieved_at") == at) & (F.col("source_record_id") > record))
        )
    if limit is None:
        return rows
    return rows.orderBy(*ARRIVAL).limit(limit)


def next_watermark(rows: DataFrame) -> DataFrame:
    """Position after a batch, taken once as the batch maximum."""
    top = F.max(F.struct(*ARRIVAL))
    return rows.agg(top.alias("w")).select("w.*")


def _parse_security(raw: DataFrame, code_form: str) -> tuple[DataFrame, DataFrame]:
    code, bad = valid_ts_code(field("ts_code"), code_form)
    name = clean_str(field("name"))
    good, rejects = _split(raw, _ts_code_reason(bad), _missing(name, "missing name"))
    rows = good.select(
        "source_record_id",
        "retrieved_at",
        code.alias("ts_code"),
        F.coalesce(clean_str(field("symbol")), F.element_at(F.split(code, r"\."), 1)).alias("symbol"),
        name.alias("name"),
        exchange_code(field("exchange"), code, EXCHANGE_BY_SUFFIX).alias("exchange_code"),
        F.element_at(F.split(code, r"\."), -1).alias("exchange_name"),
        map_value(clean_str(field("list_status")), LIST_STATUS, F.lit("UNKNOWN")).alias("status"),
    )
    return rows, rejects


def exchanges(raw: DataFrame, code_form: str = TS_CODE) -> DataFrame:
    """Exchange per code, last name wins."""
    rows, _ = _parse_security(raw, code_form)
    return rows.groupBy(F.col("exchange_code").alias("code")).agg(
        F.max_by("exchange_name", F.struct(*ARRIVAL)).alias("name")
    )


def securities(
    raw: DataFrame, current: DataFrame | None = None, code_form: str = TS_CODE
) -> tuple[DataFrame, DataFrame]:
    """One row per code; only ``name`` follows later rows, the rest keeps its first value."""
    rows, rejects = _parse_security(raw, code_form)
    merged = rows.groupBy("ts_code").agg(
        _first("symbol"), _last("name"), _first("exchange_code"), _first("status"),
        _first("source_record_id"),
    )
    out = merged.select(
        stable_id("security", F.col("ts_code")).alias("security_id"), "*"
    )
    if current is None:
        return out, rejects
    old = current.alias("o").join(out.alias("n"), "ts_code", "full")
    keep = ["security_id", "symbol", "exchange_code", "status", "source_record_id"]
    return (
        old.select(
            "ts_code",
            F.coalesce("n.name", "o.name").alias("name"),
            *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keep],
        ),
        rejects,
    )


def latest_company_link(links: DataFrame) -> DataFrame:
    """Newest company per security."""
    return links.groupBy("security_id").agg(
        F.max_by("company_id", F.struct("recorded_at", "company_id")).alias("company_id")
    )


def _parse_company(raw: DataFrame, securities_df: DataFrame, code_form: str) -> tuple[DataFrame, DataFrame]:
    code, bad = valid_ts_code(field("ts_code"), code_form)
    name = first_non_null(field("name"), field("com_name"), field("fullname"))
    good, bad_rows = _split(raw, _ts_code_reason(bad), _missing(name, "missing company name"))
    good = good.withColumn("ts_code", code).withColumn("canonical_name", name)
    found, unresolved = _resolve(
        good, securities_df.select("ts_code", "security_id"), "ts_code",
        F.concat(F.lit("security "), "ts_code",
                 F.lit(" not standardized yet (process stock_basic first)")),
        F.col("ts_code"),
    )
    return found, bad_rows.unionByName(unresolved)


def companies(
    raw: DataFrame, securities_df: DataFrame, links: DataFrame | None = None, code_form: str = TS_CODE,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(companies, new_links, events, rejects)``.

    The security is the anchor: a linked company is reused, otherwise a
    placeholder key is made from the code. Companies never merge by name.
    """
    rows, rejects = _parse_company(raw, securities_df, code_form)
    if links is not None:
        known = latest_company_link(links).select(
            "security_id", F.col("company_id").alias("linked_id")
        )
        rows = rows.join(known, "security_id", "left")
    else:
        rows = rows.withColumn("linked_id", F.lit(None).cast("string"))
    uscc = F.concat(F.lit(PLACEHOLDER_PREFIX), "ts_code")
    rows = rows.withColumn("uscc", uscc).withColumn(
        "company_id", F.coalesce("linked_id", stable_id("company", uscc))
    )
    fresh = rows.filter(F.col("linked_id").isNull())
    created = fresh.groupBy("company_id", "uscc", "ts_code").agg(
        _first("canonical_name"), _first("source_record_id")
    )
    events = created.select(
        F.lit("MAPPED").alias("event_type"),
        F.lit("COMPANY").alias("entity_type"),
        F.col("ts_code").alias("entity_ref"),
        F.lit("uscc_placeholder").alias("detail"),
        "source_record_id",
    )
    new_links = rows.select(
        "company_id", "security_id", F.col("retrieved_at").alias("recorded_at")
    ).distinct()
    return created.drop("ts_code"), new_links, events, rejects


PROFILE_FIELDS = {
    "chairman": "chairman_name", "manager": "general_manager_name",
    "secretary": "board_secretary_name", "province": "province", "city": "city",
}


def company_profiles(
    raw: DataFrame, securities_df: DataFrame, links: DataFrame, code_form: str = TS_CODE
) -> tuple[DataFrame, DataFrame]:
    """Whole row of the newest record per company."""
    rows, _ = _parse_company(raw, securities_df, code_form)
    rows = rows.join(latest_company_link(links), "security_id")
    capital, bad_capital = decimal_or_null(field("reg_capital"))
    founded, bad_founded = parse_date(field("setup_date"))
    staff, bad_staff = decimal_or_null(field("employees"))
    prefix = F.lit("profile field rejected: ")
    good, rejects = _split(
        rows,
        F.concat(prefix, _number_reason(bad_capital, "reg_capital")),
        F.concat(prefix, _date_reason(bad_founded, "setup_date")),
        F.concat(prefix, _number_reason(bad_staff, "employees")),
        ref=F.col("ts_code"),
    )
    values = good.select(
        "company_id",
        *ARRIVAL,
        *[clean_str(field(src)).alias(dst) for src, dst in PROFILE_FIELDS.items()],
        capital.alias("registered_capital"),
        founded.alias("founded_date"),
        staff.alias("employees"),
        first_non_null(field("main_part_business"), field("main_business")).alias(
            "main_part_business"
        ),
    )
    kept = [c for c in values.columns if c not in ("company_id", "retrieved_at")]
    newest = F.max_by(F.struct(*kept), F.struct(*ARRIVAL))
    return values.groupBy("company_id").agg(newest.alias("s")).select("company_id", "s.*"), rejects


def name_history(
    raw: DataFrame, securities_df: DataFrame, code_form: str = TS_CODE
) -> tuple[DataFrame, DataFrame]:
    """First insert wins per (security, name, start_date)."""
    code, bad = valid_ts_code(field("ts_code"), code_form)
    name = clean_str(field("name"))
    start, bad_start = parse_date(field("start_date"))
    end, bad_end = parse_date(field("end_date"))
    ann, bad_ann = parse_date(field("ann_date"))
    good, rejects = _split(
        raw, _ts_code_reason(bad), _missing(name, "missing name"),
        _date_reason(bad_start, "start_date"),
        _missing(start, "namechange requires start_date"),
        _date_reason(bad_end, "end_date"), _date_reason(bad_ann, "ann_date"),
    )
    rows = good.withColumns(
        {"ts_code": code, "name": name, "start_date": start, "end_date": end, "ann_date": ann}
    )
    found, unresolved = _resolve(
        rows, securities_df.select("ts_code", "security_id"), "ts_code",
        F.concat(F.lit("security "), "ts_code", F.lit(" not standardized yet")), F.col("ts_code"),
    )
    out = found.groupBy("security_id", "name", "start_date").agg(
        _first("end_date"), _first("ann_date"), F.min("retrieved_at").alias("recorded_at")
    )
    return out, rejects.unionByName(unresolved)


def industries(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Industry tree; a parent that is not there stays NULL."""
    code = clean_str(field("index_code"))
    name = first_non_null(field("industry_name"), field("name"))
    good, rejects = _split(
        raw,
        F.when(code.isNull() | name.isNull(), F.lit("index_classify requires index_code and name")),
        ref=field("index_code"),
    )
    rows = good.select(
        *ARRIVAL,
        code.alias("external_code"),
        name.alias("name"),
        F.coalesce(clean_str(field("level")), F.lit("L1")).alias("level_code"),
        clean_str(field("parent_code")).alias("parent_code"),
    )
    merged = rows.groupBy("external_code").agg(
        _last("name"), _first("level_code"), _first("parent_code")
    ).withColumn("industry_id", stable_id("industry", F.lit("SW"), F.lit("SW2021"), F.col("external_code")))
    parents = merged.select(
        F.col("external_code").alias("parent_code"), F.col("industry_id").alias("parent_id")
    )
    return merged.join(parents, "parent_code", "left"), rejects


def _with_company(
    df: DataFrame, securities_df: DataFrame, links: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Company of a code through its newest link; without one the row is a reject."""
    anchored = securities_df.select("ts_code", "security_id").join(
        latest_company_link(links), "security_id"
    )
    return _resolve(
        df, anchored, "ts_code",
        F.concat(F.lit("no company anchored for "), "ts_code"), F.col("ts_code"),
    )


def industry_membership(
    raw: DataFrame, securities_df: DataFrame, links: DataFrame, industries_df: DataFrame,
    code_form: str = TS_CODE,
) -> tuple[DataFrame, DataFrame]:
    """N12."""
    code, bad = valid_ts_code(field("ts_code"), code_form)
    index_code = clean_str(field("index_code"))
    start, bad_start = parse_date(field("in_date"))
    end, bad_end = parse_date(field("out_date"))
    good, rejects = _split(
        raw, _ts_code_reason(bad), _missing(index_code, "missing index_code"),
        _date_reason(bad_start, "in_date"), _missing(start, "membership requires in_date"),
        _date_reason(bad_end, "out_date"),
    )
    rows = good.withColumns(
        {"ts_code": code, "external_code": index_code, "valid_from": start, "valid_to": end}
    )
    anchored, no_company = _with_company(rows, securities_df, links)
    found, no_industry = _resolve(
        anchored, industries_df.select("external_code", "industry_id"), "external_code",
        F.concat(F.lit("industry "), "external_code", F.lit(" not standardized yet")),
        F.col("external_code"),
    )
    out = found.groupBy("company_id", "industry_id", F.col("retrieved_at").alias("recorded_at")).agg(
        _first("valid_from"), _first("valid_to")
    )
    return out, rejects.unionByName(no_company).unionByName(no_industry)


def concepts(raw: DataFrame, platform: str) -> tuple[DataFrame, DataFrame]:
    """Concept per (platform, code), last name wins."""
    code = first_non_null(field("code"), field("ts_code"))
    name = clean_str(field("name"))
    good, rejects = _split(
        raw, F.when(code.isNull() | name.isNull(), F.lit("concept requires code and name")),
        ref=F.to_json("payload"),
    )
    rows = good.select(*ARRIVAL, code.alias("external_code"), name.alias("name"))
    out = rows.groupBy("external_code").agg(_last("name")).select(
        stable_id("concept", F.lit(platform), F.col("external_code")).alias("concept_id"),
        F.lit(platform).alias("source_platform"), "external_code", "name",
    )
    return out, rejects


def concept_membership(
    raw: DataFrame, platform: str, securities_df: DataFrame, links: DataFrame,
    concepts_df: DataFrame, code_form: str = TS_CODE,
) -> tuple[DataFrame, DataFrame]:
    """Platform membership per snapshot date; it never becomes a business fact."""
    code, bad = valid_ts_code(field("ts_code"), code_form)
    concept_code = first_non_null(field("code"), field("con_code"))
    in_date, bad_in = parse_date(field("in_date"))
    snapshot, bad_snapshot = parse_date(field("snapshot_date"))
    date = F.coalesce(in_date, snapshot)
    good, rejects = _split(
        raw, _ts_code_reason(bad), _date_reason(bad_in, "in_date"),
        _date_reason(in_date.isNull() & bad_snapshot, "snapshot_date"),
        F.when(concept_code.isNull() | date.isNull(),
               F.lit("concept membership requires code and snapshot date")),
    )
    rows = good.withColumns({"ts_code": code, "external_code": concept_code, "snapshot_date": date})
    anchored, no_company = _with_company(rows, securities_df, links)
    mine = concepts_df.filter(F.col("source_platform") == platform)
    found, no_concept = _resolve(
        anchored, mine.select("external_code", "concept_id"), "external_code",
        F.concat(F.lit(f"concept {platform}:"), "external_code", F.lit(" not standardized yet")),
        F.col("external_code"),
    )
    out = found.groupBy("company_id", "concept_id", "snapshot_date").agg(
        F.lit(True).alias("is_member"), F.min("retrieved_at").alias("recorded_at")
    )
    return out, rejects.unionByName(no_company).unionByName(no_concept)


def observation_defaults(df: DataFrame) -> DataFrame:
    """Announcement falls back to retrieval, scope to UNKNOWN; currency stays unknown."""
    announced, _ = parse_date(field("ann_date"))
    return df.withColumns(
        {
            "announced_at": F.coalesce(announced.cast("timestamp_ntz"), "retrieved_at"),
            "report_type": F.coalesce(clean_str(field("report_type")), F.lit("UNKNOWN")),
            "update_flag": clean_str(field("update_flag")),
            "currency": clean_str(field("curr_type")),
        }
    )


def to_observations(
    raw: DataFrame, securities_df: DataFrame, fields: list[str], code_form: str = TS_CODE
) -> tuple[DataFrame, DataFrame]:
    """One observation per metric field of a record.

    An absent field gives no row, a field without a value a NULL row. A record
    with an unreadable number is rejected as a whole.
    """
    code, bad = valid_ts_code(field("ts_code"), code_form)
    period, bad_period = parse_date(field("end_date"))
    _, bad_ann = parse_date(field("ann_date"))
    numbers = {f: decimal_or_null(field(f)) for f in fields}
    good, rejects = _split(
        raw, _ts_code_reason(bad), _date_reason(bad_period, "end_date"),
        _missing(period, "financial observation requires end_date"),
        _date_reason(bad_ann, "ann_date"),
        *[_number_reason(bad_number, f) for f, (_, bad_number) in numbers.items()],
    )
    rows = observation_defaults(good).withColumns({"ts_code": code, "period_end": period})
    found, unresolved = _resolve(
        rows, securities_df.select("ts_code", "security_id"), "ts_code",
        F.concat(F.lit("security "), "ts_code", F.lit(" not standardized yet")), F.col("ts_code"),
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(METRIC_FIELDS[f][0]).alias("metric_code"),
                numbers[f][0].alias("value"),
                F.map_contains_key("payload", f).alias("present"),
            )
            for f in fields
        ]
    )
    out = found.select("*", F.inline(F.filter(entries, lambda e: e["present"]))).select(
        "security_id", "metric_code", "period_end", "report_type", "value", "currency",
        "announced_at", "update_flag", "source_record_id", "retrieved_at",
    )
    return out, rejects.unionByName(unresolved)


OBSERVATION_KEY = [
    "security_id", "metric_code", "period_end", "report_type", "update_flag", "announced_at",
]


def merge_observations(incoming: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """New versions to append; all versions stay, NULL keys compare equal."""
    rest = [c for c in incoming.columns if c not in OBSERVATION_KEY]
    newest = F.min_by(F.struct(*rest), F.struct(*ARRIVAL))
    rows = incoming.groupBy(*OBSERVATION_KEY).agg(newest.alias("s")).select(*OBSERVATION_KEY, "s.*")
    if current is None:
        return rows
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in OBSERVATION_KEY]
    return rows.alias("i").join(current.select(*OBSERVATION_KEY).alias("c"), same, "left_anti")


def metric_catalog(spark: SparkSession) -> DataFrame:
    """The five registered metrics."""
    rows = [(v[0], v[1], v[4], v[2], v[3], k) for k, v in METRIC_FIELDS.items()]
    return spark.createDataFrame(
        rows,
        "metric_code string, name string, statement_type string, unit_type string, "
        "default_aggregation string, source_field string",
    )


SEGMENT_KEY = ["company_id", "period_end", "segment_type", "raw_segment_name"]


def business_segments(
    raw: DataFrame, securities_df: DataFrame, links: DataFrame, current: DataFrame | None = None,
    code_form: str = TS_CODE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(segments, corrections, rejects)``; a later record overwrites the same key."""
    money = {"bz_sales": "revenue", "bz_cost": "cost", "bz_profit": "profit"}
    read = read_fields(
        raw, field,
        {"ts_code": "code", "end_date": "date", "bz_item": "text", "bz_code": "text",
         **dict.fromkeys(money, "number"), "curr_type": "text"},
        code_form,
    )
    type_code = F.coalesce("_bz_code", F.lit("P"))
    segment_type = map_value(type_code, SEGMENT_TYPES)
    good, rejects = _split(
        read, _ts_code_reason(F.col("_ts_code_bad")), _date_reason(F.col("_end_date_bad"), "end_date"),
        _missing(F.col("_end_date"), "segment requires end_date"),
        _missing(F.col("_bz_item"), "segment requires bz_item"),
        F.when(segment_type.isNull(), F.concat(F.lit("unknown bz_code "), type_code)),
        *[_number_reason(F.col(f"_{f}_bad"), f) for f in money],
    )
    rows = good.select(
        *ARRIVAL, F.col("_ts_code").alias("ts_code"), F.col("_end_date").alias("period_end"),
        segment_type.alias("segment_type"), F.col("_bz_item").alias("raw_segment_name"),
        *[F.col(f"_{f}").alias(name) for f, name in money.items()], F.col("_curr_type").alias("currency"),
    )
    found, no_company = _with_company(rows, securities_df, links)
    value = ["ts_code", "revenue", "cost", "profit", "currency"]
    # One state a key: the last record, its arrival in front, carries the values along
    merged = (
        found.groupBy(*SEGMENT_KEY)
        .agg(F.max(F.struct(*ARRIVAL, *value)).alias("s"), F.count(F.lit(1)).alias("writes"))
        .select(*SEGMENT_KEY, *[f"s.{c}" for c in [*value, "source_record_id"]],
                F.col("s.retrieved_at").alias("recorded_at"), "writes")
    )
    if current is not None:
        known = current.select(*SEGMENT_KEY).withColumn("_known", F.lit(1))
        merged = merged.join(known, SEGMENT_KEY, "left")
    else:
        merged = merged.withColumn("_known", F.lit(None).cast("int"))
    overwrites = F.col("writes") - 1 + F.coalesce("_known", F.lit(0))
    corrections = merged.withColumn("overwrites", overwrites).filter("overwrites > 0").select(
        F.lit("CORRECTION").alias("event_type"),
        F.lit("BUSINESS_SEGMENT").alias("entity_type"),
        F.concat_ws(":", "ts_code", "period_end", "raw_segment_name").alias("entity_ref"),
        "overwrites",
        "source_record_id",
    )
    segments = merged.withColumn("mapping_status", F.lit("UNMAPPED")).drop("writes", "_known")
    return segments, corrections, rejects.unionByName(no_company)


HOLDING_KEY = ["security_id", "holder_name", "end_date", "hold_ratio"]


def holdings(
    raw: DataFrame, securities_df: DataFrame, current: DataFrame | None = None, code_form: str = TS_CODE
) -> tuple[DataFrame, DataFrame]:
    """HOLDS observations only, NULL-safe key, first insert wins."""
    read = read_fields(
        raw, field,
        {"ts_code": "code", "holder_name": "text", "end_date": "date", "hold_amount": "number",
         "hold_ratio": "number", "holder_type": "text"},
        code_form,
    )
    good, rejects = _split(
        read, _ts_code_reason(F.col("_ts_code_bad")), _missing(F.col("_holder_name"), "holding requires holder_name"),
        _date_reason(F.col("_end_date_bad"), "end_date"),
        _missing(F.col("_end_date"), "holding requires end_date"),
        *[_number_reason(F.col(f"_{f}_bad"), f) for f in ("hold_amount", "hold_ratio")],
    )
    rows = good.select(
        *ARRIVAL,
        *[F.col(f"_{f}").alias(f) for f in ("ts_code", "holder_name", "end_date", "hold_amount", "hold_ratio", "holder_type")],
    )
    found, unresolved = _resolve(
        rows, securities_df.select("ts_code", "security_id"), "ts_code",
        F.concat(F.lit("security "), "ts_code", F.lit(" not standardized yet")), F.col("ts_code"),
    )
    out = found.groupBy(*HOLDING_KEY).agg(
        _first("holder_type"), _first("hold_amount"), _first("source_record_id")
    ).withColumn("predicate_code", F.lit("HOLDS"))
    if current is not None:
        same = [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in HOLDING_KEY]
        out = out.alias("i").join(current.select(*HOLDING_KEY).alias("c"), same, "left_anti")
    return out, rejects.unionByName(unresolved)


def products_from_segments(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Product per distinct PRODUCT segment name; equal names map as ACCEPTED."""
    named = segments.filter(
        (F.col("segment_type") == "PRODUCT") & F.col("raw_segment_name").isNotNull()
    )
    product_id = F.substring(F.sha2("raw_segment_name", 256), 1, 10)
    products = named.select(
        product_id.alias("product_id"), F.col("raw_segment_name").alias("canonical_name")
    ).distinct()
    mapped = segments.withColumns(
        {
            "mapped_product_id": F.when(F.col("segment_type") == "PRODUCT", product_id),
            "mapping_status": F.when(
                (F.col("segment_type") == "PRODUCT") & F.col("raw_segment_name").isNotNull(),
                "ACCEPTED",
            ).otherwise(F.lit("UNMAPPED")),
        }
    )
    return products, mapped


def resolve_alias(terms: DataFrame, mappings: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Best accepted mapping per term, or the reason for a review.

    The two best confidences of a term are enough, so each term is aggregated
    to its top value, the number of rows at the top, and one product.
    """
    accepted = mappings.filter(F.col("review_status") == "ACCEPTED")
    top = accepted.groupBy("normalized_term").agg(F.max("confidence").alias("top_confidence"))
    best = (
        accepted.join(top, "normalized_term")
        .filter(F.col("confidence") == F.col("top_confidence"))
        .groupBy("normalized_term", "top_confidence")
        .agg(F.count(F.lit(1)).alias("at_top"), F.min("product_id").alias("product_id"))
    )
    normalized = F.lower(clean_str(F.col("raw_term")))
    status = (
        F.when(F.col("top_confidence").isNull(), "UNRESOLVED")
        .when((F.col("at_top") > 1) | (F.col("top_confidence") < threshold), "NEEDS_REVIEW")
        .otherwise("RESOLVED")
    )
    return (
        terms.withColumn("normalized_term", normalized)
        .join(best, "normalized_term", "left")
        .withColumn("resolution", status)
        .withColumn("mapped_product_id", F.when(F.col("resolution") == "RESOLVED", F.col("product_id")))
        .drop("product_id", "at_top")
    )


def resolve_subject(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Only an anchored security names a company; name hints are not trusted."""
    status = (
        F.when(F.col("security_id").isNull(), "UNRESOLVED")
        .when(F.col("company_id").isNull(), "NEEDS_REVIEW")
        .otherwise("RESOLVED")
    )
    return candidates.join(latest_company_link(links), "security_id", "left").withColumn(
        "resolution", status
    )


def stamp_run(
    df: DataFrame, version: str, run_id: str, replay: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows stamped with the mapping version, and the VERSION_APPLIED event."""
    spark = df.sparkSession
    event = spark.createDataFrame(
        [(run_id, "VERSION_APPLIED", version, replay)],
        "run_id string, event_type string, mapping_version string, replay boolean",
    )
    return df.withColumns({"mapping_version": F.lit(version), "run_id": F.lit(run_id)}), event


def normalization_summary(outcomes: DataFrame) -> DataFrame:
    """``outcomes(run_id, written, rejected)`` per record to counters per run."""
    return (
        outcomes.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("rows_read"),
            F.sum("written").alias("rows_written"),
            F.sum("rejected").alias("rows_rejected"),
        )
        .withColumn(
            "status",
            F.when(F.col("rows_rejected") > 0, "PARTIAL_SUCCESS").otherwise("SUCCEEDED"),
        )
    )


def reject_log(rejects: Mapping[str, DataFrame]) -> DataFrame:
    """Rejects of several datasets as one log."""
    parts = [
        frame.select(F.lit(name).alias("dataset"), "reason", "ref", "source_record_id")
        for name, frame in rejects.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def annotate_priority(df: DataFrame, source_col: str = "source_type") -> DataFrame:
    """Declared source priority, and whether a segment is a product candidate."""
    out = df.withColumn(
        "source_priority",
        map_value(F.col(source_col), {k: str(v) for k, v in SOURCE_PRIORITY.items()}).cast("int"),
    )
    if "segment_type" in df.columns:
        out = out.withColumn("product_candidate", F.col("segment_type") == "PRODUCT")
    return out


def reconcile_layers(raw: DataFrame, standard: DataFrame, key: str) -> DataFrame:
    """Keys per presence in the raw and the standard layer."""
    left = raw.groupBy(key).agg(F.count(F.lit(1)).alias("raw_rows"))
    right = standard.groupBy(key).agg(F.count(F.lit(1)).alias("standard_rows"))
    joined = left.join(right, key, "full")
    return joined.groupBy(
        F.when(F.col("raw_rows").isNull(), "only_standard")
        .when(F.col("standard_rows").isNull(), "only_raw")
        .otherwise("both")
        .alias("presence")
    ).agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum("raw_rows"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum("standard_rows"), F.lit(0)).alias("standard_rows"),
    )


def label_index(triples: DataFrame) -> DataFrame:
    """Label -> product with ambiguous labels flagged; ``triples(s, p, o)``."""
    labels = triples.filter(F.col("p").isin("skos:prefLabel", "skos:altLabel")).select(
        F.lower(clean_str(F.col("o"))).alias("label"),
        F.col("s").alias("product_id"),
        (F.col("p") == "skos:prefLabel").alias("preferred"),
    )
    return labels.groupBy("label").agg(
        F.count_distinct("product_id").alias("products"),
        F.min("product_id").alias("product_id"),
        F.bool_or("preferred").alias("preferred"),
    ).withColumn("ambiguous", F.col("products") > 1)


NORMALIZERS: dict[str, Callable] = {
    "stock_basic": lambda raw, refs, form: securities(raw, refs.get("securities_current"), form),
    "namechange": lambda raw, refs, form: name_history(raw, refs["securities"], form),
    "index_classify": lambda raw, refs, form: industries(raw),
    "index_member_all": lambda raw, refs, form: industry_membership(
        raw, refs["securities"], refs["links"], refs["industries"], form
    ),
    "ths_index": lambda raw, refs, form: concepts(raw, "THS"),
    "dc_index": lambda raw, refs, form: concepts(raw, "DC"),
    "ths_member": lambda raw, refs, form: concept_membership(
        raw, "THS", refs["securities"], refs["links"], refs["concepts"], form
    ),
    "dc_member": lambda raw, refs, form: concept_membership(
        raw, "DC", refs["securities"], refs["links"], refs["concepts"], form
    ),
    "income_vip": lambda raw, refs, form: to_observations(raw, refs["securities"], ["revenue", "n_income"], form),
    "cashflow_vip": lambda raw, refs, form: to_observations(raw, refs["securities"], ["n_cashflow_act"], form),
    "fina_indicator_vip": lambda raw, refs, form: to_observations(
        raw, refs["securities"], ["roe", "netprofit_yoy"], form
    ),
    "top10_holders": lambda raw, refs, form: holdings(raw, refs["securities"], code_form=form),
}


def normalize(
    raw: DataFrame, dataset: str, refs: Mapping[str, DataFrame] | None = None, code_form: str = TS_CODE
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(rows, rejects, events)`` of one dataset; order datasets securities first.

    ``code_form`` is the pattern of a security code.
    """
    refs = refs or {}
    mine = raw_since(raw, dataset)
    if dataset == "stock_company":
        rows, _, events, rejects = companies(mine, refs["securities"], refs.get("links"), code_form)
        return rows, rejects, events
    if dataset == "fina_mainbz_vip":
        rows, events, rejects = business_segments(mine, refs["securities"], refs["links"], code_form=code_form)
        return rows, rejects, events
    if dataset not in NORMALIZERS:
        raise ValueError(f"dataset {dataset!r} has no normalizer")
    rows, rejects = NORMALIZERS[dataset](mine, refs, code_form)
    return rows, rejects, None


def snapshot_counts(memberships: DataFrame) -> DataFrame:
    """Rows that commit together, per snapshot date."""
    return memberships.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("members"))
