"""C rows over messy forms of the tables' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.catalog.sqlframes import WS
from factloom.functions import clean
from factloom.sources.bindings import Frames

NULLISH = """CASE o_custkey % 6 WHEN 0 THEN ' null ' WHEN 1 THEN '' WHEN 2 THEN concat('  ', lower(o_orderpriority), chr(9)) ELSE o_orderpriority END"""


@query("c01_clean_str", f"""
    SELECT o_orderkey, CASE WHEN t NOT IN ('', 'None', 'null', 'NULL') THEN t END AS cleaned
    FROM (SELECT o_orderkey, trim({NULLISH}, chr(9) || ' ') AS t FROM orders)""")
def c01(f: Frames) -> DataFrame:
    return f.table("orders").select("o_orderkey", clean.clean_str(F.expr(NULLISH)).alias("cleaned"))


@query("c02_upper_trim", f"""
    SELECT o_orderkey, upper(CASE WHEN t NOT IN ('', 'None', 'null', 'NULL') THEN t END) AS cleaned
    FROM (SELECT o_orderkey, trim({NULLISH}, chr(9) || ' ') AS t FROM orders)""")
def c02(f: Frames) -> DataFrame:
    return f.table("orders").select("o_orderkey", clean.upper_trim(F.expr(NULLISH)).alias("cleaned"))


@query("c03_parse_date", """
    SELECT o_orderkey, CASE WHEN o_custkey % 5 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS day, o_custkey % 5 IN (2, 3) AS bad FROM orders""")
def c03(f: Frames) -> DataFrame:
    text = F.expr(
        "CASE o_custkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 3 THEN concat(year(o_orderdate), '1340') ELSE 'None' END"
    )
    day, bad = clean.parse_date(text)
    return f.table("orders").select("o_orderkey", day.alias("day"), F.coalesce(bad, F.lit(False)).alias("bad"))


@query("c04_decimal_or_null", """
    SELECT o_orderkey, CASE WHEN o_custkey % 4 IN (0, 1) THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS number,
           o_custkey % 4 = 2 AS bad FROM orders""")
def c04(f: Frames) -> DataFrame:
    text = F.expr(
        "CASE o_custkey % 4 WHEN 0 THEN format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2) "
        "WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) WHEN 2 THEN concat(o_orderstatus, '1') ELSE '' END"
    )
    number, bad = clean.decimal_or_null(text)
    return f.table("orders").select(
        "o_orderkey", number.cast("double").alias("number"), F.coalesce(bad, F.lit(False)).alias("bad")
    )


@query("c05_valid_ts_code", """
    SELECT rid, CASE WHEN code_ok THEN base_code END AS code, NOT code_ok AS bad FROM raw_sec""")
def c05(f: Frames) -> DataFrame:
    code, bad = clean.valid_ts_code(F.try_element_at("payload", F.lit("ts_code")), clean.LONG_TS_CODE)
    return f.raw_securities().select(F.col("source_record_id").alias("rid"), code.alias("code"), bad.alias("bad"))


@query("c06_map_value", """
    SELECT rid, status, exchange_code AS exchange FROM raw_sec WHERE code_ok""")
def c06(f: Frames) -> DataFrame:
    from factloom.vocab import EXCHANGE_BY_SUFFIX, LIST_STATUS

    get = lambda n: F.try_element_at("payload", F.lit(n))
    code, bad = clean.valid_ts_code(get("ts_code"), clean.LONG_TS_CODE)
    return f.raw_securities().filter(~bad).select(
        F.col("source_record_id").alias("rid"),
        clean.map_value(clean.clean_str(get("list_status")), LIST_STATUS, F.lit("UNKNOWN")).alias("status"),
        clean.exchange_code(get("exchange"), code, EXCHANGE_BY_SUFFIX).alias("exchange"),
    )


@query("c07_first_non_null", "SELECT rid, canonical_name AS name FROM raw_com")
def c07(f: Frames) -> DataFrame:
    get = lambda n: F.try_element_at("payload", F.lit(n))
    return f.raw_companies().select(
        F.col("source_record_id").alias("rid"),
        clean.first_non_null(get("name"), get("com_name"), get("fullname")).alias("name"),
    )


@query("c08_normalize_ws", f"""
    SELECT doc_id, sha256(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')) AS hash FROM documents""")
def c08(f: Frames) -> DataFrame:
    return f.spread("documents").select("doc_id", F.sha2(clean.normalize_ws(F.col("text")), 256).alias("hash"))


@query("c09_contains_ci", """
    SELECT doc_id, contains(lower(text), 'the ') AS a, contains(lower(text), '%') AS b FROM documents""")
def c09(f: Frames) -> DataFrame:
    return f.table("documents").select(
        "doc_id", clean.contains_ci(F.col("text"), "The ").alias("a"), clean.contains_ci(F.col("text"), "%").alias("b")
    )


@query("c10_complete_fy", """
    SELECT l_orderkey, l_linenumber, month(l_shipdate) = 12 AND day(l_shipdate) = 31 AND l_quantity IS NOT NULL AS fy FROM lineitem""")
def c10(f: Frames) -> DataFrame:
    return f.table("lineitem").select(
        "l_orderkey", "l_linenumber", clean.is_complete_fy(F.col("l_shipdate"), F.col("l_quantity")).alias("fy")
    )


@query("c11_transforms", r"""
    SELECT page_id, lower(trim(url)) AS lower_trim,
           regexp_replace(concat(lower(regexp_extract(url, '^https?://[^/]+')), regexp_replace(url, '^https?://[^/]+', '')), '/+$', '') AS normalize_url,
           CASE page_id % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' ELSE 'EUR' END AS normalize_currency,
           CASE page_id % 3 WHEN 0 THEN 12345 END AS integer_or_null,
           CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bool_from_source,
           CASE page_id % 3 WHEN 0 THEN 'SSE' WHEN 1 THEN 'SZSE' ELSE 'BSE' END AS normalize_exchange,
           CASE page_id % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS normalize_industry_level
    FROM pages""")
def c11(f: Frames) -> DataFrame:
    pick = lambda a, b, c: F.expr(f"CASE page_id % 3 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END")
    inputs = {
        "lower_trim": F.col("url"), "normalize_url": F.concat(F.col("url"), F.lit("")),
        "normalize_currency": pick("rmb", " usd", "EUR"), "integer_or_null": pick("12,345", "x", "None"),
        "bool_from_source": pick("Y", "0", "maybe"), "normalize_exchange": pick("sh", "SZSE", "bj"),
        "normalize_industry_level": pick("1", "l2", "L3"),
    }
    return f.table("pages").select("page_id", *[clean.apply_transform(c, n).alias(n) for n, c in inputs.items()])


@query("c12_validations", """
    SELECT security_id, concat_ws(',', CASE WHEN security_id % 4 = 3 THEN 'exchange not in set' END,
           CASE WHEN security_id % 5 = 2 THEN 'list_date after delist_date' END) AS reasons FROM security""")
def c12(f: Frames) -> DataFrame:
    exchange = F.expr("CASE security_id % 4 WHEN 0 THEN 'SSE' WHEN 1 THEN 'SZSE' WHEN 2 THEN NULL ELSE 'NYSE' END")
    delist = F.expr("CASE security_id % 5 WHEN 0 THEN NULL WHEN 2 THEN date'2000-01-01' ELSE date'2020-01-01' END")
    reasons = clean.validation_reasons(exchange, F.lit("2010-01-01").cast("date"), delist)
    return f.securities().select("security_id", F.array_join(reasons, ",").alias("reasons"))
