"""Driver tables as domain frames.

Each frame is a projection (or an aggregate) of a whole table, so that the work
of a query grows with the data. ``factloom.catalog.sqlframes`` holds the same
definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# k of the event props drives the invented claim fields
STATUS_BY_DIGIT = [
    "ACCEPTED", "ACCEPTED", "ACCEPTED", "ACCEPTED", "ACCEPTED", "NEEDS_REVIEW", "VALIDATED",
    "CONTRADICTED", "SUPERSEDED", "REJECTED",
]
STAGE_BY_TENS = [
    "TECHNOLOGY_RESERVE", "RESEARCH", "PROTOTYPE", "SAMPLE_VALIDATION", "SMALL_BATCH",
    "MASS_PRODUCTION", "MASS_PRODUCTION", "UNKNOWN", None, "UNKNOWN",
]
PREDICATE_BY_EVENT = {
    "click": "PRODUCES", "view": "DEVELOPS", "purchase": "HAS_REVENUE_FROM",
    "signup": "SUPPLIES_TO", "error": "DENIES_INVOLVEMENT",
}


def _landed(fields: dict[str, str]) -> Column:
    """Payload map as one generated column.

    A generated column is computed once per row, as a stored payload would be
    read once; a plain alias would be expanded into every use of it.
    """
    pairs = [x for name, e in fields.items() for x in (F.lit(name), F.expr(e).cast("string"))]
    return F.explode(F.array(F.create_map(*pairs)))


class Frames:
    """Domain frames over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row.

        A small file with one row group is read by one task, so its rows are
        dealt out when there are fewer input splits than cores; a large table
        has more splits than cores and is left as it is.
        """
        rows = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

    def observations(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS security_id",
            "'NET_CF_OPERATING' AS metric_code",
            "make_date(year(o_orderdate), 12, 31) AS period_end",
            "left(o_orderpriority, 1) AS report_type",
            "CAST(o_totalprice AS DECIMAL(18,2)) - 250000 AS value",
            "CASE WHEN o_orderkey % 7 <> 0 THEN 'CNY' END AS currency",
            "o_orderdate AS announced_at",
            "o_orderstatus AS update_flag",
            "o_orderdate AS recorded_at",
        )

    def links(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey div 2 AS company_id",
            "c_custkey AS security_id",
            "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 24 AS INT)) AS recorded_at",
        )

    def company(self) -> DataFrame:
        return self.table("customer").groupBy(F.expr("c_custkey div 2").alias("id")).agg(
            F.min("c_name").alias("canonical_name")
        )

    def securities(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS security_id",
            "c_custkey AS id",
            "concat(lpad(CAST(c_custkey AS STRING), greatest(6, length(CAST(c_custkey AS STRING))), '0'), '.', "
            "CASE c_custkey % 3 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' ELSE 'BJ' END) AS ts_code",
            "c_name AS name",
            "CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'SSE' END AS exchange_code",
            "CASE c_nationkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'DELISTED' ELSE 'UNKNOWN' END AS status",
        )

    def claims(self) -> DataFrame:
        events = self.table("events").select(
            "event_id", "user_id", "event_type", "ts",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )
        digit, tens = F.col("k") % 10, F.floor(F.col("k") / 10).cast("int")
        predicate = F.create_map(*[F.lit(x) for p in PREDICATE_BY_EVENT.items() for x in p])
        recorded = F.expr("ts + make_dt_interval(0, k)")
        return events.select(
            F.col("event_id").alias("claim_id"),
            F.lit("Company").alias("subject_type"),
            F.col("user_id").alias("subject_id"),
            F.element_at(predicate, F.col("event_type")).alias("predicate_code"),
            F.when(F.col("k") % 11 != 0, F.when(F.col("k") % 13 == 0, "Concept").otherwise("Product")).alias("object_type"),
            F.when(F.col("k") % 11 != 0, F.expr("CAST(k div 4 + 1 AS BIGINT)")).alias("object_id"),
            F.when(F.col("k") % 11 == 0, F.concat(F.lit("value-"), F.col("k").cast("string"))).alias("object_value"),
            F.get(F.array(*[F.lit(s) for s in STATUS_BY_DIGIT]), digit).alias("claim_status"),
            F.get(F.array(*[F.lit(s) for s in STAGE_BY_TENS]), tens).alias("business_stage"),
            F.when(F.col("event_type") == "error", "COMPANY_DENIAL")
            .when(F.col("event_type") == "purchase", "REVENUE_DISCLOSED")
            .when(F.col("k") % 7 == 0, "PLATFORM_CLASSIFICATION_ONLY")
            .otherwise("PRODUCT_DISCLOSED").alias("evidence_state"),
            (F.col("k").cast("double") / 100).alias("confidence"),
            F.col("ts").alias("valid_from"),
            F.when(F.col("k") % 5 != 0, F.expr("ts + make_dt_interval(k)")).alias("valid_to"),
            recorded.alias("recorded_at"),
            F.when(digit == 8, recorded + F.expr("make_dt_interval(10)")).alias("superseded_at"),
            F.concat(F.lit("0.1."), F.col("k").cast("string")).alias("ontology_version"),
            F.when(F.col("k") % 3 != 0, F.concat(F.lit("FY"), F.year("ts").cast("string"))).alias("report_period"),
            (F.col("k") % 4 == 0).alias("hedged"),
            "k",
        )

    def claim_evidence(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("claim_id"),
            (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("int") % 8).alias("evidence_id"),
            F.lit("SUPPORTS").alias("support_type"),
            F.lit(1.0).alias("weight"),
        )

    def live_links(self) -> DataFrame:
        """Evidence links whose fragment exists."""
        return self.claim_evidence().join(self.fragments().select("evidence_id"), "evidence_id", "left_semi")

    def fragments(self) -> DataFrame:
        return self.table("conversations").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("evidence_id"),
            F.col("conv_id").alias("document_id"),
            F.col("conv_id").alias("document_version_id"),
            (F.col("turn") + 1).cast("int").alias("page_number"),
            F.lit(0).alias("char_start"),
            F.length("text").alias("char_end"),
            F.col("text").alias("quote_text"),
            F.sha2("text", 256).alias("checksum"),
        )

    def products(self) -> DataFrame:
        return self.table("part").selectExpr(
            "CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS product_id", "p_brand AS canonical_name"
        ).distinct()

    def pages(self) -> DataFrame:
        """Page texts: every document is one page, every conversation turn a page."""
        docs = self.spread("documents").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
            F.lit(1).alias("page_number"), "text",
        )
        turns = self.table("conversations").select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("document_id"),
            (F.col("turn") + 1).cast("int").alias("page_number"), "text",
        )
        return docs.unionByName(turns)

    def taxonomy(self) -> DataFrame:
        part = self.table("part")
        brand = F.regexp_replace("p_brand", "Brand#", "brand:")
        kind = F.concat(F.lit("type:"), F.col("p_type"))
        return (
            part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("child"), brand.alias("parent"))
            .unionByName(part.select(brand.alias("child"), kind.alias("parent")).distinct())
            .unionByName(part.select(kind.alias("child"), F.lit("root:goods").alias("parent")).distinct())
        )

    def trade_edges(self) -> DataFrame:
        """Graph over whole tables: customer -> order -> supplier."""
        orders = self.table("orders").select(
            F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("edge_id"),
            F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("dst"),
            F.lit("PRODUCES").alias("rel_type"),
        )
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey").distinct().select(
            F.concat_ws("-", F.lit("L"), "l_orderkey", "l_suppkey").alias("edge_id"),
            F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"),
            F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst"),
            F.lit("SUPPLIES_TO").alias("rel_type"),
        )
        return orders.unionByName(lines)

    def trade_nodes(self) -> DataFrame:
        def nodes(table: str, key: str, prefix: str, label: str, name: str) -> DataFrame:
            return self.table(table).select(
                F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"),
                F.lit(label).alias("label"), F.expr(name).alias("canonical_name"),
            )

        return (
            nodes("customer", "c_custkey", "customer:", "Company", "c_name")
            .unionByName(nodes("orders", "o_orderkey", "order:", "Product", "o_orderpriority"))
            .unionByName(nodes("supplier", "s_suppkey", "supplier:", "Company", "s_name"))
        )

    def chain(self) -> DataFrame:
        """Provenance entries: conversation turns in order, each with the turn before as parent."""
        turns = self.table("conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("entity_id"),
            F.col("role").alias("entity_type"),
            F.lit("turn").alias("activity_id"),
            F.col("role").alias("agent_id"),
            F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1)).alias("parent_entity_id"),
            F.sha2(F.concat_ws("|", "conv_id", "turn", "role", "text"), 256).alias("checksum"),
            (F.col("conv_id") * 100 + F.col("turn")).alias("sequence_id"),
        )
        return turns

    def runs(self) -> DataFrame:
        """Orders as job runs of datasets."""
        return self.table("orders").selectExpr(
            "o_orderkey AS run_id",
            "o_orderpriority AS dataset",
            "o_orderdate AS started_at",
            "CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'PARTIAL_SUCCESS' ELSE 'RUNNING' END AS status",
            "CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + make_dt_interval(CAST(o_custkey % 10 AS INT)) END AS finished_at",
            "o_orderdate + make_dt_interval(1) AS lease_expires_at",
            "CAST(o_totalprice AS BIGINT) AS rows",
        )

    def outbox(self) -> DataFrame:
        """Order events as an outbox over the claims."""
        return self.table("orders").selectExpr(
            "o_orderkey AS seq",
            "'Claim' AS aggregate_type",
            "o_orderkey AS aggregate_id",
            "'CLAIM_ACCEPTED' AS event_type",
            "concat('claim-accepted:', o_orderkey) AS idempotency_key",
            "CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'P' THEN 'PROCESSING' ELSE 'PENDING' END AS status",
            "CAST(o_custkey % 6 AS INT) AS retry_count",
            "o_orderdate AS created_at",
            "o_orderdate + make_dt_interval(30) AS lease_expires_at",
            "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_dt_interval(1) END AS processed_at",
        )

    def tasks(self) -> DataFrame:
        """A review task per event."""
        k = F.get_json_object("props", "$.k").cast("int")
        status = F.array(*[F.lit(s) for s in ("OPEN", "IN_PROGRESS", "COMPLETED", "CANCELLED")])
        return self.table("events").select(
            (F.col("event_id") + 1_000_000_000).alias("task_id"),
            F.col("event_id").alias("claim_id"),
            F.get(status, k % 4).alias("status"),
            F.when(k % 3 == 0, "HIGH").otherwise("NORMAL").alias("priority"),
            F.col("ts").alias("created_at"),
        )

    def raw_securities(self) -> DataFrame:
        """Listing records: some broken codes, missing names and unknown status values."""
        base = self.securities().join(
            self.table("customer").selectExpr("c_custkey AS security_id", "c_mktsegment", "c_acctbal", "c_nationkey"),
            "security_id",
        )
        return self._raw(
            base,
            "stock_basic",
            {
                "ts_code": "CASE WHEN security_id % 17 = 0 THEN concat('X', ts_code) ELSE concat(' ', lower(ts_code)) END",
                "symbol": "split(ts_code, '[.]')[0]",
                "name": "CASE WHEN security_id % 19 <> 0 THEN name ELSE ' None ' END",
                "exchange": "CASE WHEN security_id % 4 = 0 THEN 'szse' END",
                "list_status": "CASE c_nationkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'D' WHEN 2 THEN 'P' ELSE '' END",
            },
            "security_id",
        )

    def _raw(self, df: DataFrame, api: str, fields: dict[str, str], key: str) -> DataFrame:
        payload = _landed(fields)
        return df.select(
            F.col(key).alias("source_record_id"),
            F.lit("VENDOR").alias("source_system"),
            F.lit(api).alias("api_name"),
            payload.alias("payload"),
            F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST({key} % 1000 AS INT))").alias("retrieved_at"),
        )

    def raw_statements(self) -> DataFrame:
        """Orders as cash-flow records with unreadable, absent and NULL values mixed in."""
        base = self.spread("orders").join(
            self.securities().select(F.col("security_id").alias("o_custkey"), "ts_code"), "o_custkey", "left"
        )
        raw = self._raw(
            base, "cashflow_vip",
            {
                "ts_code": "CASE WHEN o_orderkey % 29 = 0 THEN '999999.SH' ELSE ts_code END",
                "end_date": "CASE WHEN o_orderkey % 31 = 0 THEN 'n/a' ELSE concat(year(o_orderdate), '1231') END",
                "ann_date": "CASE WHEN o_orderkey % 3 <> 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') END",
                "report_type": "CASE WHEN o_orderkey % 5 <> 0 THEN left(o_orderpriority, 1) END",
                "update_flag": "o_orderstatus",
                "n_cashflow_act": "CASE WHEN o_orderkey % 37 = 0 THEN 'abc' WHEN o_orderkey % 11 <> 0 "
                "THEN format_number(CAST(o_totalprice AS DECIMAL(18,2)), 2) END",
            },
            "o_orderkey",
        )
        present = F.map_filter("payload", lambda k, v: (k != "n_cashflow_act") | (F.col("source_record_id") % 13 != 0))
        return raw.withColumn("payload", present)

    def _coded_orders(self, *columns: str) -> DataFrame:
        """Orders with the code of their customer, found before they meet their many lines."""
        return self.table("orders").select("o_orderkey", "o_custkey", *columns).join(
            self.securities().select(F.col("security_id").alias("o_custkey"), "ts_code"), "o_custkey"
        )

    def raw_segments(self) -> DataFrame:
        """Lines as segment records of the ordering customer."""
        base = (
            self.spread("lineitem")
            .join(self._coded_orders("o_orderdate"), F.expr("l_orderkey = o_orderkey"))
            .join(self.table("part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
            .withColumn("rid", F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                                       "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING))"))
        )
        payload = {
            "ts_code": "ts_code",
            "end_date": "concat(year(o_orderdate), '-12-31')",
            "bz_item": "p_brand",
            "bz_code": "CASE l_linenumber % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'I' WHEN 2 THEN 'D' WHEN 3 THEN 'Z' ELSE 'P' END",
            "bz_sales": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)",
            "curr_type": "CASE WHEN l_linenumber % 2 = 0 THEN 'CNY' END",
        }
        mapped = _landed(payload)
        return base.select(
            F.col("rid").alias("source_record_id"), F.lit("fina_mainbz_vip").alias("api_name"),
            mapped.alias("payload"), F.col("l_shipdate").alias("retrieved_at"),
        )

    def raw_companies(self) -> DataFrame:
        """Customers as company profile records; the name sits under varying keys."""
        base = self.securities().join(
            self.table("customer").selectExpr("c_custkey AS security_id", "c_mktsegment", "c_acctbal", "c_nationkey"),
            "security_id",
        )
        return self._raw(
            base, "stock_company",
            {
                "ts_code": "CASE WHEN security_id % 23 = 0 THEN '999999.SH' ELSE ts_code END",
                "name": "CASE WHEN security_id % 3 = 0 THEN name END",
                "com_name": "CASE WHEN security_id % 3 = 1 THEN concat('Com ', name) END",
                "fullname": "CASE WHEN security_id % 15 = 2 THEN concat('Full ', name) END",
                "province": "concat('P', c_nationkey)",
                "reg_capital": "CASE WHEN security_id % 41 = 0 THEN 'many' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END",
                "introduction": "CASE WHEN security_id % 4 <> 0 THEN concat('About ', name) END",
                "main_business": "c_mktsegment",
            },
            "security_id",
        )

    def raw_holders(self) -> DataFrame:
        """Supplier sales as holdings: holder, date and a ratio that may be missing."""
        base = (
            self.spread("lineitem")
            .join(self._coded_orders(), F.expr("l_orderkey = o_orderkey"))
            .join(self.table("supplier").select("s_suppkey", "s_name"), F.expr("l_suppkey = s_suppkey"))
            .withColumn("rid", F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                                       "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING))"))
        )
        payload = {
            "ts_code": "ts_code",
            "holder_name": "CASE WHEN l_suppkey % 13 <> 0 THEN s_name ELSE 'null' END",
            "end_date": "date_format(l_shipdate, 'yyyyMMdd')",
            "hold_ratio": "CASE WHEN l_linenumber % 3 <> 0 THEN CAST(CAST(l_discount AS DECIMAL(10,2)) AS STRING) END",
        }
        mapped = _landed(payload)
        return base.select(
            F.col("rid").alias("source_record_id"), F.lit("top10_holders").alias("api_name"),
            mapped.alias("payload"), F.col("l_shipdate").alias("retrieved_at"),
        )

    def vendor_pages(self) -> DataFrame:
        """Customers as vendor answers of 100 rows; some pages drop or swap fields."""
        rows = self.securities().selectExpr(
            "security_id", "ts_code", "split(ts_code, '[.]')[0] AS symbol", "name", "security_id div 100 AS page",
        ).withColumn(
            "layout",
            F.expr("CASE WHEN page % 11 = 5 THEN 2 WHEN page % 13 = 6 THEN 3 WHEN page % 7 = 3 THEN 1 ELSE 0 END"),
        )
        item = F.expr(
            "CASE layout WHEN 0 THEN array(ts_code, symbol, name, 'SSE', 'L') WHEN 1 THEN array(ts_code, symbol, name, 'L') "
            "WHEN 2 THEN array(ts_code, symbol, 'SSE', 'L') ELSE array(symbol, ts_code, name, 'SSE', 'L') END"
        )
        fields = F.expr(
            "CASE layout WHEN 0 THEN array('ts_code', 'symbol', 'name', 'exchange', 'list_status') "
            "WHEN 1 THEN array('ts_code', 'symbol', 'name', 'list_status') "
            "WHEN 2 THEN array('ts_code', 'symbol', 'exchange', 'list_status') "
            "ELSE array('symbol', 'ts_code', 'name', 'exchange', 'list_status') END"
        )
        # Every tenth item comes short by its last value
        item = F.when(F.col("security_id") % 10 == 0, F.slice(item, 1, F.size(item) - 1)).otherwise(item)
        pages = rows.withColumn("_i", F.struct("security_id", item.alias("item"))).groupBy("page", "layout").agg(
            F.array_sort(F.collect_list("_i")).alias("_items")
        )
        body = F.struct(
            F.lit(0).alias("code"), F.lit("").alias("msg"),
            F.struct(fields.alias("fields"), F.transform("_items", lambda i: i["item"]).alias("items")).alias("data"),
        )
        return pages.select(
            F.lit("stock_basic").alias("dataset"),
            F.expr("page div 5").alias("run_id"),
            (F.expr("page % 5") * 100).alias("offset"),
            F.to_json(body).alias("body"),
        )

    def screen_tables(self) -> dict[str, DataFrame]:
        return {
            "company": self.company(), "links": self.links(), "securities": self.securities(),
            "observations": self.observations(), "claims": self.claims(),
            "claim_evidence": self.claim_evidence(), "fragments": self.fragments(),
            "products": self.products(),
        }
