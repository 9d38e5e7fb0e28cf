"""G rows: event claims as business edges, and the customer - order - supplier graph."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import query
from factloom.functions.clean import LONG_TS_CODE
from factloom.operators import graph as g
from factloom.operators.standardize import business_segments, products_from_segments
from factloom.sources.bindings import Frames

NOW = dt.datetime(2002, 1, 1)
AS_OF = dt.datetime(2024, 1, 20)


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _tables(f: Frames) -> dict[str, DataFrame]:
    return {
        "Company": f.company().select("id", F.col("canonical_name").alias("name")),
        "Security": f.securities().select("id", F.col("ts_code").alias("name")),
        "Product": f.products().select(F.col("product_id").alias("id"), F.col("canonical_name").alias("name")),
        "Industry": f.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Exchange": f.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "Concept": f.table("orders").select(F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("name")).distinct(),
        "Theme": f.table("part").select(F.col("p_type").alias("id"), F.concat(F.lit("theme "), "p_type").alias("name")).distinct(),
    }


@query("g01_entity_nodes", """
    SELECT CAST(id AS VARCHAR) AS id, 'Company' AS label, canonical_name FROM company
    UNION ALL SELECT CAST(id AS VARCHAR), 'Security', ts_code FROM security
    UNION ALL SELECT CAST(product_id AS VARCHAR), 'Product', canonical_name FROM product
    UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'Industry', n_name FROM nation
    UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'Exchange', r_name FROM region
    UNION ALL SELECT DISTINCT o_orderpriority, 'Concept', o_orderpriority FROM orders
    UNION ALL SELECT DISTINCT p_type, 'Theme', concat('theme ', p_type) FROM part""")
def g01(f: Frames) -> DataFrame:
    return g.entity_nodes(_tables(f))


def _replayed(f: Frames) -> DataFrame:
    """Claims of one subject and product as versions of one claim."""
    return f.claims().filter("object_id IS NOT NULL").withColumn("claim_id", F.concat_ws(":", "subject_id", "object_id"))


@query("g02_claim_nodes", """
    SELECT concat(subject_id, ':', object_id) AS claim_id, max(recorded_at) AS recorded_at,
           arg_max(claim_status, (recorded_at, claim_status)) AS claim_status,
           arg_max(claim_status, (recorded_at, claim_status)) = 'ACCEPTED' AS active FROM claim WHERE object_id IS NOT NULL GROUP BY 1""")
def g02(f: Frames) -> DataFrame:
    return g.claim_nodes(_replayed(f)).select("claim_id", "recorded_at", "claim_status", "active")


EDGES = """bedge AS (SELECT * FROM claim WHERE claim_status = 'ACCEPTED' AND object_id IS NOT NULL
    AND predicate_code IN ('PRODUCES', 'DEVELOPS', 'SUPPLIES_TO', 'HAS_REVENUE_FROM'))"""


@query("g03_business_edges", f"WITH {EDGES} SELECT claim_id, subject_id AS src, object_id AS dst, predicate_code AS rel_type, true AS active FROM bedge")
def g03(f: Frames) -> DataFrame:
    return g.business_edges(f.claims()).select("claim_id", "src", "dst", "rel_type", "active")


@query("g04_invalidate_edges", f"""WITH {EDGES}
    SELECT b.claim_id, e.at IS NULL AS active, e.at AS invalidated_at FROM bedge b
    LEFT JOIN (SELECT o_orderkey AS claim_id, min(o_orderdate) AS at FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1) e USING (claim_id)""")
def g04(f: Frames) -> DataFrame:
    events = f.table("orders").selectExpr(
        "o_orderkey AS claim_id", "o_orderdate AS at",
        "CASE o_orderstatus WHEN 'F' THEN 'CLAIM_CONTRADICTED' WHEN 'P' THEN 'CLAIM_SUPERSEDED' ELSE 'CLAIM_ACCEPTED' END AS event_type",
    )
    return g.invalidate_edges(g.business_edges(f.claims()), events).select("claim_id", "active", "invalidated_at")


def _tagged(f: Frames) -> DataFrame:
    return f.table("orders").selectExpr("o_custkey AS src", "o_orderpriority AS dst", "CAST(o_orderdate AS DATE) AS snapshot_date")


@query("g05_membership_edges", """
    SELECT o_custkey AS src, o_orderpriority AS dst, 'TAGGED_AS' AS rel_type, CAST(max(o_orderdate) AS DATE) AS snapshot_date FROM orders GROUP BY 1, 2""")
def g05(f: Frames) -> DataFrame:
    return g.membership_edges(_tagged(f), "TAGGED_AS").select("src", "dst", "rel_type", "snapshot_date")


@query("g06_segment_edges", """
    SELECT company_id AS src, substr(sha256(raw_segment_name), 1, 10) AS dst, max(period_end) AS period_end FROM segment
    WHERE segment_type = 'PRODUCT' GROUP BY 1, 2""")
def g06(f: Frames) -> DataFrame:
    segments, _, _ = business_segments(f.raw_segments(), f.securities(), f.links(), code_form=LONG_TS_CODE)
    products, _ = products_from_segments(segments)
    return g.segment_edges(segments, products).select("src", "dst", "period_end")


@query("g07_rebuild_stats", f"""WITH {EDGES}
    SELECT 'node' AS kind, 'Company' AS name, count(*) AS n FROM company UNION ALL SELECT 'node', 'Security', count(*) FROM security
    UNION ALL SELECT 'node', 'Product', count(*) FROM product UNION ALL SELECT 'node', 'Industry', count(*) FROM nation
    UNION ALL SELECT 'node', 'Exchange', count(*) FROM region UNION ALL SELECT 'node', 'Concept', count(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 'node', 'Theme', count(DISTINCT p_type) FROM part
    UNION ALL SELECT 'node', 'Claim', count(*) FROM claim WHERE claim_status IN ('ACCEPTED', 'CONTRADICTED', 'SUPERSEDED')
    UNION ALL SELECT 'edge', predicate_code, count(*) FROM bedge GROUP BY 2
    UNION ALL SELECT 'edge', 'TAGGED_AS', count(DISTINCT (o_custkey, o_orderpriority)) FROM orders""")
def g07(f: Frames) -> DataFrame:
    return g.rebuild_graph(_tables(f), f.claims(), {"TAGGED_AS": _tagged(f)})[2]


@query("g08_consume_outbox", """
    SELECT o.seq, CASE WHEN c.claim_id IS NOT NULL THEN 'PROCESSED' WHEN o.retry_count + 1 >= 5 THEN 'DEAD_LETTERED' ELSE 'PENDING' END AS next_status,
           CASE WHEN c.claim_id IS NOT NULL THEN o.retry_count ELSE o.retry_count + 1 END AS retry_count
    FROM outbox o LEFT JOIN claim c ON c.claim_id = o.aggregate_id
    WHERE o.status = 'PENDING' OR (o.status = 'PROCESSING' AND o.lease_expires_at < TIMESTAMP '2000-01-01')""")
def g08(f: Frames) -> DataFrame:
    now = F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
    return g.consume_outbox(f.outbox(), f.claims(), now)[0].select("seq", "next_status", "retry_count")


DUE = """due AS (SELECT * FROM outbox WHERE status = 'PENDING' OR (status = 'PROCESSING' AND lease_expires_at < TIMESTAMP '2000-01-01')
        ORDER BY created_at, seq LIMIT 500)"""


@query("g08_oldest_batch", f"""WITH {DUE}
    SELECT o.seq, CASE WHEN c.claim_id IS NOT NULL THEN 'PROCESSED' WHEN o.retry_count + 1 >= 5 THEN 'DEAD_LETTERED' ELSE 'PENDING' END AS next_status
    FROM due o LEFT JOIN claim c ON c.claim_id = o.aggregate_id""")
def g08b(f: Frames) -> DataFrame:
    """A batch takes the events that have waited longest."""
    now = F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
    return g.consume_outbox(f.outbox(), f.claims(), now, batch=500)[0].select("seq", "next_status")


@query("g08_projected_edges", f"""WITH {EDGES}
    SELECT claim_id, subject_id AS src, object_id AS dst, predicate_code AS rel_type FROM bedge
    WHERE claim_id IN (SELECT aggregate_id FROM outbox WHERE status = 'PENDING' OR (status = 'PROCESSING' AND lease_expires_at < TIMESTAMP '2000-01-01'))""")
def g08c(f: Frames) -> DataFrame:
    now = F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
    return g.consume_outbox(f.outbox(), f.claims(), now)[1].select("claim_id", "src", "dst", "rel_type")


@query("g09_reconciliation", f"""WITH {EDGES}
    SELECT a.n AS accepted_claims, a.nodes AS accepted_nodes, round(a.nodes / a.n * 100, 1) AS coverage_pct,
           b.n AS business_edges, b.named AS with_claim_id, round(b.named / b.n * 100, 1) AS claim_id_pct,
           o.n AS outbox_pending, date_diff('second', o.t, TIMESTAMP '2002-01-01') AS oldest_wait_seconds, s.h AS sample_hash
    FROM (SELECT count(*) AS n, count(*) FILTER (claim_id % 10 <> 0) AS nodes FROM claim WHERE claim_status = 'ACCEPTED') a,
         (SELECT count(*) AS n, count(*) FILTER (claim_id % 7 <> 0) AS named FROM bedge WHERE predicate_code <> 'HAS_REVENUE_FROM') b,
         (SELECT count(*) AS n, min(created_at) AS t FROM outbox WHERE status IN ('PENDING', 'PROCESSING')) o,
         (SELECT substr(sha256(concat('["', string_agg(id, '","' ORDER BY id), '"]')), 1, 16) AS h
          FROM (SELECT CAST(id AS VARCHAR) AS id FROM company ORDER BY 1 LIMIT 5)) s""")
def g09(f: Frames) -> DataFrame:
    """A graph that lacks some nodes, and some claim ids on its edges."""
    claims = f.claims()
    edges = g.business_edges(claims).withColumn("claim_id", F.when(F.col("claim_id") % 7 != 0, F.col("claim_id")))
    nodes = g.claim_nodes(claims).filter("claim_id % 10 <> 0")
    return g.reconcile_graph(claims, nodes, edges, f.outbox(), f.company(), _now())


@query("g10_companies_by_concept", """
    SELECT DISTINCT o_custkey AS company_id, '2-HIGH' AS concept FROM orders WHERE o_orderpriority = '2-HIGH'""")
def g10(f: Frames) -> DataFrame:
    edges = g.membership_edges(_tagged(f), "TAGGED_AS")
    nodes = f.table("orders").selectExpr("o_orderpriority AS id", "'Concept' AS label", "o_orderpriority AS canonical_name").distinct()
    return g.companies_by_concept(nodes, edges, "2-HIGH")


@query("g11_companies_by_stage", f"""WITH {EDGES}
    SELECT DISTINCT subject_id AS company_id FROM bedge WHERE predicate_code = 'PRODUCES' AND business_stage = 'SMALL_BATCH'""")
def g11(f: Frames) -> DataFrame:
    return g.companies_by_stage(g.business_edges(f.claims()), "SMALL_BATCH")


ENDS = "ends AS MATERIALIZED (SELECT concat('customer:', min(c_custkey)) AS a, concat('customer:', max(c_custkey)) AS b FROM customer)"


def trade_ends(f: Frames) -> tuple[str, str]:
    row = f.table("customer").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).first()
    return f"customer:{row.a}", f"customer:{row.b}"


@query("g12_relation_paths", f"""WITH {ENDS},
    h1 AS MATERIALIZED (SELECT e.src AS s, e.dst AS n1, e.edge_id AS e1 FROM trade_und e JOIN ends ON e.src = ends.a),
    h2 AS MATERIALIZED (SELECT h1.*, e.dst AS n2, e.edge_id AS e2 FROM h1 JOIN trade_und e ON e.src = n1 AND e.edge_id <> e1),
    g1 AS MATERIALIZED (SELECT e.dst AS m1, e.edge_id AS d1, e.src AS b FROM trade_und e JOIN ends ON e.src = ends.b),
    g2 AS MATERIALIZED (SELECT g1.*, e.dst AS m2, e.edge_id AS d2 FROM g1 JOIN trade_und e ON e.src = m1 AND e.edge_id <> d1)
    SELECT 4 AS hops, concat_ws('>', s, n1, n2, m1, b) AS path, concat_ws('>', e1, e2, d2, d1) AS edges
    FROM h2 JOIN g2 ON n2 = m2 AND e1 <> d1 AND e1 <> d2 AND e2 <> d1 AND e2 <> d2
    UNION ALL SELECT 3, concat_ws('>', s, n1, n2, b), concat_ws('>', e1, e2, d1) FROM h2 JOIN g1 ON n2 = m1 AND d1 <> e1 AND d1 <> e2
    UNION ALL SELECT 2, concat_ws('>', s, n1, b), concat_ws('>', e1, d1) FROM h1 JOIN g1 ON n1 = m1 AND d1 <> e1
    UNION ALL SELECT 1, concat_ws('>', s, n1), e1 FROM h1 JOIN ends ON n1 = ends.b""")
def g12(f: Frames) -> DataFrame:
    paths = g.relation_paths(f.trade_edges(), *trade_ends(f), max_hops=4)
    return paths.select("hops", F.array_join("path_nodes", ">").alias("path"), F.array_join("path_edges", ">").alias("edges"))


@query("g13_company_edges", f"""WITH {EDGES}
    SELECT claim_id, business_stage AS stage, valid_from, recorded_at FROM bedge WHERE predicate_code = 'PRODUCES'
      AND subject_id = (SELECT max(user_id) FROM events)""")
def g13(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id")).scalar()
    return g.company_edges(g.business_edges(f.claims()), wanted).select("claim_id", "stage", "valid_from", "recorded_at")


def subgraph_sql(edge: str, start: str, where: str = "true") -> str:
    """All walks of up to two steps, all counted, and the nodes in the order in which they are reached."""
    return f"""
    und AS (SELECT edge_id, src, dst FROM {edge} UNION ALL SELECT edge_id, dst, src FROM {edge} WHERE src <> dst),
    h1 AS (SELECT src AS s, dst AS n1, edge_id AS e1 FROM und WHERE src = {start}),
    walks AS (SELECT 1 AS hops, [s, n1] AS nodes, [e1] AS edges FROM h1
        UNION ALL SELECT 2, [s, n1, e.dst], [e1, e.edge_id] FROM h1 JOIN und e ON e.src = n1 AND e.edge_id <> e1),
    nwalk AS (SELECT *, row_number() OVER (ORDER BY hops, nodes, edges) AS p, count(*) OVER () AS walks FROM walks WHERE {where}),
    seen AS (SELECT id, min((p, pos)) AS first_at, any_value(walks) AS walks
        FROM (SELECT p, walks, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS pos FROM nwalk) GROUP BY 1),
    kept AS (SELECT id, first_at[1] AS p, row_number() OVER (ORDER BY first_at) AS position, count(*) OVER () AS total, walks FROM seen),
    used AS (SELECT DISTINCT unnest(edges) AS edge_id FROM nwalk WHERE p <= 300 OR p IN (SELECT p FROM kept WHERE position <= 40))"""


SUBGRAPH = f"{ENDS}, {subgraph_sql('trade_edge', '(SELECT a FROM ends)')}"
KEPT_SQL = "SELECT k.id, n.label, n.canonical_name, k.position, total > 40 OR walks > 300 AS truncated FROM kept k LEFT JOIN {} n USING (id) WHERE position <= 40"
USED_SQL = """SELECT e.edge_id, e.src, e.dst, e.rel_type FROM {} e JOIN used USING (edge_id)
    WHERE e.src IN (SELECT id FROM kept WHERE position <= 40) AND e.dst IN (SELECT id FROM kept WHERE position <= 40)"""


@query("g14_subgraph_nodes", f"WITH {SUBGRAPH} {KEPT_SQL.format('trade_node')}")
def g14(f: Frames) -> DataFrame:
    return g.subgraph(f.trade_nodes(), f.trade_edges(), trade_ends(f)[0], 2, 40)[0]


@query("g14_subgraph_edges", f"WITH {SUBGRAPH} {USED_SQL.format('trade_edge')}")
def g14b(f: Frames) -> DataFrame:
    return g.subgraph(f.trade_nodes(), f.trade_edges(), trade_ends(f)[0], 2, 40)[1]


# Customers as edges from their market segment to their nation: few nodes, many edges between two of them.
# Nations bear no shown label here, so they are seen only on the way to another segment or back.
SEGMENT_SQL = f"""WITH sedge AS (
        SELECT concat('c', c_custkey) AS edge_id, c_mktsegment AS src, concat('n', c_nationkey) AS dst, 'SUPPLIES_TO' AS rel_type FROM customer),
    snode AS (SELECT DISTINCT c_mktsegment AS id, 'Concept' AS label, c_mktsegment AS canonical_name FROM customer
        UNION ALL SELECT DISTINCT concat('n', c_nationkey), 'Claim', 'nation' FROM customer),
    {subgraph_sql('sedge', "'AUTOMOBILE'", "list_last(nodes) IN (SELECT c_mktsegment FROM customer)")}"""


def _segments(f: Frames) -> tuple[DataFrame, DataFrame]:
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    edges = f.table("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("edge_id"), F.col("c_mktsegment").alias("src"),
        nation.alias("dst"), F.lit("SUPPLIES_TO").alias("rel_type"),
    )
    segments = edges.select(F.col("src").alias("id"), F.lit("Concept").alias("label"), F.col("src").alias("canonical_name"))
    nations = edges.select(F.col("dst").alias("id"), F.lit("Claim").alias("label"), F.lit("nation").alias("canonical_name"))
    return segments.distinct().unionByName(nations.distinct()), edges


@query("g14_parallel_edges_nodes", f"{SEGMENT_SQL} {KEPT_SQL.format('snode')}")
def g14c(f: Frames) -> DataFrame:
    return g.subgraph(*_segments(f), "AUTOMOBILE", 2, 40)[0]


@query("g14_parallel_edges_edges", f"{SEGMENT_SQL} {USED_SQL.format('sedge')}")
def g14d(f: Frames) -> DataFrame:
    return g.subgraph(*_segments(f), "AUTOMOBILE", 2, 40)[1]


@query("g15_subgraph_status", """
    SELECT 'STALE' AS status, CAST(0 AS BIGINT) AS nodes, count(*) AS accepted_claims FROM claim
    WHERE claim_status = 'ACCEPTED' AND subject_id = (SELECT max(user_id) FROM events)""")
def g15(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id").alias("u")).first().u
    empty = f.trade_nodes().filter(F.col("id") == f"customer:none-{wanted}")
    return g.subgraph_status(wanted, empty, f.company(), f.claims())


@query("g15_fallback_claims", """
    SELECT claim_id, predicate_code FROM claim WHERE claim_status = 'ACCEPTED' AND subject_id = (SELECT max(user_id) FROM events)
    ORDER BY recorded_at DESC, claim_id LIMIT 50""")
def g15b(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id")).scalar()
    return g.fallback_claims(f.claims(), wanted).select("claim_id", "predicate_code")


@query("g16_supply_neighbors", f"""WITH {ENDS},
    h1 AS (SELECT e.dst AS n1, e.edge_id AS e1, e.rel_type AS r1 FROM trade_und e JOIN ends ON e.src = ends.a),
    h2 AS (SELECT h1.*, e.dst AS n2, e.edge_id AS e2, e.rel_type AS r2 FROM h1 JOIN trade_und e ON e.src = n1 AND e.edge_id <> e1),
    h3 AS (SELECT h2.*, e.dst AS n3, e.edge_id AS e3, e.rel_type AS r3 FROM h2 JOIN trade_und e ON e.src = n2 AND e.edge_id <> e1 AND e.edge_id <> e2)
    SELECT n1 AS neighbor, r1 AS rels, count(*) AS paths FROM h1 GROUP BY 1, 2
    UNION ALL SELECT n2, concat_ws('>', r1, r2), count(*) FROM h2 GROUP BY 1, 2
    UNION ALL SELECT n3, concat_ws('>', r1, r2, r3), count(*) FROM h3 GROUP BY 1, 2""")
def g16(f: Frames) -> DataFrame:
    return g.supply_neighbors(f.trade_edges(), trade_ends(f)[0], 3)


@query("g17_claims_for", """
    SELECT claim_id FROM claim WHERE subject_id = (SELECT max(user_id) FROM events) AND predicate_code = 'DEVELOPS'""")
def g17(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id")).scalar()
    return g.claims_for(f.claims(), wanted, "DEVELOPS").select("claim_id")


@query("g18_verified_products", f"""WITH {EDGES}
    SELECT claim_id, subject_id AS company_id, object_id AS product_id, count(*) AS evidence FROM bedge JOIN live_link USING (claim_id)
    WHERE predicate_code = 'PRODUCES' AND valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20') GROUP BY 1, 2, 3""")
def g18(f: Frames) -> DataFrame:
    return g.verified_products(g.business_edges(f.claims()), f.claims(), f.live_links(), AS_OF)


def brand_claims(f: Frames) -> DataFrame:
    return f.claims().withColumn("object_id", F.concat(F.lit("brand:"), F.col("object_id").cast("string")))


THEME = "type:STANDARD"
THEMES = "theme AS (SELECT DISTINCT parent AS product_id, parent AS theme FROM taxonomy WHERE parent LIKE 'type:%')"


def themes(f: Frames) -> DataFrame:
    return f.taxonomy().filter("parent LIKE 'type:%'").select(
        F.col("parent").alias("product_id"), F.col("parent").alias("theme")
    ).distinct()


@query("g19_companies_in_theme", """
    SELECT subject_id AS company_id, concat('brand:', object_id) AS product_id, claim_id FROM claim
    WHERE claim_status = 'ACCEPTED' AND predicate_code = 'PRODUCES' AND business_stage IN ('MASS_PRODUCTION', 'SMALL_BATCH')
      AND valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')
      AND concat('brand:', object_id) IN (SELECT child FROM closure WHERE ancestor = 'type:STANDARD')""")
def g19(f: Frames) -> DataFrame:
    wanted = themes(f).filter(F.col("theme") == THEME).select(F.col("product_id").alias("ancestor"))
    closure = g.taxonomy_closure(f.taxonomy(), to=wanted)
    return g.companies_in_theme(brand_claims(f), closure, themes(f), THEME, ["MASS_PRODUCTION", "SMALL_BATCH"], AS_OF)


@query("g20_classification_only", """
    SELECT o_custkey AS company_id, count(DISTINCT o_orderpriority) AS concepts FROM orders
    WHERE o_custkey NOT IN (SELECT subject_id FROM claim WHERE claim_status = 'ACCEPTED'
        AND predicate_code IN ('PRODUCES', 'DEVELOPS', 'HAS_REVENUE_FROM')) GROUP BY 1""")
def g20(f: Frames) -> DataFrame:
    members = f.table("orders").selectExpr("o_custkey AS company_id", "o_orderpriority AS concept_id")
    return g.classification_only(members, f.claims())


@query("g21_theme_paths", f"""WITH {EDGES},
    p0 AS (SELECT DISTINCT concat('brand:', object_id) AS b FROM bedge WHERE predicate_code = 'PRODUCES' AND subject_id = (SELECT max(user_id) FROM events)),
    t AS (SELECT DISTINCT child, parent FROM taxonomy)
    SELECT CAST(3 AS INT) AS length, concat_ws('>', b, t1.parent, t2.parent) AS path FROM p0 JOIN t t1 ON t1.child = b JOIN t t2 ON t2.child = t1.parent
    WHERE t2.parent = 'root:goods' ORDER BY 1, 2 LIMIT 10""")
def g21(f: Frames) -> DataFrame:
    wanted = f.table("events").agg(F.max("user_id")).scalar()
    return g.theme_paths(g.business_edges(brand_claims(f)), f.taxonomy(), wanted, "root:goods")


@query("g22_taxonomy_closure", "SELECT child, ancestor, hops FROM closure")
def g22(f: Frames) -> DataFrame:
    return g.taxonomy_closure(f.taxonomy())


@query("g23_taxonomy_violations", """
    SELECT 'root:goods' AS id, 'self_parent' AS rule UNION ALL SELECT 'root:goods', 'cycle'
    UNION ALL SELECT concat('type:', p_type), 'cycle' FROM part WHERE p_type = 'SMALL' GROUP BY 1
    UNION ALL SELECT DISTINCT replace(p_brand, 'Brand#', 'brand:'), 'cycle' FROM part WHERE p_type = 'SMALL'
    UNION ALL SELECT concat('part:', p_partkey), 'one_scheme' FROM part WHERE p_size = 7
    UNION ALL SELECT concat('part:', p_partkey), 'one_label_per_language' FROM part WHERE p_size = 9
    UNION ALL SELECT concat('part:', p_partkey), 'label_required' FROM part WHERE p_size = 11""")
def g23(f: Frames) -> DataFrame:
    part = f.table("part")
    extra = part.filter("p_type = 'SMALL'").selectExpr("concat('type:', p_type) AS child", "replace(p_brand, 'Brand#', 'brand:') AS parent").distinct()
    own = part.selectExpr("'root:goods' AS child", "'root:goods' AS parent").distinct()
    taxonomy = f.taxonomy().unionByName(extra).unionByName(own)
    ids = taxonomy.select(F.col("child").alias("id")).distinct()
    sizes = part.selectExpr("concat('part:', p_partkey) AS id", "p_size")
    marked = ids.join(sizes, "id", "left")
    schemes = marked.filter("p_size IS NULL OR p_size <> 7").select("id", F.lit("goods").alias("scheme"))
    labels = marked.filter("p_size IS NULL OR p_size <> 11").select("id", F.lit("en").alias("lang"), F.col("id").alias("label"))
    twice = marked.filter("p_size = 9").select("id", F.lit("en").alias("lang"), F.lit("other").alias("label"))
    return g.taxonomy_violations(taxonomy, labels.unionByName(twice), schemes)


@query("g24_edge_integrity", f"""WITH {EDGES}
    SELECT CAST(claim_id AS VARCHAR) AS edge_id, 'missing_claim_id' AS finding FROM bedge WHERE k = 2
    UNION ALL SELECT CAST(claim_id AS VARCHAR), 'dangling_claim_id' FROM bedge WHERE k <> 2 AND claim_id IN (SELECT claim_id FROM claim WHERE k = 3)""")
def g24(f: Frames) -> DataFrame:
    claims = f.claims()
    marked = claims.filter("k = 2").select("claim_id", F.lit(True).alias("_bare"))
    edges = g.business_edges(claims).join(marked, "claim_id", "left").withColumn(
        "claim_id", F.when(F.col("_bare").isNull(), F.col("claim_id"))
    )
    return g.edge_integrity(edges, claims.filter("k <> 3")).select("edge_id", "finding")


@query("g25_verify_write", """
    SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey, o_custkey) NOT IN (SELECT (event_id, user_id) FROM events)""")
def g25(f: Frames) -> DataFrame:
    expected = f.table("orders").select("o_orderkey", "o_custkey")
    stored = f.table("events").select(F.col("event_id").alias("o_orderkey"), F.col("user_id").alias("o_custkey"))
    return g.verify_write(expected, stored, ["o_orderkey", "o_custkey"])


@query("g26_ontology_issues", """
    SELECT concat('p', p_partkey) AS focus, 'rdfs:domain' AS path, 'MISSING_DOMAIN' AS issue FROM part WHERE p_size % 5 = 0
    UNION ALL SELECT concat('p', p_partkey), 'rdfs:domain', 'UNRESOLVED_REFERENCE' FROM part WHERE p_size % 5 <> 0 AND p_type = 'SMALL'
    UNION ALL SELECT concat('p', p_partkey), 'rdfs:range', 'MISSING_RANGE' FROM part WHERE p_size % 7 = 0
    UNION ALL SELECT concat('s', p_partkey), 'sh:targetClass', 'UNRESOLVED_TARGET_CLASS' FROM part WHERE p_type = 'SMALL'
    UNION ALL SELECT concat('c', p_partkey), 'skos:prefLabel', 'MISSING_PREFLABEL' FROM part WHERE p_size % 3 = 0""")
def g26(f: Frames) -> DataFrame:
    part = f.table("part")
    pieces = [
        part.selectExpr("concat('p', p_partkey) AS s", "'rdf:type' AS p", "'owl:ObjectProperty' AS o"),
        part.filter("p_size % 5 <> 0").selectExpr("concat('p', p_partkey)", "'rdfs:domain'", "p_type"),
        part.filter("p_size % 7 <> 0").selectExpr("concat('p', p_partkey)", "'rdfs:range'", "'owl:Thing'"),
        part.filter("p_type <> 'SMALL'").selectExpr("p_type", "'rdf:type'", "'owl:Class'"),
        part.selectExpr("concat('s', p_partkey)", "'sh:targetClass'", "p_type"),
        part.selectExpr("concat('c', p_partkey)", "'rdf:type'", "'skos:Concept'"),
        part.filter("p_size % 3 <> 0").selectExpr("concat('c', p_partkey)", "'skos:prefLabel'", "p_name"),
    ]
    triples = pieces[0]
    for piece in pieces[1:]:
        triples = triples.union(piece)
    return g.ontology_issues(triples)


@query("g27_claims_to_triples", """
    SELECT concat('stock:claim/', claim_id) AS s, x.p, x.o FROM (
        SELECT claim_id, unnest([{'p': 'rdf:type', 'o': 'stock:Claim'}, {'p': 'stock:claimSubject', 'o': concat('stock/company/', subject_id)},
            {'p': 'stock:predicateCode', 'o': predicate_code},
            {'p': 'stock:claimObject', 'o': CASE WHEN object_id IS NULL THEN concat('stock:claimObjectValue/', claim_id) ELSE concat(CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'stock/concept/' ELSE 'stock/product/' END, object_id) END},
            {'p': 'stock:claimStatus', 'o': claim_status}, {'p': 'stock:businessStage', 'o': business_stage},
            {'p': 'stock:evidenceState', 'o': evidence_state}, {'p': 'stock:confidence', 'o': CAST(confidence AS VARCHAR)},
            {'p': 'stock:recordedAt', 'o': CAST(recorded_at AS VARCHAR)}, {'p': 'stock:validFrom', 'o': CAST(valid_from AS VARCHAR)},
            {'p': 'stock:validTo', 'o': CAST(valid_to AS VARCHAR)}, {'p': 'stock:supersededAt', 'o': CAST(superseded_at AS VARCHAR)}]) AS x
        FROM claim WHERE k % 13 <> 5) WHERE x.o IS NOT NULL""")
def g27(f: Frames) -> DataFrame:
    claims = f.claims().withColumn("subject_type", F.when(F.col("k") % 13 == 5, "Planet").otherwise("Company"))
    return g.claims_to_triples(claims)[0]


@query("g27_rejected_claims", "SELECT claim_id, 'Planet' AS subject_type FROM claim WHERE k % 13 = 5")
def g27b(f: Frames) -> DataFrame:
    claims = f.claims().withColumn("subject_type", F.when(F.col("k") % 13 == 5, "Planet").otherwise("Company"))
    return g.claims_to_triples(claims)[1].select("claim_id", "subject_type")


@query("g28_projection_status", """
    SELECT status, count(*) AS events, date_diff('second', min(created_at), TIMESTAMP '2002-01-01') AS oldest_seconds,
           max(processed_at) AS last_processed FROM outbox GROUP BY 1""")
def g28(f: Frames) -> DataFrame:
    return g.projection_status(f.outbox(), _now())


@query("g29_companies_of_product", f"""WITH {EDGES}
    SELECT DISTINCT subject_id AS company_id FROM bedge WHERE object_id = 6 AND predicate_code = 'PRODUCES'""")
def g29(f: Frames) -> DataFrame:
    return g.companies_of_product(g.business_edges(f.claims()), 6)
