"""Walks around given nodes: paths, subgraphs and neighbours.

A walk uses no edge twice and may follow edges either way. The edges that can
matter are stored first, ring by ring around the ends, so the edge table is read
once a ring; counts of walks are formed from counts per node, and only the walks
that are asked for are written out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir

PATH_RELATIONS = ["PRODUCES", "SUPPLIES_TO", "USES_TECHNOLOGY"]
SUBGRAPH_RELATIONS = [*PATH_RELATIONS, "TAGGED_AS"]
SUPPLY_RELATIONS = ["PRODUCES", "SUPPLIES_TO"]
SUBGRAPH_LABELS = ["Company", "Product", "Concept"]
MAX_HOPS = 4
MAX_PATHS = 300


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def adjacency(edges: DataFrame, rel_types: list[str], start: list | None = None) -> DataFrame:
    """Each edge as a step from either end, in one pass over the edges; a loop is one step.

    With ``start`` only the steps that leave these nodes; edges that touch none of
    them are left out by the scan.
    """
    if start is not None:
        near = edges.filter(F.col("src").isin(start) | F.col("dst").isin(start))
        return adjacency(near, rel_types).filter(F.col("src").isin(start))
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = F.when(F.col("src") == F.col("dst"), F.array(ends("src", "dst"))).otherwise(F.array(ends("src", "dst"), ends("dst", "src")))
    return edges.filter(F.col("rel_type").isin(rel_types)).select("edge_id", "rel_type", F.explode(both).alias("_s")).select(
        "edge_id", "_s.src", "_s.dst", "rel_type"
    )


def _stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _from(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Steps that leave one of the nodes in column ``dst`` of ``starts``."""
    return steps.join(starts.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("edge_id", "src", "dst", "rel_type")


def _first_steps(steps: DataFrame) -> DataFrame:
    return steps.select(
        F.col("dst").alias("_at"), F.array("src", "dst").alias("_nodes"), F.array("edge_id").alias("_edges"),
        F.array("rel_type").alias("_rels"),
    )


def _longer(walks: DataFrame, steps: DataFrame) -> DataFrame:
    return walks.join(steps, F.col("_at") == F.col("src")).filter(~F.array_contains("_edges", F.col("edge_id"))).select(
        F.col("dst").alias("_at"), F.array_append("_nodes", F.col("dst")).alias("_nodes"),
        F.array_append("_edges", F.col("edge_id")).alias("_edges"), F.array_append("_rels", F.col("rel_type")).alias("_rels"),
    )


def relation_paths(
    edges: DataFrame, src, dst, max_hops: int = 2, rel_types: list[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Edge-unique undirected paths between two nodes, shortest first.

    Walks start at both ends and meet in the middle. A second step is taken only
    to a node that the other end reaches in the steps that are left, so no walk
    is formed that cannot arrive. With a ``limit`` longer paths are formed only if
    the shorter ones are too few.
    """
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError("max_hops must be 1..4")
    steps = adjacency(edges, rel_types or PATH_RELATIONS)
    near = _stored(adjacency(edges, rel_types or PATH_RELATIONS, [src, dst]))
    ahead, back = near.filter(F.col("src") == src), near.filter(F.col("src") == dst)
    left, right = {1: _first_steps(ahead)}, {1: _first_steps(back)}
    if max_hops > 2:
        ring = _stored(_from(steps, near))
        ahead_2, back_2 = _from(ring, ahead), _from(ring, back)
        # Nodes that the other end reaches in one step, or in two where that many are left.
        targets = back.select("dst").unionByName(back_2.select("dst")) if max_hops > 3 else back.select("dst")
        left[2] = _longer(left[1], ahead_2.join(targets.distinct(), "dst", "left_semi"))
        if max_hops > 3:
            right[2] = _longer(right[1], back_2.join(ahead_2.select("dst").distinct(), "dst", "left_semi"))
    found = []
    for hops in range(1, max_hops + 1):
        if hops == 1:
            paths = left[1].filter(F.col("_at") == dst).select("_nodes", "_rels", "_edges")
        else:
            ends = right[hops // 2].select("_at", *[F.col(c).alias(f"{c}_b") for c in ("_nodes", "_edges", "_rels")])
            joined = left[(hops + 1) // 2].join(ends, "_at").filter(~F.arrays_overlap("_edges", "_edges_b"))
            paths = joined.select(
                F.concat("_nodes", F.slice(F.reverse("_nodes_b"), 2, MAX_HOPS)).alias("_nodes"),
                F.concat("_rels", F.reverse("_rels_b")).alias("_rels"), F.concat("_edges", F.reverse("_edges_b")).alias("_edges"),
            )
        found.append(paths.select(
            F.lit(hops).alias("hops"), F.col("_nodes").alias("path_nodes"), F.col("_rels").alias("path_rels"), F.col("_edges").alias("path_edges"),
        ))
        if limit is not None:
            found[-1] = _stored(found[-1].orderBy("path_nodes", "path_edges").limit(limit))
            if sum(part.count() for part in found) >= limit:
                break
    out = _union(found).orderBy("hops", "path_nodes", "path_edges")
    return out if limit is None else out.limit(limit)


def subgraph(
    nodes: DataFrame, edges: DataFrame, company_id, hops: int = 1, max_nodes: int = 100, max_paths: int = MAX_PATHS,
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` around one company.

    Up to ``max_nodes`` nodes in the order in which all walks reach them, and the
    edges between these from the first walk to each and the first ``max_paths``
    walks. ``truncated`` says that there are more nodes or more walks than that:
    walks are counted by degrees, the first walk to a node is a least pair of
    steps, and only the first ``max_paths`` walks are written out.
    """
    if hops not in (1, 2):
        raise ValueError("hops must be 1 or 2")
    allowed = nodes.filter(F.col("label").isin(SUBGRAPH_LABELS)).select(F.col("id").alias("dst"))
    steps = adjacency(edges, SUBGRAPH_RELATIONS).select("edge_id", "src", "dst", "rel_type")
    shown = lambda part: part.join(allowed.withColumn("_ok", F.lit(True)), "dst", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    first = _stored(shown(adjacency(edges, SUBGRAPH_RELATIONS, [company_id])).select("edge_id", F.col("dst").alias("a"), "_ok"))
    kind = steps.schema["src"].dataType
    start = F.lit(company_id).cast(kind)
    walk = lambda n, at, by: F.struct(F.lit(n).alias("hops"), F.array(*at).alias("nodes"), F.array(*by).alias("edges"))
    # Per neighbour: its number of steps from the company, and the first two of them.
    least = first.groupBy("a").agg(
        F.count(F.lit(1)).alias("n1"), F.min("edge_id").alias("e1"), F.max("_ok").alias("ok"), F.min(F.when(F.col("_ok"), F.col("edge_id"))).alias("_e"),
    )
    near = first.filter("_ok").groupBy("a").agg(F.min("edge_id").alias("e1"))
    seen = [near.select(F.col("a").alias("id"), walk(1, [start, F.col("a")], [F.col("e1")]).alias("walk"), F.lit(1).alias("pos"))]
    counts = first.filter("_ok").agg(F.count(F.lit(1)).alias("n"))
    listed = [
        first.filter("_ok").orderBy("a", "edge_id").limit(max_paths).select(walk(1, [start, F.col("a")], [F.col("edge_id")]).alias("walk"))
    ]
    if hops == 2:
        ring = _stored(shown(_from(steps, first.select(F.col("a").alias("dst")))).filter("_ok").select(F.col("src").alias("a"), F.col("dst").alias("m"), F.col("edge_id").alias("e2")))
        # A step back over the same edge is no walk: it leads to the company over an edge of the first step.
        back = F.col("m") == start
        per = ring.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.max(back).alias("home"))
        through = least.select("a", "n1", "e1", "ok").join(per, "a").withColumn(
            "walks", F.col("n1") * F.col("d") - F.when(F.col("home"), F.col("n1")).otherwise(0)
        ).filter("walks > 0")
        counts = counts.unionByName(through.agg(F.coalesce(F.sum("walks"), F.lit(0)).alias("n"))).agg(F.sum("n").alias("n"))
        away = ring.filter(~back).join(least.select("a", "e1"), "a").groupBy("m").agg(F.min(F.struct("a", "e1", "e2")).alias("s"))
        seen.append(away.select(F.col("m").alias("id"), walk(2, [start, F.col("s.a"), F.col("m")], [F.col("s.e1"), F.col("s.e2")]).alias("walk"), F.lit(2).alias("pos")))
        # A neighbour that is not shown itself is seen on its first walk of two steps, perhaps there and back.
        hidden = through.filter(~F.col("ok")).select("a", "n1", "e1")
        onward = ring.join(hidden, "a").filter((F.col("m") != start) | (F.col("e2") != F.col("e1"))).groupBy("a", "e1").agg(F.min(F.struct("m", "e2")).alias("s"))
        seen.append(onward.select(F.col("a").alias("id"), walk(2, [start, F.col("a"), F.col("s.m")], [F.col("e1"), F.col("s.e2")]).alias("walk"), F.lit(1).alias("pos")))
        # The first walks of two steps: neighbours in order until they have enough, and of each its first steps.
        some = through.orderBy("a").limit(max_paths).withColumn(
            "_before", F.coalesce(F.sum("walks").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).filter(F.col("_before") < max_paths).select("a")
        head = lambda part, *order: part.join(some, "a", "left_semi").withColumn(
            "_n", F.row_number().over(Window.partitionBy("a").orderBy(*order))
        ).filter(F.col("_n") <= max_paths + 1).drop("_n")
        pairs = head(first.select("a", F.col("edge_id").alias("e1")), "e1").join(head(ring, "m", "e2"), "a").filter("e1 <> e2")
        listed.append(pairs.orderBy("a", "m", "e1", "e2").limit(max_paths).select(walk(2, [start, F.col("a"), F.col("m")], [F.col("e1"), F.col("e2")]).alias("walk")))
    every = _union(seen)
    every = every.unionByName(every.agg(F.min("walk").alias("walk")).filter("walk IS NOT NULL").select(start.alias("id"), "walk", F.lit(0).alias("pos")))
    ordered = every.groupBy("id").agg(F.min(F.struct("walk", "pos")).alias("_first")).orderBy("_first").limit(max_nodes + 1)
    # From here at most ``max_nodes`` + 1 nodes, ``max_paths`` walks and one count remain.
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    kept = ordered.withColumns({
        "_n": F.row_number().over(Window.orderBy("_first")), "truncated": (total > max_nodes) | (counts.scalar() > max_paths),
    }).filter(F.col("_n") <= max_nodes)
    node_rows = kept.join(nodes.select("id", "label", "canonical_name"), "id", "left").select(
        "id", "label", "canonical_name", F.col("_n").alias("position"), "truncated"
    )
    ids = kept.select("id")
    used = _union(listed).orderBy("walk").limit(max_paths).select(F.explode("walk.edges").alias("edge_id")).union(
        kept.select(F.explode("_first.walk.edges").alias("edge_id"))
    ).distinct()
    extra = [c for c in ("claim_id",) if c in edges.columns]
    edge_rows = (
        edges.join(used, "edge_id", "left_semi")
        .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select("edge_id", "src", "dst", "rel_type", *extra)
    )
    return node_rows, edge_rows


def _counted(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"))


def supply_neighbors(edges: DataFrame, company_id, max_hops: int = 3) -> DataFrame:
    """Walks of up to three steps, as relation pattern and end node with their number.

    Counts of walks per node and pattern are carried from step to step; walks that
    would use an edge twice are taken off again in numbers. With f(x, r) the edges
    from the start to x and r the relations: a second step must not go back over
    the first, and a third neither over the second (f to its end) nor over the
    first (which joins the start and a neighbour).
    """
    if not 1 <= max_hops <= 3:
        raise ValueError("max_hops must be 1..3")
    steps = adjacency(edges, SUPPLY_RELATIONS)
    first = _stored(adjacency(edges, SUPPLY_RELATIONS, [company_id]))
    one = first.groupBy(F.col("dst").alias("x"), F.col("rel_type").alias("r1")).agg(F.count(F.lit(1)).alias("n"))
    start = F.lit(company_id).cast(steps.schema["src"].dataType)
    out = [one.select(F.col("x").alias("neighbor"), F.col("r1").alias("rels"), F.col("n").alias("paths"))]
    if max_hops > 1:
        ring = _stored(_from(steps, first))
        degree = ring.groupBy(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("rel_type").alias("r2")).agg(F.count(F.lit(1)).alias("d"))
        walked = one.join(degree, "x").select(F.col("y").alias("x"), "r1", "r2", (F.col("n") * F.col("d")).alias("n"))
        undone = one.select(start.alias("x"), "r1", F.col("r1").alias("r2"), (-F.col("n")).alias("n"))
        two = _counted(walked.unionByName(undone), "x", "r1", "r2").filter("n > 0")
        if max_hops > 2:
            two = _stored(two)
        out.append(two.select(F.col("x").alias("neighbor"), F.concat_ws(">", "r1", "r2").alias("rels"), F.col("n").alias("paths")))
    if max_hops > 2:
        outer = _from(steps, two.select(F.col("x").alias("dst"))).groupBy(
            F.col("src").alias("x"), F.col("dst").alias("y"), F.col("rel_type").alias("r3")
        ).agg(F.count(F.lit(1)).alias("d"))
        walked = two.join(outer, "x").select(F.col("y").alias("x"), "r1", "r2", "r3", (F.col("n") * F.col("d")).alias("n"))
        # Back over the second edge: to a neighbour w of the start, over any of its edges but the first one itself.
        out_of = degree.groupBy("x", "r2").agg(F.sum("d").alias("d"))
        same = lambda a, b: F.when(F.col(a) == F.col(b), 1).otherwise(0)
        second = one.join(out_of, "x").select(
            "x", "r1", "r2", F.col("r2").alias("r3"), (-(F.col("d") * F.col("n") - same("r1", "r2") * F.col("n"))).alias("n")
        )
        # Over the first edge again: start, a, start, a, or start, a, a (a loop), start.
        again = one.select("x", F.col("r1").alias("r2"), F.col("n").alias("m")).join(one, "x").select(
            "x", "r1", "r2", F.col("r1").alias("r3"), (-(F.col("n") * (F.col("m") - same("r1", "r2")))).alias("n")
        )
        loops = degree.filter("x = y").select("x", "r2", "d").join(one.filter(F.col("x") != start), "x").select(
            start.alias("x"), "r1", "r2", F.col("r1").alias("r3"), (-(F.col("n") * F.col("d"))).alias("n")
        )
        three = _counted(_union([walked, second, again, loops]), "x", "r1", "r2", "r3").filter("n > 0")
        out.append(three.select(F.col("x").alias("neighbor"), F.concat_ws(">", "r1", "r2", "r3").alias("rels"), F.col("n").alias("paths")))
    return _union(out)
