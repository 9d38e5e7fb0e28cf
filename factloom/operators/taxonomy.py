"""Taxonomies as edges ``(child, parent)``: closure, cycles and shape rules.

Most nodes are leaves below a few parents. Steps are joined on the parents alone,
and the rows below one parent are spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.scaling import spread_join
from factloom.session import ensure_checkpoint_dir


def _stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _nearest(parts: list[DataFrame]) -> DataFrame:
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("child", "ancestor").agg(F.min("hops").alias("hops"))


def _up(edges: DataFrame, reach: DataFrame, hops: int) -> DataFrame:
    """One step below ``reach(child, ancestor)``: children of its nodes, with the ancestors of these."""
    ends = reach.select(F.col("child").alias("parent"), "ancestor")
    return spread_join(edges, ends, ["parent"], ["child"]).select("child", "ancestor", F.lit(hops).alias("hops"))


def taxonomy_closure(taxonomy: DataFrame, max_hops: int = 4, to: DataFrame | None = None) -> DataFrame:
    """Ancestors per node with the fewest hops, 0..max_hops.

    ``to(ancestor)`` asks for these ancestors only; the walk then goes down from
    them. Else the closure of the inner nodes, which are few, is formed first, and
    each node takes that of its parents.
    """
    edges = _stored(taxonomy.select("child", "parent").distinct())
    nodes = edges.select("child").union(edges.select("parent")).distinct()
    if to is not None:
        own = nodes.join(to.select(F.col("ancestor").alias("child")).distinct(), "child", "left_semi")
        levels = [own.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("hops"))]
        for hop in range(1, max_hops + 1):
            levels.append(_stored(_up(edges, levels[-1], hop).distinct()))
        return _nearest(levels)
    inner = edges.select(F.col("parent").alias("child")).distinct()
    between = _stored(edges.join(inner, "child", "left_semi"))
    level = inner.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("hops"))
    levels = [level]
    for hop in range(1, max_hops):
        level = _up(between, level, hop).distinct()
        levels.append(level)
    above = _stored(_nearest(levels)).withColumnRenamed("child", "parent")
    below = spread_join(edges, above, ["parent"], ["child"]).select("child", "ancestor", (F.col("hops") + 1).alias("hops"))
    return _nearest([nodes.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("hops")), below])


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without a parent or without a child are taken off until nothing changes."""
    size = edges.count()
    while size:
        below = edges.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        tops = below.select(F.col("child").alias("parent")).distinct()
        left = _stored(spread_join(below, tops, ["parent"], ["child"]).select("child", "parent"))
        now = left.count()
        if now == size:
            break
        edges, size = left, now
    return edges


def _spread(labels: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The least label of each node and of all that lead to it, ``source`` to ``target``, until nothing changes."""
    labels = _stored(labels)
    while True:
        passed = edges.join(labels.withColumnRenamed("id", source), source).select(F.col(target).alias("id"), "label")
        found = _stored(labels.unionByName(passed).groupBy("id").agg(F.min("label").alias("label")))
        changed = found.join(labels.withColumnRenamed("label", "_before"), "id").filter("label <> _before").limit(1).count()
        labels = found
        if not changed:
            return labels


def cyclic_nodes(taxonomy: DataFrame) -> DataFrame:
    """(id, cycle): nodes that lead back to themselves, with the smallest node of their strong component.

    What is left after peeling is small in a sound taxonomy. There the least node
    that reaches each node is its colour; the nodes that reach the least of their
    colour within it are its strong component. Components are taken off, and the
    rest is peeled and coloured again.
    """
    edges = _stored(taxonomy.select("child", "parent").distinct())
    found = [edges.filter("child = parent").select(F.col("child").alias("id"), F.col("child").alias("cycle"))]
    edges = _peeled(_stored(edges.filter("child <> parent")))
    while not edges.isEmpty():
        ids = edges.select(F.col("child").alias("id")).union(edges.select("parent")).distinct()
        colours = _spread(ids.withColumn("label", F.col("id")), edges, "child", "parent")
        paint = lambda side: colours.select(F.col("id").alias(side), F.col("label").alias(f"_{side}"))
        same = _stored(edges.join(paint("child"), "child").join(paint("parent"), "parent").filter("_child = _parent").select("child", "parent", F.col("_child").alias("colour")))
        # Backwards from the least node of each colour, within the colour.
        reached = _stored(colours.filter("id = label").select("id", "label"))
        while True:
            more = same.join(reached.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id"), F.col("colour").alias("label"))
            wider = _stored(reached.unionByName(more).distinct())
            if wider.count() == reached.count():
                break
            reached = wider
        sizes = reached.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.append(reached.join(sizes, "label").select("id", F.col("label").alias("cycle")))
        done = reached.select("id")
        edges = _peeled(_stored(
            edges.join(done.withColumnRenamed("id", "child"), "child", "left_anti").join(done.withColumnRenamed("id", "parent"), "parent", "left_anti")
        ))
    return reduce(lambda a, b: a.unionByName(b), found).groupBy("id").agg(F.min("cycle").alias("cycle"))


def taxonomy_violations(taxonomy: DataFrame, labels: DataFrame, schemes: DataFrame) -> DataFrame:
    """``labels(id, lang, label)``, ``schemes(id, scheme)``; one row per node and broken rule."""
    own = taxonomy.filter(F.col("child") == F.col("parent")).select(
        F.col("child").alias("id"), F.lit("self_parent").alias("rule")
    )
    cycle = cyclic_nodes(taxonomy).select("id", F.lit("cycle").alias("rule"))
    ids = schemes.select("id").union(
        taxonomy.select(F.col("child").alias("id"))
    ).distinct()
    scheme_count = schemes.groupBy("id").agg(F.count_distinct("scheme").alias("n"))
    scheme = ids.join(scheme_count, "id", "left").filter(F.coalesce("n", F.lit(0)) != 1).select(
        "id", F.lit("one_scheme").alias("rule")
    )
    doubled = labels.groupBy("id", "lang").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "id", F.lit("one_label_per_language").alias("rule")
    )
    unlabelled = ids.join(labels.select("id"), "id", "left_anti").select(
        "id", F.lit("label_required").alias("rule")
    )
    return reduce(lambda a, b: a.unionByName(b), [own, cycle, scheme, doubled, unlabelled]).distinct()
