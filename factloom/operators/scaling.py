"""Helpers that keep ordered work spread over tasks when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir


def split_running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list, values: dict[str, Column]
) -> DataFrame:
    """Running sums per key, inclusive of the row, without a task per key.

    ``bucket`` must grow with ``order``. Each (key, bucket) runs its own window;
    the sums of earlier buckets come from one pre-aggregated row per bucket.
    """
    staged = df.withColumn("_bucket", bucket).withColumns(
        {f"_v_{name}": value for name, value in values.items()}
    )
    totals = staged.groupBy(*keys, "_bucket").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = staged.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    out = out.join(base, [*keys, "_bucket"])
    return out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_b_{n}") for n in values}).drop(
        "_bucket", *[f"_{p}_{n}" for n in values for p in "vrb"]
    )


def dense_index(df: DataFrame, order: list, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total order.

    A range shuffle sorts the rows over many tasks; the checkpoint fixes that
    layout, so that the per-partition counts and the positions agree even when
    an executor is lost. Only one count per partition is joined back.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_mid", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1) + 1)
        .drop("_part", "_mid", "_offset")
    )


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames side by side, as scalar subqueries rather than joins."""
    return first.select(
        "*", *[other.select(c).scalar().alias(c) for other in others for c in other.columns]
    )


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """Join in which one key may hold most rows of the left side.

    The left rows of a key are dealt into up to ``salts`` shares by a hash of ``by``.
    Only one row per share meets the right side, so that side is copied per share
    of a key that needs it and not per row, and no share is more than a part of a key.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    shares = salted.select(*keys, "_salt").distinct().join(right, keys)
    return salted.join(shares, [*keys, "_salt"], how).drop("_salt")


#: Rows of a block in which neighbours and running values are formed.
BLOCK = 10_000


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with their position in the order of keys and order, and the number of their block."""
    return dense_index(df, [*keys, *order], "_idx").withColumn("_block", F.expr(f"(_idx - 1) div {BLOCK}"))


def neighbour(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, ahead: bool = False) -> DataFrame:
    """Adds a column of the row before (or ahead) within the keys; null at the end of a key.

    Rows are put in one order and cut into blocks of equal size; the row beyond the
    edge of a block is carried from the block beside it. So no key is a task, and
    a block without a row of the key, or an empty table, needs no case of its own.
    """
    placed = in_order(df, keys, order)
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(column).alias("v"))
    inside = Window.partitionBy("_block").orderBy("_idx")
    edge, shift = (F.min_by, -1) if ahead else (F.max_by, 1)
    carried = placed.groupBy("_block").agg(edge(row, "_idx").alias("_carried")).withColumn("_block", F.col("_block") + shift)
    beside_it = (F.lead if ahead else F.lag)(row).over(inside)
    joined = placed.withColumn("_near", beside_it).join(carried, "_block", "left").withColumn("_near", F.coalesce("_near", "_carried"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(f"_near.k{i}").eqNullSafe(F.col(c))
    return joined.withColumn(name, F.when(F.col("_near").isNotNull() & same, F.col("_near.v"))).drop("_idx", "_block", "_near", "_carried")


def running_max(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Adds the greatest value of a column in the rows of the key before this one; keeps ``_idx`` and ``_block``.

    Within a block by a window, and over the blocks before by one row per key and block.
    """
    placed = in_order(df, keys, order)
    earlier = (Window.unboundedPreceding, -1)
    tops = placed.groupBy(*keys, "_block").agg(F.max(column).alias("_top"))
    base = tops.withColumn("_base", F.max("_top").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(*earlier))).drop("_top")
    inside = F.max(column).over(Window.partitionBy(*keys, "_block").orderBy("_idx").rowsBetween(*earlier))
    return placed.withColumn("_in", inside).join(base, [*keys, "_block"]).withColumn(name, F.greatest("_in", "_base")).drop("_in", "_base")
