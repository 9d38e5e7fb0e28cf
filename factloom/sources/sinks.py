"""Parquet layers: write, staged swap, manifest."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_layer(
    df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None, writers: int = 16
) -> None:
    """Append, or replace only the partitions present in ``df``.

    The rows of one partition are dealt to ``writers`` tasks, so that a large one is not a task's.
    """
    writer = df.write.mode(mode)
    if partition_by:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(writers)))
        writer = df.write.mode(mode).partitionBy(*partition_by)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def replace_layer(df: DataFrame, path: str) -> None:
    """Full overwrite through a staged folder, so that ``df`` may read ``path``.

    The new version is complete before the old one is moved aside; readers that
    fail in between can be pointed at the kept ``.old`` folder.
    """
    spark = df.sparkSession
    stamp = f"{int(time.time())}-{uuid.uuid4().hex[:8]}"
    staged, retired = f"{path}.staged-{stamp}", f"{path}.old-{stamp}"
    df.write.mode("errorifexists").parquet(staged)
    fs, target, jvm = _filesystem(spark, path)
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(retired))
    fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target)
    fs.delete(jvm.org.apache.hadoop.fs.Path(retired), True)


def _publish(rows: DataFrame, root: str, commit_id: str) -> None:
    """Write the manifest of a commit beside the others, and move it into place as the last step."""
    spark = rows.sparkSession
    staged, target = f"{root}/staged-manifests/{uuid.uuid4().hex}", f"{root}/manifests/{commit_id}"
    rows.coalesce(1).write.parquet(staged)
    fs, place, jvm = _filesystem(spark, target)
    fs.mkdirs(place.getParent())
    if fs.exists(place):
        # The same commit again: its manifest says the same, so the one in place may stay.
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    elif not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), place):
        raise OSError(f"manifest {target} not moved into place")


def write_commit(frames: Mapping[str, DataFrame], root: str, commit_id: str) -> str:
    """Several outputs as one commit (V6): data first, then one manifest, moved into place last.

    Readers take only rows whose commit has a manifest, so a job that dies half way
    leaves nothing visible and a replay of the same ``commit_id`` rewrites it.
    """
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{root}/data/{name}/commit=id-{commit_id}")
    spark = next(iter(frames.values())).sparkSession
    names = spark.createDataFrame([(f"id-{commit_id}", name) for name in frames], "commit string, frame string")
    _publish(names, root, commit_id)
    return f"{root}/manifests/{commit_id}"


def read_commits(spark: SparkSession, root: str, frame: str) -> DataFrame:
    """All committed rows of one output; the manifests are joined, not listed."""
    done = spark.read.schema("commit string, frame string").parquet(f"{root}/manifests/*")
    rows = spark.read.parquet(f"{root}/data/{frame}")
    return rows.join(done.filter(F.col("frame") == frame).select("commit").distinct(), "commit", "left_semi").drop("commit")


def write_snapshot(df: DataFrame, path: str, date_col: str = "snapshot_date") -> None:
    """All dates of ``df`` commit together; each replaces what was there of its date.

    The rows are one commit of a few files ordered by date, whatever the number of
    dates. Its manifest says which dates it holds and is moved into place last;
    for each date the newest commit counts.
    """
    commit = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    data = f"{path}/data/commit=id-{commit}"
    df.repartitionByRange(date_col, F.xxhash64(*df.columns)).sortWithinPartitions(date_col).write.parquet(data)
    written = df.sparkSession.read.schema(df.schema).parquet(data)
    _publish(written.select(date_col).distinct().withColumn("commit", F.lit(f"id-{commit}")), path, commit)


def read_snapshot(spark: SparkSession, path: str, date_col: str = "snapshot_date") -> DataFrame:
    """The rows of the newest commit of each date."""
    newest = spark.read.parquet(f"{path}/manifests/*").groupBy(date_col).agg(F.max("commit").alias("commit"))
    return spark.read.parquet(f"{path}/data").join(newest, [date_col, "commit"], "left_semi").drop("commit")


def build_manifest(layers: Mapping[str, DataFrame], version: str) -> DataFrame:
    """Row count and version per layer."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("layer"), "rows", F.lit(version).alias("version")
        )
        for name, frame in layers.items()
    ]
    manifest = parts[0]
    for part in parts[1:]:
        manifest = manifest.unionByName(part)
    return manifest
