"""What the text operators share: tables, staged Parquet in the cluster's shared folder, components."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators.staging import drop_path, shared_dir, stage  # noqa: F401  also for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(batches):
    """The batches; at their end a worker gives back what it holds without need, as it lives on for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_column(name: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) of one orderable type: one row (id, component) per vertex of an edge,
    component being the smallest id reachable.

    Large-star and small-star steps alternate until nothing changes. Each step pre-aggregates a minimum per
    vertex and joins it back, so that a vertex with very many edges is never gathered in one task (skewed join
    sides are split at run time), and each step is written to the shared folder, which ends the lineage.
    """
    spark = edges.sparkSession
    base = shared_dir(spark)
    canonical = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, n, mark = stage(canonical, f"{base}/0"), 0, None
    for n in range(1, max_rounds + 1):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.*").where("a <> b").distinct()
        before, current = current, stage(small, f"{base}/{n}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_path(spark, f"{base}/{n - 1}")
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
