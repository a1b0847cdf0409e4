"""Density clusters: groups of rows that lie close to many others, the rest being noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import vectors
from lattica.operators.components import connected_components

NOISE = -1


def density_clusters(rows: DataFrame, k: int = 10, least: int = 30, reach: float | None = None, share: float = 0.5) -> DataFrame:
    """id, cluster of ``rows`` (id, e unit): the cluster's smallest id, or -1 for noise.

    A row's core distance is that to its k-th neighbour; two neighbours' mutual reachability is
    the largest of their core distances and their own distance. Neighbours whose mutual
    reachability is at most ``reach`` (by default the quantile ``share`` of the core distances)
    are linked, and the components of ``least`` rows or more are the clusters: those of the
    single-linkage tree of mutual reachability, cut at one height.
    """
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("sim")))
    near = vectors.nearest(rows, k).select("id", "neighbor", "rank", far.alias("d"))
    core = near.groupBy("id").agg(F.max("d").alias("core"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    if reach is None:
        reach = core.agg(F.percentile_approx("core", share, 10_000)).first()[0]
    linked = near.join(core, "id").join(core.select(F.col("id").alias("neighbor"), F.col("core").alias("other")), "neighbor")
    mutual = F.greatest("core", "other", "d")
    found = connected_components(linked.where(mutual <= F.lit(reach)).select(F.col("id").alias("a"), F.col("neighbor").alias("b")))
    large = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    named = found.join(large, "component").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return rows.select("id").join(named, "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
