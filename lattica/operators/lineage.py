"""How clusters go on from one period to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flows(membership: DataFrame) -> DataFrame:
    """period, old, new, inter, n_old, n_new, share_old, share_new, jaccard of ``membership``
    (entity, period, cluster): members that two clusters of consecutive periods have in common.

    ``share_old`` is of all members of the old cluster that are there in the next period too."""
    later = membership.select("entity", (F.col("period") - 1).alias("period"), F.col("cluster").alias("new"))
    both = membership.select("entity", "period", F.col("cluster").alias("old")).join(later, ["entity", "period"])
    inter = both.groupBy("period", "old", "new").agg(F.count("*").alias("inter"))
    n_old, n_new = F.sum("inter").over(Window.partitionBy("period", "old")), F.sum("inter").over(Window.partitionBy("period", "new"))
    return (
        inter.withColumn("n_old", n_old)
        .withColumn("n_new", n_new)
        .withColumn("share_old", F.col("inter") / F.col("n_old"))
        .withColumn("share_new", F.col("inter") / F.col("n_new"))
        .withColumn("jaccard", F.col("inter") / (F.col("n_old") + F.col("n_new") - F.col("inter")))
    )


def best_successors(edges: DataFrame, by: str = "share_old") -> DataFrame:
    """The edge of each period's cluster with the highest share; ties to the smaller successor."""
    rank = F.row_number().over(Window.partitionBy("period", "old").orderBy(F.desc(by), "new"))
    return edges.withColumn("__r", rank).where("__r = 1").drop("__r")


def chains(successors: DataFrame, first: int, last: int) -> DataFrame:
    """line, period, cluster, link: chains from the clusters of ``first``; ``link`` is the share
    with which the cluster was reached. One join for each period."""
    steps = successors.select("period", F.col("old").alias("cluster"), "new", "share_old")
    now = steps.where(F.col("period") == first).select(F.col("cluster").alias("line"), "period", "cluster", F.lit(None).cast("double").alias("link")).distinct()
    out = now
    for _ in range(first, last):
        now = now.join(steps, ["period", "cluster"]).select("line", (F.col("period") + 1).alias("period"), F.col("new").alias("cluster"), F.col("share_old").alias("link"))
        out = out.unionByName(now)
    return out


def intact(lines: DataFrame, least: float) -> DataFrame:
    """Adds intact: whether every link so far reached ``least``; once broken, a line stays so."""
    w = Window.partitionBy("line").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("intact", F.min(F.when(F.col("link").isNull() | (F.col("link") >= least), 1).otherwise(0)).over(w) == 1)
