"""Connected components of an undirected graph given as edges, by large-star and small-star steps."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the folder that ``spark.checkpoint.dir`` names. Where nothing is set, a
    temporary folder serves on a local master; elsewhere executors would not see it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges (u, v) with m: the smallest v of their u. The edges of a hub are dealt into 64
    parts, and m goes to each part that it has, so that no task gets all of them."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(64)).cast("int"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("part"))).alias("parts"))
    there = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("parts"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return dealt.join(least.select("u", "m", F.explode(there).alias("part")), ["u", "part"]).select("u", "v", "m")


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b); loops count as none.

    Each round hangs every node's larger neighbours, and then all of them, on its smallest one, so
    that a component becomes a star in a number of rounds that grows with the logarithm of its size."""
    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        stars = cut(_with_least(large).select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    tops = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
