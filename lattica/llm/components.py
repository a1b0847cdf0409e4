"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable, with_totals


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges with m: the smallest v of their u. The edges of a hub are dealt into parts."""
    return with_totals(edges, "u", "v", {"m": F.min("v")})


def components(edges: DataFrame, rows: int | None = None, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for each node of the edges ``a``, ``b``.

    A step replaces each edge by one to the smallest neighbour, so that a component becomes a
    star round its smallest node; the number of rounds grows with the logarithm of its size. A
    node's smallest neighbour is found and handed back by parts of its edges, so that those of a
    hub are never in one task. A loop counts as no edge. No edges give no rows; the order and
    repetition of edges play no part. ``rows`` says about how many edges to expect.
    """
    stars = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), rows)
    seen = None
    for _ in range(most_rounds):
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = durable(small.select("e.u", "e.v").where("u <> v").distinct(), state[0])
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
