"""Ranks within groups that may hold most of the rows.

A window sorts each group in one task. Here the rows are range-partitioned by group and order,
so that a group is spread over tasks; a row's place is its place in its partition plus the number
of its group's rows in the partitions before, which comes from a table of one row for each
partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import cut


def positions(rows: DataFrame, by: list[str], order: list[Column | str], out: str = "pos") -> DataFrame:
    """Adds ``out``: the row's place, from 0, among those of its group in the order given. Rows
    that are equal in it get their places as they come."""
    keys = [F.asc(c) if isinstance(c, str) else c for c in order]
    # the row numbers are taken down before they are counted: ranges may differ from run to run
    placed = cut(rows.repartitionByRange(*[F.asc(c) for c in by], *keys).sortWithinPartitions(*[F.asc(c) for c in by], *keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    sizes = placed.groupBy(*by, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*by, "__part", (before - F.col("__first")).alias("__shift"))
    joined = placed.withColumn("__part", F.shiftright("__at", 33)).join(offsets, [*by, "__part"])
    return joined.withColumn(out, (F.col("__at") + F.col("__shift")).cast("long")).drop("__at", "__part", "__shift")


def ranked(rows: DataFrame, by: list[str], value: str, out: str, ties: str = "min") -> DataFrame:
    """The rows with a value, with ``out``: the value's rank in its group; ties share the lowest
    rank (``min``) or the mean of theirs (``average``)."""
    placed = positions(rows.where(F.col(value).isNotNull()), by, [value], "__pos")
    same = placed.groupBy(*by, value).agg(F.min("__pos").alias("__lo"), F.count("*").alias("__same"))
    rank = F.col("__lo") + 1 if ties == "min" else F.col("__lo") + (F.col("__same") + 1) / 2
    return placed.join(same, [*by, value]).withColumn(out, rank).drop("__pos", "__lo", "__same")


def percent_ranked(rows: DataFrame, by: list[str], value: str, out: str = "pct") -> DataFrame:
    """(rank - 1) / (n - 1) with ties at the lowest rank, 0 in a group of one."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n"))
    share = F.coalesce(F.try_divide(F.col("__r") - 1, F.col("__n") - 1), F.lit(0.0))
    return ranked(rows, by, value, "__r").join(sizes, by).withColumn(out, share).drop("__r", "__n")


def spearman_of_rows(rows: DataFrame, by: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Spearman's rho of two columns in each group, ranks with ties at their mean."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    return ranked(ranked(both, by, x, "__x", "average"), by, y, "__y", "average").groupBy(*by).agg(F.corr("__x", "__y").alias(out))
