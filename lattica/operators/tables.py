"""Operators on any table: counts, shapes, cuts and series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import ranks


def counts_if(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """by..., and for each condition the number of rows that meet it; nulls don't."""
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def distinct_if(rows: DataFrame, by: list[str], what: str, **conditions: Column) -> DataFrame:
    """by..., n, and for each condition the number of different values of ``what`` among the rows
    that meet it."""
    return rows.groupBy(*by).agg(F.count_distinct(what).alias("n"), *[F.count_distinct(F.when(c, F.col(what))).alias(n) for n, c in conditions.items()])


def first_and_last(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by..., first_value, last_value: the value where ``order`` is least and most."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def group_quantiles(rows: DataFrame, by: list[str], value: str, **shares: float) -> DataFrame:
    """by..., and exact quantiles, linear between neighbours. An aggregate holds the different
    values of a group and their counts; ``vectors.pair_distribution`` is for more than that."""
    return rows.groupBy(*by).agg(*[F.percentile(value, p).alias(n) for n, p in shares.items()])


def skewness(rows: DataFrame, by: list[str], value: str, beyond: float) -> DataFrame:
    """by..., skew: mean((x - m)^3) / s^3 with the sample deviation s, and beyond: the share of values
    farther than so much from zero."""
    x = F.col(value)
    n, s1, s2, s3 = F.count(x), F.sum(x), F.sum(x * x), F.sum(x * x * x)
    mean = s1 / n
    third = (s3 - 3 * mean * s2 + 3 * mean * mean * s1) / n - mean * mean * mean
    return rows.groupBy(*by).agg((third / F.pow(F.stddev_samp(x), F.lit(3.0))).alias("skew"), F.avg((F.abs(x) > beyond).cast("double")).alias("beyond"))


def running_share(rows: DataFrame, by: list[str], value: str, *ties: str) -> DataFrame:
    """Adds share: the sum of the values down to this one, the largest first. For groups that a
    window can sort."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("share", F.sum(value).over(w))


def change_at(rows: DataFrame, by: list[str], value: str, period: str, at: int, around: tuple[int, ...]) -> DataFrame:
    """by..., change: how far, in percent, the mean at one period lies off the mean over others."""
    mid, side = F.avg(F.when(F.col(period) == at, F.col(value))), F.avg(F.when(F.col(period).isin(*around), F.col(value)))
    return rows.groupBy(*by).agg((100 * F.try_divide(mid - side, side)).alias("change"))


def ends_change(rows: DataFrame, by: list[str], value: str, period: str, first: int, last: int) -> DataFrame:
    """by..., change: the mean at the last period less that at the first."""
    at = lambda p: F.avg(F.when(F.col(period) == p, F.col(value)))
    return rows.groupBy(*by).agg((at(last) - at(first)).alias("change"))


def flagged(rows: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """Adds whether the row's key is one of ``members``, without multiplying rows."""
    known = members.select(key).distinct().withColumn("__there", F.lit(True))
    return rows.join(known, key, "left").withColumn(out, F.coalesce("__there", F.lit(False))).drop("__there")


def in_all(rows: DataFrame, key: str, period: str, n: int) -> DataFrame:
    """key, n of the keys that are there in ``n`` periods: the intersection of the periods' sets."""
    return rows.groupBy(key).agg(F.count_distinct(period).alias("n")).where(F.col("n") == n)


def two_sided_difference(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """side, n: numbers of different rows that only the one or only the other table has."""
    only = lambda x, y, name: x.subtract(y).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return only(a, b, names[0]).unionByName(only(b, a, names[1]))


def with_ties(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The rows whose value is among the k largest of the group, ties included. The group limit
    prunes before the shuffle."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("__r") <= k).drop("__r")


def best_share(rows: DataFrame, share: float, *order: Column | str) -> DataFrame:
    """The first floor(share n) rows in the order given; ranked by ranges, so no task sorts all."""
    placed = ranks.positions(rows.withColumn("__all", F.lit(0)), ["__all"], list(order), "__pos")
    n = rows.agg(F.count("*").alias("__n"))
    return placed.crossJoin(F.broadcast(n)).where(F.col("__pos") < F.floor(F.col("__n") * share)).drop("__all", "__pos", "__n")


def with_group(rows: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """Adds aggregates over the group to each of its rows: one row for each group is joined, so a
    large group isn't gathered as by a window."""
    totals = rows.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return rows.join(F.broadcast(totals) if not by else totals, by) if by else rows.crossJoin(F.broadcast(totals))


def long_series(rows: DataFrame, keys: list[str], measures: dict[str, Column], name: str = "measure", value: str = "v") -> DataFrame:
    """keys..., measure, value: one row for each measure of a row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias(name), c.cast("double").alias(value)) for n, c in measures.items()]))
    return rows.select(*keys, pairs.alias("__x")).select(*keys, f"__x.{name}", f"__x.{value}")


def movers(changes: DataFrame, value: str, k: int, digits: int = 10) -> DataFrame:
    """The rows with the k largest and k smallest changes, ties included, with side up or down."""
    order = F.round(value, digits)
    ranked = changes.withColumn("__up", F.rank().over(Window.orderBy(order.desc()))).withColumn("__down", F.rank().over(Window.orderBy(order)))
    kept = ranked.where((F.col("__up") <= k) | (F.col("__down") <= k))
    return kept.withColumn("side", F.when(F.col("__up") <= k, "up").otherwise("down")).drop("__up", "__down")


def trend(series: DataFrame, kendall: Callable[..., DataFrame], first: int, last: int) -> DataFrame:
    """measure, tau, start_value, end_value, n of a long series (measure, period, v)."""
    tau = kendall(series, ["measure"], "period", "v").select("measure", "tau")
    at = lambda p: F.max(F.when(F.col("period") == p, F.col("v")))
    ends = series.groupBy("measure").agg(at(first).alias("start_value"), at(last).alias("end_value"), F.count_distinct("period").alias("n"))
    return ends.join(tau, "measure").select("measure", "tau", "start_value", "end_value", "n")


def percentages(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, percent of all rows."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("__all")))).withColumn("percent", 100.0 * F.col("n") / F.col("__all")).drop("__all")


def profile(rows: DataFrame, value: str, key: str) -> DataFrame:
    """n, lo, hi, n_null, n_keys of one column and its key."""
    return rows.agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value).isNull()).alias("n_null"), F.count_distinct(key).alias("n_keys"))
