"""Variance decomposition, rank statistics and spatial autocorrelation as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variance_components(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by..., k, n, ssb, ssw, sst: one-way analysis of variance in two aggregations.

    The first is partial on the map side; what it shuffles has a row for each group."""
    groups = rows.where(F.col(value).isNotNull()).groupBy(*by, group).agg(
        F.count(value).alias("gn"), F.avg(value).alias("gm"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("gv")
    )
    total = F.sum("gn")
    mean = F.sum(F.col("gn") * F.col("gm")) / total
    ssb = F.sum(F.col("gn") * F.col("gm") * F.col("gm")) - total * mean * mean
    ssw = F.sum(F.col("gn") * F.col("gv"))
    return groups.groupBy(*by).agg(F.count("*").alias("k"), total.alias("n"), ssb.alias("ssb"), ssw.alias("ssw")).withColumn("sst", F.col("ssb") + F.col("ssw"))


def eta2() -> Column:
    return F.try_divide(F.col("ssb"), F.col("sst"))


def omega2() -> Column:
    msw = F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))
    return F.try_divide(F.col("ssb") - (F.col("k") - 1) * msw, F.col("sst") + msw)


def chance_eta2() -> Column:
    return F.try_divide(F.col("k") - 1, F.col("n") - 1)


def group_means(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"))


def average_rank(value: str, *by: str, descending: bool = False) -> Column:
    """Rank with ties at their mean."""
    order = F.desc(value) if descending else F.asc(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (ties - 1) / 2.0


def spearman(rows: DataFrame, by: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    # for groups that a window can sort, such as clusters; ranks.spearman_of_rows is for rows
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__x", average_rank(x, *by)).withColumn("__y", average_rank(y, *by))
    return ranked.groupBy(*by).agg(F.corr("__x", "__y").alias(out))


def kendall(series: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by..., tau (tau-b; null where x or y is constant), s, n. For short series: the self-join
    has a row for each pair of points of a series."""
    points = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    other = points.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"))
    sign = F.signum(F.col("x2") - F.col("x")) * F.signum(F.col("y2") - F.col("y"))
    pairs = points.join(other, by) if by else points.crossJoin(other)
    sums = pairs.groupBy(*by).agg(
        F.sum(sign).alias("s"),
        F.count_if(F.col("x") != F.col("x2")).alias("tx"),
        F.count_if(F.col("y") != F.col("y2")).alias("ty"),
    )
    sizes = points.groupBy(*by).agg(F.count("*").alias("n"))
    out = sums.join(sizes, by) if by else sums.crossJoin(sizes)
    return out.select(*by, F.try_divide(F.col("s"), F.sqrt(F.col("tx").cast("double") * F.col("ty"))).alias("tau"), (F.col("s") / 2).cast("long").alias("s"), "n")


def kendall_exact_p(n: int, s: int) -> float:
    """Two-sided exact p-value without ties, from the distribution of inversions."""
    ways = [1]
    for m in range(2, n + 1):
        new = [0] * (len(ways) + m - 1)
        for i, w in enumerate(ways):
            for j in range(m):
                new[i + j] += w
        ways = new
    most = n * (n - 1) // 2
    inversions = (most - abs(s)) // 2
    return min(1.0, 2 * sum(ways[: inversions + 1]) / math.factorial(n))


def moran(values: DataFrame, links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """moran_i, n, w of ``values`` (id, z) over directed ``links`` (src, dst, w), for each ``by``."""
    by = by or []
    mean = values.agg(F.avg("z").alias("__m"), F.count("z").alias("n"), F.var_pop("z").alias("__v"))
    centred = values.crossJoin(F.broadcast(mean)).select("id", (F.col("z") - F.col("__m")).alias("zc"))
    joined = links.join(centred.withColumnsRenamed({"id": "src", "zc": "zi"}), "src").join(centred.withColumnsRenamed({"id": "dst", "zc": "zj"}), "dst")
    sums = joined.groupBy(*by).agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), F.sum("w").alias("w"))
    return sums.crossJoin(F.broadcast(mean)).select(*by, F.try_divide(F.try_divide(F.col("cross"), F.col("w")), F.col("__v")).alias("moran_i"), "n", "w")


def row_standardised(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The directed links (src, dst, w) with the weights of each src adding up to one. A node
    without links has no row, and so a lag of zero."""
    by = by or []
    sums = links.groupBy(*by, "src").agg(F.sum("w").alias("__s"))
    return links.join(sums, [*by, "src"]).withColumn("w", F.col("w") / F.col("__s")).drop("__s")


def upper_tail(z: Column) -> Column:
    """Chance of a standard normal above z, by a rational approximation (error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def moran_test(values: DataFrame, links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., n, moran_i, e_i, sd_i, z_score, p: Moran's I of ``values`` (id, z) over directed
    ``links`` (src, dst, w) and its test under randomisation, one-sided for a positive I.

    Nodes that no link starts from or leads to count in mean and variance of z, but not in n.
    """
    by = by or []
    mean = values.agg(F.avg("z").alias("__m"))
    centred = values.crossJoin(F.broadcast(mean)).select("id", (F.col("z") - F.col("__m")).alias("c"))
    at = links.join(centred.withColumnsRenamed({"id": "src", "c": "zi"}), "src").join(centred.withColumnsRenamed({"id": "dst", "c": "zj"}), "dst")
    cross = at.groupBy(*by).agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"), F.sum("w").alias("s0"))
    pairs = links.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(links.select(*by, F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    s1 = pairs.groupBy(*by, "a", "b").agg(F.sum("w").alias("w")).groupBy(*by).agg((F.sum(F.col("w") ** 2) / 2).alias("s1"))
    s2 = pairs.groupBy(*by, "a").agg(F.sum("w").alias("w")).groupBy(*by).agg(F.sum(F.col("w") ** 2).alias("s2"), F.count("*").cast("double").alias("n"))
    both = cross.join(s1, by).join(s2, by) if by else cross.crossJoin(s1).crossJoin(s2)
    return _judged(centred, both, by)


def moran_test_of_lags(centred: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """What ``moran_test`` gives for row-standardised links in both directions, from the centred
    values (c) of all nodes and, for each node with links, its value c, the number of its neighbours
    (degree), the sum of their values (lag) and that of the weights 1 / degree that they have (back)."""
    own = 1 / F.col("degree")
    both = rows.groupBy(*by).agg(
        F.sum(F.col("c") * F.col("lag") * own).alias("cross"), F.count("*").cast("double").alias("s0"), F.sum(own + own * F.col("back")).alias("s1"), F.sum((1 + F.col("back")) ** 2).alias("s2"), F.count("*").cast("double").alias("n")
    )
    return _judged(centred, both, by)


def _judged(centred: DataFrame, both: DataFrame, by: list[str]) -> DataFrame:
    """Moran's I and its test from the centred values (c) and the sums cross, s0, s1, s2 and n of the links."""
    moments = centred.agg(F.sum(F.col("c") ** 2).alias("m2"), F.sum(F.col("c") ** 4).alias("m4"), F.count("*").alias("all"))
    n, s0, s_1, s_2 = F.col("n"), F.col("s0"), F.col("s1"), F.col("s2")
    k = F.col("all") * F.col("m4") / (F.col("m2") * F.col("m2"))
    e = -1 / (n - 1)
    spread = (n * ((n * n - 3 * n + 3) * s_1 - n * s_2 + 3 * s0 * s0) - k * ((n * n - n) * s_1 - 2 * n * s_2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e
    out = both.crossJoin(F.broadcast(moments)).select(*by, n.cast("long").alias("n"), (n / s0 * F.col("cross") / F.col("m2")).alias("moran_i"), e.alias("e_i"), F.sqrt(spread).alias("sd_i"))
    out = out.withColumn("z_score", (F.col("moran_i") - F.col("e_i")) / F.col("sd_i"))
    return out.withColumn("p", upper_tail(F.col("z_score")))


def deterministic_rank(key: Column, by: list[str]) -> Column:
    """A permutation that any engine can repeat: rank by md5 of ``key``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(key.cast("string")), key))
