"""What groups contribute to the between variance, and how that changes between two periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contributions(panel: DataFrame, value: str = "z", group: str = "cluster") -> DataFrame:
    """period, group, n, m, w (share), d (distance from the field's mean), b = w d^2."""
    groups = panel.where(F.col(value).isNotNull()).groupBy("period", group).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    field = Window.partitionBy("period")
    total = F.sum("n").over(field)
    mean = F.sum(F.col("n") * F.col("m")).over(field) / total
    return groups.withColumn("w", F.col("n") / total).withColumn("d", F.col("m") - mean).withColumn("b", F.col("w") * F.col("d") * F.col("d"))


def split_change(parts: DataFrame, first: int, last: int, group: str = "cluster") -> DataFrame:
    """group, b_first, b_last, change, by_position, by_share for groups in both periods: the
    change of w d^2 splits into mean share times change of d^2, and change of share times mean d^2."""
    at = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = parts.where(F.col("period").isin(first, last)).groupBy(group).agg(*[at(c, p).alias(f"{c}{i}") for c in ("w", "d", "b") for i, p in enumerate((first, last))])
    q0, q1 = F.col("d0") * F.col("d0"), F.col("d1") * F.col("d1")
    return wide.where("w0 is not null and w1 is not null").select(
        group, F.col("b0").alias("b_first"), F.col("b1").alias("b_last"), (F.col("b1") - F.col("b0")).alias("change"),
        ((F.col("w0") + F.col("w1")) / 2 * (q1 - q0)).alias("by_position"), ((F.col("w1") - F.col("w0")) * (q0 + q1) / 2).alias("by_share"),
    )


def top_shares(changes: DataFrame, value: str, tops: tuple[int, ...], key: str = "cluster") -> DataFrame:
    """top, share: what the ``top`` largest values are of the sum. ``changes`` has a row per group."""
    ranked = changes.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(value), key)))
    sums = ranked.agg(F.sum(value).alias("__all"), *[F.sum(F.when(F.col("__r") <= k, F.col(value))).alias(f"t{k}") for k in tops])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("top"), F.try_divide(F.col(f"t{k}"), F.col("__all")).alias("share")) for k in tops])).alias("x")
    return sums.select(pairs).select("x.*")


def group_sums(panel: DataFrame, value: str = "z", group: str = "cluster") -> DataFrame:
    """period, group, n, s, q: number, sum and sum of squares, from which variance without any
    groups can be had without reading the panel again."""
    v = F.col(value)
    return panel.where(v.isNotNull()).groupBy("period", group).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def eta2_without(sums: DataFrame, dropped: DataFrame, by: list[str], group: str = "cluster") -> DataFrame:
    """by..., period, n, eta2 of the panel whose ``group_sums`` are ``sums`` without the groups
    that ``dropped`` (by..., group) names; field mean and weights are those of what is left. Periods
    that lose no group are there too; one that loses all has a null eta2."""
    parts = sums.withColumn("qb", F.col("s") * F.col("s") / F.col("n"))
    cols = ("n", "s", "q", "qb")
    whole = parts.groupBy("period").agg(*[F.sum(c).alias(c) for c in cols])
    out = dropped.distinct().join(parts, group).groupBy(*by, "period").agg(*[F.sum(c).alias(f"o{c}") for c in cols])
    variants = dropped.select(*by).distinct()
    left = variants.crossJoin(whole).join(out, [*by, "period"], "left")
    left = left.select(*by, "period", *[(F.col(c) - F.coalesce(F.col(f"o{c}"), F.lit(0))).alias(c) for c in cols])
    middle = F.col("s") * F.col("s") / F.col("n")
    return left.select(*by, "period", "n", F.when(F.col("n") > 0, F.try_divide(F.col("qb") - middle, F.col("q") - middle)).alias("eta2"))


def matched_draws(sizes: DataFrame, left_out: DataFrame, n_draws: int, nearest: int = 10, group: str = "cluster") -> DataFrame:
    """draw, group: for each group of ``left_out`` one of the ``nearest`` of its size among the
    others, without replacement, in each draw. ``sizes`` (group, n) has a row for each group; which
    of the nearest is taken is told by md5 of the draw's and the step's number."""
    session = sizes.sparkSession
    wanted = sizes.join(left_out, group, "left_semi").orderBy(group).collect()  # groups to leave out
    pool = sizes.join(left_out, group, "left_anti")
    grid = session.range(1, n_draws + 1).select(F.col("id").alias("draw"))
    free = grid.crossJoin(F.broadcast(pool)).select("draw", group, "n")
    taken = None
    for step, r in enumerate(wanted):
        near = Window.partitionBy("draw").orderBy(F.abs(F.col("n") - r["n"]), group)
        chance = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(f"-{step}"))), 1, 7), 16, 10).cast("long")
        left = F.least(F.lit(nearest), F.count("*").over(Window.partitionBy("draw")))
        pick = free.withColumn("__i", F.row_number().over(near)).withColumn("__left", left).where(F.col("__i") == chance % F.col("__left") + 1).select("draw", group)
        taken = pick if taken is None else taken.unionByName(pick)
        free = free.join(pick, ["draw", group], "left_anti")
    return taken if taken is not None else free.select("draw", group).limit(0)
