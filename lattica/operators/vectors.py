"""Dense vectors: norms, axes, exact neighbours and pairs in blocks, spectra, alignment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import pairs, ranks
from lattica.operators.components import cut

#: Vectors of one block: the product of two is what a task works out at once.
BLOCK = 2048


def doubles(vec: Column | str) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column | str) -> Column:
    return F.sqrt(dot(vec, vec))


def unit(vec: Column | str) -> Column:
    length = norm(vec)
    return F.transform(vec, lambda x: F.try_divide(x, length))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def residual(vec: Column | str, axis: Column | str) -> Column:
    """The vector without its part along the unit axis."""
    along = dot(vec, axis)
    return F.zip_with(vec, axis, lambda x, w: x - along * w)


def mean_vector(rows: DataFrame, by: list[str], vec: str = "e") -> DataFrame:
    """by..., e: component means, partial on the map side."""
    parts = rows.select(*by, F.posexplode(vec).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("e"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def nearest(rows: DataFrame, k: int, queries: DataFrame | None = None, other: str | None = None, along: list[float] | None = None) -> DataFrame:
    """id, neighbor, rank, sim: the k most similar other vectors of ``rows`` (id, e unit) for each
    of ``queries`` (default: all), exactly; ties to the smaller id. With ``other``, the column of a
    second vector as long as ``e``, also the inner product of the two in it. With ``along``, a vector
    (if shorter, its other components are 0), also length and along: the length of the way from the
    vector to its neighbour, and the inner product of that way with ``along``.

    The vectors are sent to all executors, and each task keeps the k best of its queries: what is
    shuffled and written grows as rows and results. The table is written down.
    """
    return pairs.nearest(rows, k, queries, other, along, BLOCK)


def close_pairs(rows: DataFrame, above: float) -> DataFrame:
    """src < dst, sim of all pairs of ``rows`` (id, e unit) with sim > ``above``. It has as many rows
    as there are such pairs: what only counts them or adds them up takes ``linked_sums``."""
    return pairs.close_pairs(rows, above, BLOCK)


def linked_sums(rows: DataFrame, above: list[float], module: str | None = None, values: list[str] | None = None) -> DataFrame:
    """id, tau, degree, weight, inside, first, lag_...: for each tau of ``above`` and each vector of
    ``rows`` (id, e unit) with another one more similar than tau: how many there are, the sum of the
    similarities, that of those with an equal number ``module``, the smallest id, and the sum of each
    of the columns ``values`` over them. No pair leaves a task. The table is written down."""
    return pairs.linked_sums(rows, above, BLOCK, module, values)


def linked_forest(rows: DataFrame, above: float) -> DataFrame:
    """a, b: of the pairs of ``rows`` (id, e unit) with sim > ``above`` as many as connect the same
    vectors: no slice of the rows gives more pairs than there are vectors."""
    return pairs.linked_forest(rows, above, BLOCK)


def second_moments(rows: DataFrame, vec: str = "e") -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum and number of the vectors: a task sends one d x d matrix, whose
    cells are added up by place."""

    def partial(batches):
        total, first, n = None, None, 0
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf[vec])
                total, first, n = (x.T @ x if total is None else total + x.T @ x), (x.sum(0) if first is None else first + x.sum(0)), n + len(x)
        if n:
            values = np.concatenate((total.ravel(), first, [n]))
            yield pd.DataFrame({"i": np.arange(len(values)), "x": values})

    got = rows.select(vec).mapInPandas(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    d = (math.isqrt(4 * len(got) - 3) - 1) // 2
    return got[: d * d].reshape(d, d), got[d * d : -1], int(got[-1])


def spectrum(rows: DataFrame, vec: str = "e") -> np.ndarray:
    """Eigenvalues of the covariance, largest first."""
    m, s, n = second_moments(rows, vec)
    return np.linalg.eigvalsh((m - np.outer(s, s) / n) / (n - 1))[::-1]


def orthogonal_map(pairs: DataFrame, src: str, trg: str) -> np.ndarray:
    """The orthogonal matrix that turns the unit ``src`` vectors into the ``trg`` ones best."""
    both = pairs.select(F.concat(unit(src), unit(trg)).alias("e"))
    m, _, _ = second_moments(both)
    d = len(m) // 2
    u, _, v = np.linalg.svd(m[:d, d:])
    return u @ v


def rotated(rows: DataFrame, q: np.ndarray, vec: str = "e") -> DataFrame:
    """The rows with ``vec`` turned by ``q``."""

    def turn(batches):
        for pdf in batches:
            if len(pdf):
                pdf[vec] = list(_stack(pdf[vec]) @ q)
            yield pdf

    return rows.mapInPandas(turn, rows.schema)


def suppress(anchors: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``anchors`` (id, score) that stay when, best first, an anchor stays unless it is
    linked (a, b) with one that has stayed; of equal scores the smaller id comes first.

    In each round those stay that no better anchor still open is linked with, and what is linked
    with them goes: the same anchors as one by one, in as many rounds as the longest chain of ever
    worse neighbours has links.
    """
    anchors = cut(anchors.select("id", "score"))
    both = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").distinct()
    score = anchors.select(F.col("id").alias("b"), F.col("score").alias("other"))
    better = (F.col("other") > F.col("score")) | ((F.col("other") == F.col("score")) & (F.col("b") < F.col("id")))
    # from each anchor to those that come before it
    above = cut(both.join(score, "b").join(anchors, F.col("a") == F.col("id")).where(better).select("id", "b"))
    open_, kept = anchors, anchors.limit(0)
    while not open_.isEmpty():
        now = open_.join(above, "id", "left_anti")
        kept = cut(kept.unionByName(now))
        gone = above.join(now.select(F.col("id").alias("b")), "b", "left_semi").select("id").distinct()
        open_ = cut(open_.join(now.select("id"), "id", "left_anti").join(gone, "id", "left_anti"))
        above = cut(above.join(open_.select("id"), "id", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi").select("id", "b"))
    return kept


def stability(near: DataFrame, ranked: bool = True) -> DataFrame:
    """id, score of each anchor: the similarities ``other`` of its neighbours (``near`` has id and
    place from 0) summed up, discounted by log2(place + 2), or plainly where not ``ranked``."""
    gain = F.col("other") / F.log2(F.col("place") + 2) if ranked else F.col("other")
    return near.where("other > 0").groupBy("id").agg(F.sum(gain).alias("score"))


def select_anchors(anchors: DataFrame, tolerance: float = 0.13) -> DataFrame:
    """src, trg, score of ``anchors``: the best of each src, of these the best of each trg, scores
    scaled to 0 to 1, and the best int(n (1 - tolerance)) of them. Ties go to the smaller src, then trg."""
    first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "src", "trg"))
    one = anchors.withColumn("__i", first("src")).where("__i = 1").withColumn("__i", first("trg")).where("__i = 1").drop("__i")
    ends = one.agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"), F.count("*").alias("__n"))
    placed = ranks.positions(one.withColumn("__all", F.lit(0)), ["__all"], [F.desc("score"), "src", "trg"], "__pos")
    kept = placed.crossJoin(F.broadcast(ends)).where(F.col("__pos") < F.floor(F.col("__n") * (1 - tolerance)))
    return kept.select("src", "trg", F.try_divide(F.col("score") - F.col("__lo"), F.col("__hi") - F.col("__lo")).alias("score"))


def moments_by(rows: DataFrame, by: str, vec: str = "e") -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """For each value of ``by`` what ``second_moments`` gives: one d x d matrix a value and task."""

    def partial(batches):
        held: dict[int, list] = {}
        for pdf in batches:
            for k, part in pdf.groupby(by):
                x = _stack(part[vec])
                sums = held.setdefault(k, [0.0, 0.0, 0])
                sums[0], sums[1], sums[2] = sums[0] + x.T @ x, sums[1] + x.sum(0), sums[2] + len(x)
        for k, (m, s, n) in held.items():
            values = np.concatenate((m.ravel(), s, [n]))
            yield pd.DataFrame({by: np.full(len(values), k), "i": np.arange(len(values)), "x": values})

    got = rows.select(F.col(by).cast("long").alias(by), vec).mapInPandas(partial, f"{by} long, i long, x double").groupBy(by, "i").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for k, part in got.sort_values("i").groupby(by):
        x = part["x"].to_numpy()
        d = (math.isqrt(4 * len(x) - 3) - 1) // 2
        out[int(k)] = (x[: d * d].reshape(d, d), x[d * d : -1], int(x[-1]))
    return out


def pair_distribution(rows: DataFrame, shares: list[float], bins: int = 1 << 12, most: int = 1 << 17) -> tuple[int, float, float, list[float]]:
    """Number of pairs, mean, sample deviation and exact quantiles (linear between neighbours) of
    the similarities of all pairs of ``rows`` (id, e unit).

    Every task counts its similarities in bins; only counts leave it. The bins in which quantiles
    lie are cut into bins again, all in one pass, while they hold more than ``most`` values.
    """
    return pairs.pair_distribution(rows, shares, bins, most, BLOCK)


def sampled_pairs(rows: DataFrame, n_pairs: int) -> DataFrame:
    """sim of ``n_pairs`` random pairs of ``rows`` (id, e unit), pairs of a row with itself left
    out: places by md5 of the pair's number are drawn first, then vectors are joined."""
    n = rows.count()
    placed = ranks.positions(rows.select("id", "e").withColumn("__all", F.lit(0)), ["__all"], ["id"]).select("pos", "e")
    drawn = lambda end: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{end}"))), 1, 12), 16, 10).cast("long") % max(1, n)
    pairs = rows.sparkSession.range(n_pairs).select(drawn("a").alias("a"), drawn("b").alias("b")).where("a <> b")
    left = pairs.join(placed.select(F.col("pos").alias("a"), "e"), "a")
    return left.join(placed.select(F.col("pos").alias("b"), F.col("e").alias("f")), "b").select(dot("e", "f").alias("sim"))


def component_checks(rows: DataFrame, x: str, top: int = 10, vec: str = "e", label: str | None = None) -> list[tuple]:
    """(component from 1, share of the variance, |correlation with x|, |correlation with label|)
    of the principal components with the ``top`` largest correlations with ``x``."""
    extra = [F.col(c).cast("double") for c in (x, label) if c]
    both = rows.where(F.col(x).isNotNull()).select(F.concat(F.array(*extra), F.col(vec)).alias("__v"))
    m, s, n = second_moments(both, "__v")
    cov = (m - np.outer(s, s) / n) / (n - 1)
    k = len(extra)
    values, axes = np.linalg.eigh(cov[k:, k:])
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    spread = np.sqrt(np.maximum(values, 1e-300))
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = [np.abs(axes.T @ cov[k:, j] / spread / math.sqrt(cov[j, j])) for j in range(k)]
    best = np.argsort(-np.nan_to_num(seen[0]), kind="stable")[:top]
    return [(int(p) + 1, float(values[p] / values.sum()), float(seen[0][p]), float(seen[1][p]) if label else None) for p in best]
