"""Null models of many draws that deal labels anew without shuffling the rows.

A group's rows have places 0 to n - 1 in an order that is as good as random (by a hash of their
key), and so have the labels, sorted. Draw b gives the row at place i the label at place
(a_b i + c_b) mod n, with a prime a_b above n: each draw is a permutation, worked out for each row
by itself. These are not all permutations: n places have n phi(n) of them, so that groups of a few
dozen rows get fewer different draws than shuffles would give. A task adds up what every label gets in every draw, and only these sums are shuffled.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import ranks

DRAWS = 999
#: Rows of one group that the draws are made for.
MOST_ROWS = 1 << 30
#: Labels, over all groups, whose places each task is sent.
MOST_LABELS = 1_000_000
#: Values that each task is sent for the draws over links; beyond that they are joined.
MOST_VALUES = 1 << 22
#: Places that a task works out at once.
GO = 1 << 20


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every number below 3.2e9."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


@functools.cache
def draws(n: int = DRAWS) -> list[tuple[int, int, int]]:
    """(b, a, c) of each draw: a prime a from a million on above the last one, and a shift."""
    out, a = [], MOST_ROWS + 1
    for b in range(1, n + 1):
        while not _is_prime(a):
            a += 2
        out.append((b, a, b * 1_000_003))
        a += 1_000_000 + (a % 2 == 0)
    return out


def shuffled_places(rows: DataFrame, by: list[str], key: Column, *ties: str) -> DataFrame:
    """Adds i: the row's place in its group by md5 of ``key``, then ``ties``."""
    return ranks.positions(rows, by, [F.md5(key.cast("string")), *ties], "i")


def dealt(rows: DataFrame, sizes: DataFrame, n_draws: int = DRAWS, by: str = "period", label: str = "cluster", value: str = "z") -> DataFrame:
    """by, b, label, s, n: sum and number of the values that each label gets in each draw.

    ``rows`` have ``by``, their place ``i`` and the value; ``sizes`` have by, label and ``n``: how
    many labels there are to deal, which may be more than there are rows.
    """
    table: dict[int, tuple[list, list]] = {}
    for r in sizes.where("n > 0").orderBy(by, label).limit(MOST_LABELS + 1).collect():
        names, counts = table.setdefault(r[by], ([], []))
        names.append(r[label])
        counts.append(r["n"])
    if sum(len(x) for x, _ in table.values()) > MOST_LABELS or max((sum(n) for _, n in table.values()), default=0) >= MOST_ROWS:
        raise ValueError(f"draws are made for up to {MOST_LABELS} labels, and {MOST_ROWS} rows of a group")
    ends = {p: np.cumsum(counts) for p, (_, counts) in table.items()}
    a, c = (np.array([x[k] for x in draws(n_draws)], np.int64) for k in (1, 2))

    def add(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for p, part in pdf.groupby(by):
                k, total = len(ends[p]), int(ends[p][-1])
                s, n = sums.setdefault(p, [np.zeros((n_draws, k)), np.zeros((n_draws, k), np.int64)])
                for at in range(0, len(part), GO):
                    i, v = part["i"].to_numpy()[at : at + GO], part[value].to_numpy()[at : at + GO]
                    step = max(1, GO // len(i))
                    for d in range(0, n_draws, step):
                        place = (i * (a[d : d + step, None] % total) + c[d : d + step, None]) % total
                        cell = (np.searchsorted(ends[p], place, "right") + k * np.arange(len(place))[:, None]).ravel()
                        s[d : d + step] += np.bincount(cell, np.tile(v, len(place)), len(place) * k).reshape(-1, k)
                        n[d : d + step] += np.bincount(cell, minlength=len(place) * k).reshape(-1, k)
        for p, (s, n) in sums.items():
            d, g = np.nonzero(n)
            for at in range(0, len(d), GO):
                x, y = d[at : at + GO], g[at : at + GO]
                yield pd.DataFrame({by: np.full(len(x), p), "b": x + 1, "g": y, "s": s[x, y], "n": n[x, y]})

    parts = rows.select(F.col(by).cast("long").alias(by), F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias(value)).mapInPandas(add, f"{by} long, b long, g long, s double, n long")
    names = sizes.sparkSession.createDataFrame([(p, k, x) for p, (of, _) in table.items() for k, x in enumerate(of)] or [], f"{by} long, g long, {label} {sizes.schema[label].dataType.simpleString()}")
    return parts.groupBy(by, "b", "g").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(names, [by, "g"]).select(F.col(by).cast(sizes.schema[by].dataType).alias(by), "b", label, "s", "n")


def group_measures(sums: DataFrame, by: list[str]) -> DataFrame:
    """by, k, n, v, au, aw, rho of sums by group (s, n): weighted between variance, unweighted and
    weighted mean distance from zero, and rank correlation of that distance with size."""
    d = sums.select(*by, "s", "n", F.round(F.abs(F.col("s") / F.col("n")), 12).alias("d"))
    for c in ("d", "n"):
        w = Window.partitionBy(*by)
        d = d.withColumn(f"r{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2)
    total = F.sum("n")
    mean = F.sum("s") / total
    return d.groupBy(*by).agg(
        F.count("*").alias("k"), total.alias("n"), (F.sum(F.col("s") * F.col("s") / F.col("n")) / total - mean * mean).alias("v"),
        F.avg(F.abs(F.col("s") / F.col("n"))).alias("au"), (F.sum(F.abs("s")) / total).alias("aw"), F.round(F.corr("rd", "rn"), 9).alias("rho"),
    )


def _moran_sums(links, z: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    out, n = np.zeros(len(a)), len(z)
    for pdf in links:
        for at in range(0, len(pdf), GO >> 4):
            i, j, w = (pdf[x].to_numpy()[at : at + (GO >> 4)] for x in ("i", "j", "w"))
            for d in range(len(a)):
                mod = int(a[d]) % n
                out[d] += float((w * z[(i * mod + c[d]) % n]) @ z[(j * mod + c[d]) % n])
    return out


def moran_draws(values: DataFrame, links: DataFrame, n_draws: int = DRAWS) -> DataFrame:
    """b, moran_i: Moran's I of the values (id, i, z) dealt anew over the nodes of the directed
    links (src, dst, w)."""
    n = values.count()
    stats = values.agg(F.avg("z").alias("m"), F.var_pop("z").alias("v")).first()
    if n >= MOST_ROWS or not n or not stats["v"]:
        raise ValueError("draws need values that differ, of fewer than 2**30 nodes")
    place = values.select("id", F.col("i").cast("long").alias("i"))
    at = links.join(place.withColumnsRenamed({"id": "src"}), "src").join(place.withColumnsRenamed({"id": "dst", "i": "j"}), "dst").select("i", "j", F.col("w").cast("double").alias("w"))
    table = draws(n_draws)
    if n <= MOST_VALUES:
        z = np.zeros(n)
        got = values.select("i", (F.col("z") - stats["m"]).alias("z")).toPandas()
        z[got["i"].to_numpy()] = got["z"].to_numpy()
        a, c = (np.array([x[k] for x in table], np.int64) for k in (1, 2))
        part = at.mapInPandas(lambda batches: iter([pd.DataFrame({"b": np.arange(1, n_draws + 1), "x": _moran_sums(batches, z, a, c)})]), "b long, x double")
        sums = part.groupBy("b").agg(F.sum("x").alias("x"))
    else:
        grid = values.sparkSession.createDataFrame(table, "b long, a long, c long")
        held = values.select(F.col("i").alias("p"), (F.col("z") - stats["m"]).alias("zp"))
        new = place.crossJoin(F.broadcast(grid)).select("i", "b", ((F.col("i") * (F.col("a") % n) + F.col("c")) % n).alias("p")).join(held, "p").select("i", "b", "zp")
        sums = at.join(new, "i").join(new.withColumnsRenamed({"i": "j", "zp": "zq"}), ["j", "b"]).groupBy("b").agg(F.sum(F.col("w") * F.col("zp") * F.col("zq")).alias("x"))
    total = links.agg(F.sum("w")).first()[0]
    return sums.select("b", (F.col("x") / F.lit(total) / F.lit(stats["v"])).alias("moran_i"))


def normal_axes(n: int, dim: int) -> np.ndarray:
    """n random unit vectors; the components come from md5 of their numbers by Box and Muller."""
    import hashlib

    hexed = [hashlib.md5(f"{d}-{i}".encode()).hexdigest() for d in range(1, n + 1) for i in range(1, dim + 1)]
    h, g = (np.array([int(x[a : a + 7], 16) for x in hexed], np.float64) for a in (0, 8))
    w = (np.sqrt(-2 * np.log((h + 1) / (16**7 + 1))) * np.cos(2 * math.pi * g / 16**7)).reshape(n, dim)
    return w / np.linalg.norm(w, axis=1, keepdims=True)
