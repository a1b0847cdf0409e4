"""Exact top-k search by inner product with a pivot table.

Every vector's distances to the pivots are computed once. For a query q and a candidate x the
triangle inequality bounds their distance from below by the largest |d(q, p) - d(x, p)| over the
pivots p, and so their inner product from above, as 2 qx = |q|^2 + |x|^2 - d(q, x)^2. Candidates
are evaluated in the order of that bound until it falls below the k-th best score found.

Equal vectors are one candidate that carries its k + 1 smallest ids: enough for any query, itself
excluded. Candidates and queries are dealt into blocks, and each pair of blocks is one task with
bounded memory; each gives k rows a query, which a window with a group limit merges.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import durable

PIVOTS = 32
#: Distinct vectors from which pivots are chosen, farthest first; any choice is exact.
PIVOT_SAMPLE = 1024
CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 512
#: Candidates evaluated before the bound is looked at; doubled each time.
FIRST_STEP = 256
SCALE = 256


def quantised(col: str = "embedding"):
    """floor(256 x) of every component, as long."""
    return F.transform(F.col(col), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, vec, dim of the rows whose vector is there with all its components finite."""
    fine = F.coalesce(F.forall(F.col(col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantised(col).alias("vec"), F.size(col).alias("dim"))


def _choose_pivots(sample: list[list[int]]) -> np.ndarray:
    points = np.array(sample, np.float64)
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _with_distances(batches, pivots: dict[int, np.ndarray], kind: str):
    """Adds ``raw``, the components as bytes of ``kind``, and ``at``, the distances to the pivots of
    the vector's dimension as bytes of single floats."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        vec = batch.column("vec")
        values, ends = vec.flatten().to_numpy().astype(kind), np.cumsum(dims)
        raw, at = [None] * len(dims), [None] * len(dims)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            points = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
            near = _distances(points.astype(np.float64), pivots[int(dim)]) if dim and int(dim) in pivots else np.zeros((len(rows), 1))
            for i, p, d in zip(rows, points, near.astype(np.float32), strict=True):
                raw[i], at[i] = p.tobytes(), d.tobytes()
        keep = [x for x in batch.schema.names if x not in ("vec", "dim")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in keep), batch.column("dim"), pa.array(raw, pa.binary()), pa.array(at, pa.binary())], names=[*keep, "dim", "raw", "at"]
        )


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width) if width else np.zeros((len(column), 0), kind)


def _scores(points: np.ndarray, q: np.ndarray, exact_in_double: bool) -> np.ndarray:
    return (points.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if exact_in_double else points @ q


def _search(k: int, kind: str):
    out_type = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = defaultdict(list)
        if candidates.num_rows and queries.num_rows:
            dim = queries.column("dim")[0].as_py()
            x, q = (_matrix(side.column("raw"), kind, dim).astype(np.int64) for side in (candidates, queries))
            width = len(queries.column("at")[0].as_py()) // 4
            dx, dq = (_matrix(side.column("at"), np.float32, width) for side in (candidates, queries))
            slack = 1e-6 * float(max(dx.max(), dq.max()))  # for the rounding of distances
            ids, names = candidates.column("ids").to_pylist(), queries.column("vec_id").to_pylist()
            xf, squares = x.astype(np.float64), (x.astype(np.float64) ** 2).sum(axis=1)
            exact = not dim or dim * float(np.abs(xf).max()) * float(np.abs(q).max()) < 2**52
            for i, name in enumerate(names):
                lower = np.maximum(0.0, np.abs(dx - dq[i]).max(axis=1).astype(np.float64) - slack)
                upper = (squares + float((q[i].astype(np.float64) ** 2).sum()) - lower * lower) / 2
                upper += 1e-9 * (1 + np.abs(upper) + squares)  # rounding must not lower a bound
                order = np.argsort(-upper, kind="stable")
                at, step, scores = 0, FIRST_STEP, np.zeros(0, np.int64)
                while at < len(order):
                    scores = np.concatenate((scores, _scores(x[order[at : at + step]], q[i], exact)))
                    at, step = at + step, 2 * step
                    least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k else -math.inf
                    if at < len(order) and upper[order[at]] < least:
                        break
                least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k else -math.inf
                kept = np.flatnonzero(scores >= least)
                rows = sorted((-int(scores[j]), v) for j in kept for v in ids[order[j]] if v != name)[:k]
                for score, v in rows:
                    found["query_id"].append(name)
                    found["vec_id"].append(v)
                    found["score"].append(-score)
        return pa.table({n: pa.array(found[n], pa.int64()) for n in out_type.names}, schema=out_type)

    return run


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is a multiple of ``query_step``
    the ``k`` best other rows by integer inner product, ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without
    a vec_id; vectors of another dimension than the query's are no candidates. A row that repeats
    with the same vec_id and vector counts once. A query has fewer rows where there are fewer
    candidates. Other columns of ``vectors`` are not read.
    """
    key = ["h1", "h2", "dim"]
    whole = whole_vectors(vectors).select("*", F.xxhash64("vec").alias("h1"), F.xxhash64(F.reverse("vec"), F.lit(1)).alias("h2"))
    firsts = whole.groupBy("vec_id", *key).agg(F.first("vec").alias("vec"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
    distinct = firsts.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec"))
    distinct = durable(distinct.select("h1", "dim", "ids", "vec"))

    counts = distinct.groupBy("dim").agg(F.count("*").alias("n"))
    sizes = {r["dim"]: r["n"] for r in counts.collect()}
    # by a hash about four times the sample: what one task ranks doesn't grow with the vectors
    few = F.pmod(F.xxhash64("h1", F.lit(5)), F.lit(1 << 20)) * F.col("n") < F.lit(4 * PIVOT_SAMPLE << 20)
    some = distinct.join(F.broadcast(counts), "dim").where(few)
    nth = F.row_number().over(Window.partitionBy("dim").orderBy("h1"))
    sample = defaultdict(list)
    for r in some.withColumn("nth", nth).where(F.col("nth") <= PIVOT_SAMPLE).select("dim", "vec").collect():
        sample[r["dim"]].append(r["vec"])
    pivots = {dim: _choose_pivots(rows) for dim, rows in sample.items() if dim}
    asked = firsts.where(F.col("vec_id") % query_step == 0)
    n_candidates = math.ceil(max(sizes.values(), default=1) / CANDIDATE_BLOCK)
    n_queries = math.ceil(max(1, asked.count()) / QUERY_BLOCK)

    # whole numbers in as few bytes as hold the largest
    most = distinct.where("dim > 0").agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()[0] or 0
    kind = next(t for t in ("int16", "int32", "int64") if most <= np.iinfo(t).max)
    table = lambda batches: _with_distances(batches, pivots, kind)
    candidates = (
        distinct.select("ids", F.pmod("h1", F.lit(n_candidates)).cast("int").alias("cb"), "vec", "dim")
        .mapInArrow(table, "ids array<long>, cb int, dim int, raw binary, at binary")
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    )
    queries = (
        asked.select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int").alias("qb"), "vec", "dim")
        .mapInArrow(table, "vec_id long, qb int, dim int, raw binary, at binary")
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    )
    best = candidates.groupBy("dim", "cb", "qb").cogroup(queries.groupBy("dim", "cb", "qb")).applyInArrow(_search(k, kind), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
