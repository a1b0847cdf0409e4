"""Queries that SQL doesn't express, against plain versions on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from lattica.operators import graph
from lattica.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def vectors():
    """ids, labels and unit vectors, by id."""
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([r[2] for r in rows], np.float64)
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), x / np.linalg.norm(x, axis=1)[:, None]


def neighbours(x, k):
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(sims, order, 1)


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_procrustes_finds_the_turn(spark, vectors):
    out = run(spark, "procrustes_align")[0]
    assert out["n"] == len(vectors[0]) and out["max_gap"] < 1e-6


def test_dimensions_of_most_variance(spark, vectors):
    values = np.linalg.eigvalsh(np.cov(vectors[2].T))[::-1]
    assert run(spark, "pca_dim90")[0]["dim90"] == int((np.cumsum(values) / values.sum() < 0.9).sum()) + 1


def test_agreement_with_centroids(spark, vectors):
    ids, label, x = vectors
    centres = np.array([x[label == c].mean(0) for c in np.unique(label)])
    near = np.unique(label)[np.argmax(x @ (centres / np.linalg.norm(centres, axis=1)[:, None]).T, axis=1)]
    cells = [(a, b, int(((label == a) & (near == b)).sum())) for a in np.unique(label) for b in np.unique(near)]
    assert run(spark, "ami")[0]["ami"] == pytest.approx(graph.adjusted_mutual_information([c for c in cells if c[2]]), abs=1e-6)


def test_slices_are_parts(spark):
    known = {tuple(r) for r in duckdb.sql(f"SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) FROM '{SF}/orders.parquet' JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey").fetchall()}
    got = [tuple(r) for r in run(spark, "hash_slice")]
    assert len(set(got)) == len(got) and set(got) <= known and 0.04 * len(known) < len(got) < 0.25 * len(known)


def test_directions_of_the_axis(spark, vectors):
    ids, _, x = vectors
    order, _ = neighbours(x, 10)
    pairs = sorted((ids[i], ids[j], i, j) for i in range(len(ids)) for j in order[i])
    unit = lambda i, j: (x[j] - x[i]) / np.linalg.norm(x[j] - x[i])
    seed = unit(*pairs[0][2:])
    ranked, used, want = sorted((-round(float(unit(i, j) @ seed), 9), a, b) for a, b, i, j in pairs), set(), []
    for like, a, b in ranked:
        if a not in used and b not in used and len(want) < 10:
            want.append((a, b, -like))
            used |= {a, b}
    got = [(r["id"], r["neighbor"], r["like"]) for r in run(spark, "axis_auto_expansion")]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and [x for *_, x in got] == pytest.approx([x for *_, x in want], abs=1e-8)


def test_dispersion_keeps_the_best_apart(spark, vectors):
    ids, _, x = vectors
    order, sims = neighbours(x, 35)
    turned = np.concatenate((x[:, 1:], x[:, :1]), axis=1)
    score = {}
    for i in range(len(ids)):
        s = turned[order[i]] @ turned[i]
        score[i] = float(sum(v / math.log2(p + 2) for p, v in enumerate(s) if v > 0))
    first = sims[:, 0]
    low, high = np.quantile(first, [0.05, 0.95], method="inverted_cdf")
    limit = first[(first >= low) & (first <= high)].mean()
    close, kept, gone = x @ x.T > limit, set(), set()
    for i in sorted(score, key=lambda i: (-score[i], ids[i])):
        if i not in gone and score[i] > 0:
            kept.add(int(ids[i]))
            gone |= set(np.flatnonzero(close[i]).tolist())
    assert {r["id"] for r in run(spark, "dispersion_nms")} == kept


def spread(x, ids, k, steps):
    """Modules of weighted label propagation over the neighbour graph, and its edges."""
    order, sims = neighbours(x, k)
    edges = {}
    for i in range(len(ids)):
        for j, s in zip(order[i], sims[i], strict=True):
            edges[min(i, j), max(i, j)] = float(s)
    label = {i: int(ids[i]) for i in range(len(ids))}
    for _ in range(steps):
        votes = {i: {} for i in label}
        for (a, b), s in edges.items():
            for p, q in ((a, b), (b, a)):
                votes[p][label[q]] = votes[p].get(label[q], 0.0) + s
        label = {i: min(v, key=lambda m: (-round(v[m], 9), m)) if v else label[i] for i, v in votes.items()}
    return label, edges


def test_communities(spark, vectors):
    ids, _, x = vectors
    label, _ = spread(x, ids, 10, 4)
    assert {r["id"]: r["module"] for r in run(spark, "walk_communities")} == {int(ids[i]): m for i, m in label.items()}


def test_grid_of_communities(spark, vectors):
    ids, _, x = vectors
    got = {(r["k"], r["steps"]): r for r in run(spark, "community_grid")}
    assert set(got) == {(k, s) for k in (10, 15, 25) for s in (3, 4, 6, 8)}
    label, edges = spread(x, ids, 15, 3)
    total, inside, ends = sum(edges.values()), {}, {}
    for (a, b), s in edges.items():
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0.0) + s
        for i in (a, b):
            ends[label[i]] = ends.get(label[i], 0.0) + s
    q = sum(inside.get(m, 0.0) / total - (e / (2 * total)) ** 2 for m, e in ends.items())
    sizes = sorted((list(label.values()).count(m) for m in set(label.values())), reverse=True)
    assert got[15, 3]["q"] == pytest.approx(q, abs=2e-6) and got[15, 3]["n_modules"] == len(sizes) and got[15, 3]["largest"] == sizes[0]
    assert got[15, 3]["top2"] == pytest.approx(sum(sizes[:2]) / len(ids), abs=1e-6)


def test_clusterings_agree_within_bounds(spark):
    for name in ("solo_seed_agreement", "residual_clustering"):
        assert -1 <= run(spark, name)[0]["ari"] <= 1


def test_component_diagnostics(spark, vectors):
    ids, label, x = vectors
    raw = np.array([r[0] for r in duckdb.sql(f"SELECT embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()], np.float64)
    target = np.log(np.linalg.norm(raw, axis=1) + ids % 3)
    values, axes = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-values)
    scores = x @ axes[:, order]
    seen = np.abs([np.corrcoef(scores[:, p], target)[0, 1] for p in range(scores.shape[1])])
    got = sorted(run(spark, "component_diagnostics"), key=lambda r: -r["x_correlation"])
    assert [r["component"] for r in got] == (np.argsort(-seen)[:10] + 1).tolist()
    assert [r["x_correlation"] for r in got] == pytest.approx(np.sort(seen)[::-1][:10].tolist(), abs=1e-5)
    assert [r["y_correlation"] for r in got] == pytest.approx([abs(np.corrcoef(scores[:, r["component"] - 1], label == 9)[0, 1]) for r in got], abs=1e-5)
