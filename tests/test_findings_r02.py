"""What the second review found: odd inputs, and work whose traffic grew with the square of the rows."""

import duckdb
import numpy as np
import pytest

from lattica.operators import components, vectors
from lattica.plans.catalogue import ORACLE, QUERIES


def test_bot_filter_keeps_empty_texts(spark, tmp_path):
    rows = [(1, "", "src1"), (2, "[deleted]", "src1"), (3, "[removed]", "src2"), (4, None, "src1"), (5, "a", None), (6, "a", "src3"), (7, "a", "SRC7"), (8, "a", "robot"), (9, "a", "bot_x"), (10, "a", "botx"), (11, " ", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(r["doc_id"] for r in QUERIES["bot_filter"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.sql(ORACLE["bot_filter"]).fetchall()) == [1, 10, 11]


def unit_rows(spark, n, d=4, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame([(i, i % 3, float(i % 5), v.tolist()) for i, v in enumerate(x)], "id long, label int, c double, e array<double>")


def shuffled(spark, work) -> int:
    """Records that are written to shuffles while ``work`` runs."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


@pytest.mark.parametrize(
    "work",
    [
        lambda rows: vectors.nearest(rows, 3).count(),
        lambda rows: vectors.close_pairs(rows, 0.9).write.format("noop").mode("overwrite").save(),
        lambda rows: vectors.pair_distribution(rows, [0.5]),
    ],
    ids=["nearest", "close_pairs", "pair_distribution"],
)
def test_pairs_are_not_shuffled(spark, monkeypatch, work):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    small, large = (shuffled(spark, lambda n=n: work(unit_rows(spark, n)[1])) for n in (256, 1024))
    assert large < 1.5 * 4 * small


def test_equal_vectors_are_ranked_by_id(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    x = np.repeat(unit_rows(spark, 12, 7)[0], 5, axis=0)[np.random.default_rng(3).permutation(60)]
    rows = spark.createDataFrame([(i, v.tolist(), v[::-1].tolist()) for i, v in enumerate(x)], "id long, e array<double>, f array<double>")
    sims = np.zeros((60, 60))
    for t in range(7):
        sims += x[:, t][:, None] * x[:, t][None, :]
    np.fill_diagonal(sims, -2)
    for queries in (None, rows.where("id % 7 = 0")):
        got = {(r["id"], r["rank"]): r for r in vectors.nearest(rows, 9, queries, other="f").collect()}
        asked = [i for i in range(60) if queries is None or i % 7 == 0]
        assert set(got) == {(i, k) for i in asked for k in range(1, 10)}
        for i in asked:
            assert [got[i, k]["neighbor"] for k in range(1, 10)] == np.argsort(-sims[i], kind="stable")[:9].tolist()
            assert all(abs(got[i, k]["other"] - got[i, k]["sim"]) < 1e-12 for k in range(1, 10))


def test_sums_over_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x, rows = unit_rows(spark, 100)
    sims, c, label = x @ x.T, np.arange(100) % 5, np.arange(100) % 3
    np.fill_diagonal(sims, -2)
    got = {(r["tau"], r["id"]): r for r in vectors.linked_sums(rows, [0.9, 0.6], "label", ["c"]).collect()}
    assert set(got) == {(tau, i) for tau in (0.6, 0.9) for i in range(100) if (sims[i] > tau).any()}
    for (tau, i), r in got.items():
        near = sims[i] > tau
        assert (r["degree"], r["first"]) == (near.sum(), np.flatnonzero(near)[0])
        assert [r["weight"], r["inside"], r["lag_c"]] == pytest.approx([sims[i][near].sum(), sims[i][near & (label == label[i])].sum(), c[near].sum()])


def test_a_forest_connects_what_the_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x, rows = unit_rows(spark, 300, 6)
    i, j = np.nonzero(np.triu(x @ x.T, 1) > 0.95)
    every = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), strict=True)), "a long, b long")
    forest = vectors.linked_forest(rows, 0.95)
    of = lambda edges: {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert of(forest) == of(every) and len(set(of(every).values())) > 1
    # slices have 64 rows; a slice of 300 rows with all pairs above the threshold gives a tree at most
    assert vectors.linked_forest(rows, -1.1).count() <= 5 * 299


def embeddings(spark, folder, x) -> str:
    rows = [(i, [float(c) for c in v], i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["axis_auto_expansion", "nn_directions"])
def test_no_vector_is_shuffled_for_each_neighbour(spark, tmp_path, name):
    data = embeddings(spark, tmp_path, np.random.default_rng(5).normal(size=(300, 64)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the vectors are too many
    try:
        assert shuffled(spark, lambda: QUERIES[name](spark, data).collect()) < 2 * 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("first", ["plain", "zero", "copy"])
def test_directions_with_copies_and_zero_vectors(spark, monkeypatch, tmp_path, first):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(6).normal(size=(150, 64)).astype(np.float32)
    x[40:60] = x[20:40]
    if first == "zero":
        x[0] = 0
    elif first == "copy":
        x[1] = x[0]
    data = embeddings(spark, tmp_path, x)
    e = x.astype(np.float64)
    with np.errstate(invalid="ignore"):
        e = e / np.sqrt((e * e).sum(1))[:, None]
    here = np.flatnonzero(np.isfinite(e).all(1))
    sims = sum(np.outer(c, c) for c in e.T)
    np.fill_diagonal(sims, -2)
    near = {i: sorted(here[here != i], key=lambda j: (-sims[i, j], j))[:10] for i in here}
    pairs = {(int(i), int(j)): e[j] - e[i] for i in here for j in near[i]}
    got = {(r["id"], r["neighbor"]): r for r in QUERIES["nn_directions"](spark, data).collect()}
    assert set(got) == set(pairs)
    for pair, d in pairs.items():
        assert [got[pair]["d1"], got[pair]["length"]] == pytest.approx([d[0], np.linalg.norm(d)], abs=1.1e-5)
    seed = pairs[min(pairs)]
    like = {p: round(float(d @ seed / np.linalg.norm(d) / np.linalg.norm(seed)), 9) if d.any() and seed.any() else None for p, d in pairs.items()}
    want, used = [], set()
    for p in sorted(pairs, key=lambda p: (like[p] is None, -(like[p] or 0), p)):
        if len(want) < 10 and not used & set(p):
            want.append(p)
            used |= set(p)
    rows = QUERIES["axis_auto_expansion"](spark, data).collect()
    assert [(r["id"], r["neighbor"]) for r in rows] == want
    assert [r["like"] for r in rows] == [None if like[p] is None else pytest.approx(like[p], abs=2e-9) for p in want]
