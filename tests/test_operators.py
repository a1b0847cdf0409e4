"""Operators on small tables whose results are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import periods, strings
from lattica.operators import components, contrib, density, graph, nulls, panel, ranks, stats, tables, text, vectors
from lattica.sources import files


def test_kendall_exact_p_is_the_share_of_orders():
    assert stats.kendall_exact_p(3, 3) == pytest.approx(2 / 6)
    assert stats.kendall_exact_p(9, 24) == pytest.approx(0.0126653, abs=1e-7)
    assert stats.kendall_exact_p(9, 34) == pytest.approx(4.960e-5, rel=1e-3)


def test_variance_components(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 5.0), (1, "b", None), (2, "a", 1.0)], "p int, g string, v double")
    got = {r["p"]: r for r in stats.variance_components(rows, ["p"], "g", "v").collect()}
    assert (got[1]["k"], got[1]["n"]) == (2, 3)
    assert got[1]["ssb"] == pytest.approx(2 * 1 + 4) and got[1]["ssw"] == pytest.approx(2)
    out = stats.variance_components(rows, ["p"], "g", "v").select("p", stats.eta2().alias("e"), stats.omega2().alias("o"), stats.chance_eta2().alias("c")).collect()
    assert {r["p"]: r["e"] for r in out}[2] is None  # a single value has no variance


def test_static_label(spark):
    rows = [("base", 0, False), ("base", 1, True), ("later", 1, True), ("later", 2, True), ("mixed", 1, True), ("mixed", 2, False), ("none", 0, None)]
    got = {r["entity"]: r["label"] for r in panel.static_label(spark.createDataFrame(rows, "entity string, period int, label boolean"), 0).collect()}
    assert got == {"base": False, "later": True, "mixed": None, "none": None}


def test_split_change_adds_up(spark):
    rng = np.random.default_rng(1)
    rows = [(p, int(c), float(rng.normal(c, 1))) for p in (0, 1) for c in rng.integers(0, 4, 200)]
    parts = contrib.contributions(spark.createDataFrame(rows, "period int, cluster int, z double"))
    for r in contrib.split_change(parts, 0, 1).collect():
        assert r["change"] == pytest.approx(r["by_position"] + r["by_share"], abs=1e-12)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 130)} == {100}


def test_nearest_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    got = {(r["id"], r["rank"]): r["neighbor"] for r in vectors.nearest(rows, 3).collect()}
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    for i in range(60):
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(-sims[i])[:3].tolist()
    assert vectors.close_pairs(rows, 0.5).count() == int((np.triu(sims, 1) > 0.5).sum())


def test_orthogonal_map_and_spectrum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    q0, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, x @ q0, strict=True)], "e array<double>, f array<double>")
    q = vectors.orthogonal_map(rows, "e", "f")
    assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(q, q0, atol=1e-8)
    assert np.allclose(vectors.spectrum(rows), np.linalg.eigvalsh(np.cov(x.T))[::-1])


def test_mutual_information_bounds():
    same = [(i, i, 10) for i in range(4)]
    assert graph.adjusted_mutual_information(same) == pytest.approx(1.0)
    assert abs(graph.adjusted_mutual_information([(a, b, 5) for a in range(3) for b in range(3)])) < 0.05


def test_class_tf_idf_by_hand(spark):
    counts = spark.createDataFrame([("x", 1, "a", 3), ("x", 1, "b", 1), ("y", 1, "a", 4)], "c string, p int, token string, n long")
    got = {(r["c"], r["token"]): r["ctfidf"] for r in text.class_tf_idf(counts, "c", "p").collect()}
    assert got["x", "b"] == pytest.approx(1 / 4 * math.log(1 + 4 / 1)) and got["y", "a"] == pytest.approx(math.log(1 + 4 / 7))


def test_vector_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, -0.5]), ("b", [0.25, 3.0])], "entity string, embedding array<float>")
    files.write_vector_text(rows, str(tmp_path / "v"))
    assert sorted(map(tuple, files.read_vector_text(spark, str(tmp_path / "v"), 2).collect())) == sorted(map(tuple, rows.collect()))


def test_json_and_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("null", 1), ("NA", None), ("é\n", 3)], "token string, n long")
    files.write_json_lines(rows, str(tmp_path / "j"))
    (tmp_path / "j" / "bad.txt").write_text("{broken\n")
    assert sorted(map(str, files.read_json_lines(spark, str(tmp_path / "j"), "token string, n long").collect())) == sorted(map(str, rows.collect()))
    files.write_csv(rows.where("token <> 'é\n'"), str(tmp_path / "c"), one_file=True)
    assert {r["token"] for r in files.read_csv(spark, str(tmp_path / "c"), "token string, n long").collect()} == {"null", "NA"}


def test_partitioned_write_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "p int, x string")
    path = str(tmp_path / "t")
    files.write_partitions(rows, path, "p")
    files.write_partitions(rows.where("p = 2"), path, "p")
    assert sorted((r["p"], r["x"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_positions_and_ranks_against_plain_sorting(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 400) ** 2, rng.integers(0, 40, 400), strict=True))]
    frame = spark.createDataFrame(rows, "g int, v int, id int")
    got = {r["id"]: r["pos"] for r in ranks.positions(frame, ["g"], ["v", "id"]).collect()}
    for g in {r[0] for r in rows}:
        assert [got[i] for _, i in sorted((v, i) for h, v, i in rows if h == g)] == list(range(sum(h == g for h, *_ in rows)))
    for ties in ("min", "average"):
        got = {r["id"]: r["r"] for r in ranks.ranked(frame, ["g"], "v", "r", ties).collect()}
        for g, v, i in rows:
            below, same = (sum(h == g and f(w) for h, w, _ in rows) for f in (lambda w: w < v, lambda w: w == v))
            assert got[i] == (below + 1 if ties == "min" else below + (same + 1) / 2)
    assert ranks.positions(frame.limit(0), ["g"], ["v"]).count() == 0


def test_every_draw_is_a_permutation(spark):
    assert len(nulls.draws(50)) == 50 and all(nulls._is_prime(a) for _, a, _ in nulls.draws(50)) and not nulls._is_prime(2**30 - 1)
    rows = [(p, i, float(2**i)) for p, n in ((1, 12), (2, 7)) for i in range(n)]
    sizes = [(1, "a", 5), (1, "b", 7), (2, "a", 1), (2, "c", 6), (2, "d", 0)]
    got = nulls.dealt(spark.createDataFrame(rows, "period int, i long, z double"), spark.createDataFrame(sizes, "period int, cluster string, n long"), 30).collect()
    for p, total in ((1, 2.0**12 - 1), (2, 2.0**7 - 1)):
        seen = set()
        for b in range(1, 31):
            mine = {r["cluster"]: r for r in got if (r["period"], r["b"]) == (p, b)}
            assert {c: r["n"] for c, r in mine.items()} == {c: n for q, c, n in sizes if q == p and n}
            assert sum(r["s"] for r in mine.values()) == total
            seen.add(tuple(sorted((c, r["s"]) for c, r in mine.items())))
        assert len(seen) > (12 if p == 1 else 4)


def test_draws_spread_like_random_permutations(spark):
    """The between variance over 999 draws has the mean, deviation and upper quantile of shuffles."""
    rng = np.random.default_rng(13)
    n, ends = 600, np.array([40, 140, 300, 420, 600])
    z = rng.normal(size=n)
    sizes = [(0, g, int(x)) for g, x in enumerate(np.diff(ends, prepend=0))]
    rows = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(z)], "period int, i long, z double")
    got = nulls.group_measures(nulls.dealt(rows, spark.createDataFrame(sizes, "period int, cluster int, n long")), ["b"]).collect()
    of = np.repeat(np.arange(5), np.diff(ends, prepend=0))

    def between(x):
        m = np.bincount(of, x) / np.bincount(of)
        return float((np.bincount(of) * (m - x.mean()) ** 2).sum() / n)

    drawn, real = np.array([r["v"] for r in got]), np.array([between(rng.permutation(z)) for _ in range(4000)])
    assert len(drawn) == 999 and drawn.mean() == pytest.approx(real.mean(), rel=0.1) and drawn.std() == pytest.approx(real.std(), rel=0.15)
    assert np.quantile(drawn, 0.95) == pytest.approx(np.quantile(real, 0.95), rel=0.12)


def test_draws_over_links_by_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(6)
    values = spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(rng.normal(size=30))], "id long, i long, z double")
    links = spark.createDataFrame([(int(a), int(b), 0.5) for a, b in rng.integers(0, 30, (80, 2)) if a != b], "src long, dst long, w double")
    one = {r["b"]: r["moran_i"] for r in nulls.moran_draws(values, links, 12).collect()}
    monkeypatch.setattr(nulls, "MOST_VALUES", 1)
    two = {r["b"]: r["moran_i"] for r in nulls.moran_draws(values, links, 12).collect()}
    assert one.keys() == two.keys() == set(range(1, 13)) and all(one[b] == pytest.approx(two[b], abs=1e-12) for b in one)


def test_moran_under_randomisation(spark):
    """Mean and deviation are those of all permutations of a small ring with an isolated node."""
    import itertools

    z = [1.0, 2.0, 4.0, 7.0, 3.0]
    links = [(i, (i + d) % 5) for i in range(5) for d in (1, 4)]
    frame = stats.row_standardised(spark.createDataFrame([(*x, 1.0) for x in links], "src long, dst long, w double"))
    got = stats.moran_test(spark.createDataFrame(list(enumerate(z)), "id long, z double"), frame).first()
    c = np.array(z) - np.mean(z)
    every = [sum(p[a] * p[b] for a, b in links) / 2 / (c**2).sum() for p in itertools.permutations(c)]
    assert got["n"] == 5 and got["moran_i"] == pytest.approx(every[0]) and got["e_i"] == pytest.approx(np.mean(every)) and got["sd_i"] == pytest.approx(np.std(every))
    tail = spark.range(1).select(*[stats.upper_tail(F.lit(x)).alias(str(i)) for i, x in enumerate((-1.5, 0.0, 1.96, 5.0))]).first()
    assert list(tail) == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in (-1.5, 0.0, 1.96, 5.0)], abs=1e-7)


def test_groups_left_out_of_sums(spark):
    rng = np.random.default_rng(7)
    rows = [(int(p), int(g), float(rng.normal(g + p))) for p, g in zip(rng.integers(0, 3, 300), rng.integers(0, 5, 300), strict=True) if (p, g) != (2, 4)]
    frame = spark.createDataFrame(rows, "period int, cluster int, z double")
    out = spark.createDataFrame([("a", 0), ("a", 3), ("b", 4), ("c", None)], "v string, cluster int")
    got = {(r["v"], r["period"]): (r["n"], r["eta2"]) for r in contrib.eta2_without(contrib.group_sums(frame), out, ["v"]).collect()}
    for v, gone in (("a", {0, 3}), ("b", {4}), ("c", set())):
        for p in range(3):
            kept = [(g, x) for q, g, x in rows if q == p and g not in gone]
            x = np.array([x for _, x in kept])
            between = sum(len(y) * (np.mean(y) - x.mean()) ** 2 for y in ([b for a, b in kept if a == g] for g in {g for g, _ in kept}))
            assert got[v, p] == (len(x), pytest.approx(between / ((x - x.mean()) ** 2).sum()))


def test_matched_draws(spark):
    sizes = [(g, 10 * g + g % 3) for g in range(30)]
    left_out = [3, 4, 20]
    got = contrib.matched_draws(spark.createDataFrame(sizes, "cluster int, n long"), spark.createDataFrame([(g,) for g in left_out], "cluster int"), 40).collect()
    for d in range(1, 41):
        mine = [r["cluster"] for r in got if r["draw"] == d]
        assert len(set(mine)) == 3 and not set(mine) & set(left_out)
        for g in left_out:
            assert min(abs(x - g) for x in mine) <= 8
    assert len({tuple(sorted(r["cluster"] for r in got if r["draw"] == d)) for d in range(1, 41)}) > 20


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(8)
    anchors = [(i, float(rng.integers(0, 12))) for i in range(80)]
    links = {(int(a), int(b)) for a, b in rng.integers(0, 80, (160, 2)) if a != b}
    near, want, gone = {}, set(), set()
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i, _ in sorted(anchors, key=lambda x: (-x[1], x[0])):
        if i not in gone:
            want.add(i)
            gone |= near.get(i, set())
    got = vectors.suppress(spark.createDataFrame(anchors, "id long, score double"), spark.createDataFrame(list(links), "a long, b long"))
    assert {r["id"] for r in got.collect()} == want


def _unit_rows(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_distribution_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = _unit_rows(np.random.default_rng(9), 50, 4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    sims = (x @ x.T)[np.triu_indices(50, 1)]
    for bins, most in ((4096, 1 << 17), (8, 20)):
        n, mean, sd, q = vectors.pair_distribution(rows, [0.1, 0.5, 0.9], bins, most)
        assert n == len(sims) and mean == pytest.approx(sims.mean()) and sd == pytest.approx(sims.std(ddof=1)) and q == pytest.approx(np.quantile(sims, [0.1, 0.5, 0.9]))
    assert vectors.pair_distribution(rows.limit(1), [0.5])[0] == 0


def test_anchor_selection(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.95), (2, 2, 0.99), (3, 3, 0.5), (4, 4, 0.7), (5, 4, 0.7), (6, 6, 0.1)]
    got = vectors.select_anchors(spark.createDataFrame(rows, "src long, trg long, score double"), 0.25).collect()
    assert sorted((r["src"], r["trg"], round(r["score"], 6)) for r in got) == [(2, 2, 1.0), (3, 3, round(0.4 / 0.89, 6)), (4, 4, round(0.6 / 0.89, 6))]


def test_component_checks(spark):
    rng = np.random.default_rng(10)
    e = rng.normal(size=(200, 4)) * [5, 3, 2, 1]
    x = e[:, 1] + 0.01 * rng.normal(size=200)
    rows = spark.createDataFrame([(float(a), float(b > 0), v.tolist()) for a, b, v in zip(x, e[:, 0], e, strict=True)], "x double, y double, e array<double>")
    best = vectors.component_checks(rows, "x", 2, label="y")
    assert best[0][0] == 2 and best[0][2] > 0.95 and len(best) == 2 and all(0 <= p[3] <= 1 for p in best)
    values = np.linalg.eigvalsh(np.cov(e.T))[::-1]
    assert best[0][1] == pytest.approx(values[1] / values.sum())


def test_density_clusters(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([c + 0.05 * rng.normal(size=(25, 3)) for c in np.eye(3)[:2]] + [rng.normal(size=(6, 3))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    core = np.sort(d + 9 * np.eye(len(x)), axis=1)[:, 3]
    near = np.argsort(d + 9 * np.eye(len(x)), axis=1)[:, :4]
    up = list(range(len(x)))
    for i in range(len(x)):
        for j in near[i]:
            if max(core[i], core[j], d[i, j]) <= 0.2:
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    want = {i: up[i] if up.count(up[i]) >= 10 else -1 for i in range(len(x))}
    got = {r["id"]: r["cluster"] for r in density.density_clusters(rows, 4, 10, reach=0.2).collect()}
    assert got == want and {got[i] for i in range(25)} - {-1} == {min(i for i in range(25) if got[i] >= 0)}


def test_periods():
    assert periods.parse_periods("2016:2018, 2020") == [2016, 2017, 2018, 2020] and periods.parse_periods("", [3, 1, 3]) == [1, 3]
    for bad in ("3:1", "1:2:3", "7"):
        with pytest.raises(ValueError, match="period"):
            periods.parse_periods(bad, [1, 2, 3])


def test_strings(spark):
    names = spark.createDataFrame([("sport",), ("sports",), ("music",), (None,)], "name string")
    typed = spark.createDataFrame([("mu",), ("spo",), ("sport",), ("x",), (None,)], "prefix string")
    assert {(r["prefix"], r["full"]) for r in strings.complete_prefix(names, typed).collect()} == {("mu", "music"), ("spo", None), ("sport", "sport"), ("x", None), (None, None)}
    numbers = spark.createDataFrame([(1.234,), (-0.5,), (0.0,), (None,)], "x double")
    assert [r[0] for r in numbers.select(strings.decimal_comma(F.col("x"), 2, sign=True)).collect()] == ["+1,23", "\u22120,50", "0,00", None]


def test_further_sources(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/vectors.tsv").write_text("".join(f"{i}.5\t{-i}\n" for i in range(300)))
    (tmp_path / "v/metadata.tsv").write_text("name\tkind\n" + "".join(f"w{i}\tk\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # several partitions
    try:
        got = {r["entity"]: r["embedding"] for r in files.read_vector_folder(spark, str(tmp_path / "v"), header=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 300 and got["w7"] == [7.5, -7.0] and got["w299"] == [299.5, -299.0]
    frame = spark.createDataFrame([(1, None, "a|b", 1.5), (2, None, None, -2.0)], "n int, gone string, t string, x double")
    kept = files.drop_empty_columns(frame)
    assert kept.columns == ["n", "t", "x"]
    files.write_markdown_table(kept, str(tmp_path / "md"), 1)
    text = "".join(p.read_text() for p in (tmp_path / "md").glob("part-*")).strip().split("\n")
    assert text == ["| n | t | x |", "| ---: | --- | ---: |", "| 1 | a\\|b | 1,5 |", "| 2 |  | \u22122,0 |"]
    with pytest.raises(ValueError, match="rows"):
        files.write_markdown_table(kept, str(tmp_path / "md"), most=1)
    assert [len(b) for b in files.batches(spark.range(10).repartition(3), 4)] == [4, 4, 2]
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_unit_rows(np.random.default_rng(3), 20, 3))], "id long, e array<double>")
    first = files.stored_neighbours(x, 2, str(tmp_path / "knn"), "all").collect()
    assert sorted(first) == sorted(files.stored_neighbours(x, 2, str(tmp_path / "knn"), "all").collect()) and len(list((tmp_path / "knn").iterdir())) == 1
    assert files.stored_neighbours(x.where("id < 9"), 2, str(tmp_path / "knn"), "all").count() == 18 and len(list((tmp_path / "knn").iterdir())) == 2


def test_table_operators(spark):
    rows = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", -1.0, 2), (1, "a", None, 3), (2, "c", 5.0, 1), (2, "c", 5.0, 2), (2, "d", 0.0, 3)], "g int, k string, v double, t int")
    sets = lambda df: {tuple(r) for r in df.collect()}
    assert sets(tables.counts_if(rows, ["g"], pos=F.col("v") > 0, neg=F.col("v") < 0)) == {(1, 1, 1), (2, 2, 0)}
    assert sets(tables.distinct_if(rows, ["g"], "k", pos=F.col("v") > 0)) == {(1, 2, 1), (2, 2, 1)}
    assert sets(tables.first_and_last(rows, ["g"], "v", "t")) == {(1, 2.0, None), (2, 5.0, 0.0)}
    assert sets(tables.group_quantiles(rows, ["g"], "v", q=0.25)) == {(1, -0.25), (2, 2.5)}
    assert sets(tables.with_ties(rows.where("v is not null"), ["g"], "v", 1).select("g", "k")) == {(1, "a"), (2, "c")}
    assert sets(tables.change_at(rows, ["g"], "v", "t", 2, (1, 3))) == {(1, -150.0), (2, 100.0)}
    assert sets(tables.ends_change(rows, ["g"], "v", "t", 1, 3)) == {(1, None), (2, -5.0)}
    assert sets(tables.flagged(rows, rows.where("v > 1"), "k", "in_").select("g", "k", "in_")) == {(1, "a", True), (1, "b", False), (2, "c", True), (2, "d", False)}
    assert sets(tables.in_all(rows, "k", "t", 2)) == {("a", 2), ("c", 2)}
    one, two = rows.where("g = 1").select("t"), rows.where("t > 1").select("t")
    assert sets(tables.two_sided_difference(one, two, ("x", "y"))) == {("x", 1), ("y", 0)}
    assert [r["v"] for r in tables.best_share(rows.where("v is not null"), 0.5, F.desc("v"), "t").collect()] == [5.0, 5.0]
    assert sets(tables.with_group(rows, ["g"], n=F.count("v")).select("g", "n")) == {(1, 2), (2, 3)} and sets(tables.with_group(rows, [], n=F.count("v")).select("n")) == {(5,)}
    assert sets(tables.long_series(rows.where("g = 2 and t = 3"), ["t"], {"x": F.col("v"), "y": F.col("v") + 1})) == {(3, "x", 0.0), (3, "y", 1.0)}
    assert sets(tables.percentages(rows, ["k"])) == {("a", 2, 100 / 3), ("b", 1, 100 / 6), ("c", 2, 100 / 3), ("d", 1, 100 / 6)}
    assert sets(tables.profile(rows, "v", "k")) == {(6, -1.0, 5.0, 1, 4)}
    assert [round(r["share"], 2) for r in tables.running_share(rows.where("g = 2"), ["g"], "v", "t").orderBy("share", "t").collect()] == [5.0, 10.0, 10.0]
    moved = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0), ("d", -2.0)], "k string, x double")
    assert sets(tables.movers(moved, "x", 1)) == {("a", 3.0, "up"), ("d", -2.0, "down")}
    skew = tables.skewness(moved, [], "x", 1.5).first()
    x = np.array([3.0, 1.0, 0.0, -2.0])
    assert skew["beyond"] == 0.5 and skew["skew"] == pytest.approx(np.mean((x - x.mean()) ** 3) / x.std(ddof=1) ** 3)


def test_label_provenance(spark):
    labels = [("a", 0, False), ("b", 0, True), ("c", 1, False), ("d", 1, True), ("e", 1, True), ("e", 2, False)]
    status = panel.label_status(spark.createDataFrame(labels, "entity string, period int, label boolean"), 0)
    people = spark.createDataFrame([("x", e) for e in "abcdef"] + [("y", "f")], "basis string, entity string")
    got = {(r["basis"], r["status"][0]): (r["n"], round(r["percent"], 3)) for r in panel.provenance(people, status).collect()}
    assert got == {**{("x", s): (1, 16.667) for s in "ABCDEF"}, ("y", "F"): (1, 100.0)}
