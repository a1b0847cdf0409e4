"""Queries on the panel of customers and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import contrib, nulls, panel, ranks, stats, tables
from lattica.operators.components import cut
from lattica.plans.registry import Tables, query, sql_query

BASE, LAST = 1995, 2001
N_PERIODS = 7

#: The panel in SQL: p1 (entity, period, score, cluster), z (with the standardised score).
P1 = """
p1 AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INT) AS period, avg(o_totalprice) AS score, max(c_nationkey) AS cluster, count(*) AS n
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, year(o_orderdate)),
base AS (SELECT avg(score) AS m, stddev_samp(score) AS s FROM p1 WHERE period = 1995),
z AS (SELECT entity, period, score, cluster, (score - m) / s AS z FROM p1 CROSS JOIN base)"""
#: Analysis of variance by period: av (period, k, n, ssb, ssw).
ANOVA = """,
g AS (SELECT period, cluster, count(z) AS gn, avg(z) AS gm, var_pop(z) AS gv FROM z GROUP BY period, cluster),
gm AS (SELECT period, avg(z) AS mean FROM z GROUP BY period),
av AS (SELECT g.period, count(*) AS k, sum(gn) AS n, sum(gn * (g.gm - mean) * (g.gm - mean)) AS ssb, sum(gn * gv) AS ssw FROM g JOIN gm ON g.period = gm.period GROUP BY g.period)"""
CONTRIB = """,
f AS (SELECT period, avg(z) AS fm, count(*) AS fn FROM z GROUP BY period),
c AS (SELECT z.period, cluster, count(*) AS n, avg(z) AS m FROM z GROUP BY z.period, cluster),
b AS (SELECT c.period, cluster, n, m, CAST(n AS DOUBLE) / fn AS w, m - fm AS d, CAST(n AS DOUBLE) / fn * (m - fm) * (m - fm) AS b FROM c JOIN f ON c.period = f.period)"""
SPLIT = """,
s AS (SELECT x.cluster, x.b AS b_first, y.b AS b_last, y.b - x.b AS change, (x.w + y.w) / 2 * (y.d * y.d - x.d * x.d) AS by_position, (y.w - x.w) * (x.d * x.d + y.d * y.d) / 2 AS by_share
      FROM b x JOIN b y ON x.cluster = y.cluster WHERE x.period = 1995 AND y.period = 2001)"""


def p1(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return panel.entity_period_scores(rows, "o_custkey", F.year("o_orderdate"), "o_totalprice", "c_nationkey")


def scored(t: Tables) -> DataFrame:
    return panel.zscore_by_base(p1(t), BASE)


def r(c, digits: int = 6):
    return F.round(c, digits)


def _anova(t: Tables, group: str = "cluster") -> DataFrame:
    return stats.variance_components(scored(t), ["period"], group, "z")


@query(f"WITH {P1}{ANOVA} SELECT period, k, CAST(n AS BIGINT) AS n, round(ssb / (ssb + ssw), 6) AS eta2 FROM av")
def eta2_by_period(t):
    return _anova(t).select("period", "k", "n", r(stats.eta2()).alias("eta2"))


@query(f"WITH {P1}{ANOVA} SELECT period, round((ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k)), 6) AS omega2 FROM av")
def omega2_by_period(t):
    return _anova(t).select("period", r(stats.omega2()).alias("omega2"))


@query(f"WITH {P1}{ANOVA} SELECT period, round((k - 1) / CAST(n - 1 AS DOUBLE), 6) AS bench, round(ssb / (ssb + ssw) - (k - 1) / CAST(n - 1 AS DOUBLE), 6) AS excess FROM av")
def benchmark_excess(t):
    return _anova(t).select("period", r(stats.chance_eta2()).alias("bench"), r(stats.eta2() - stats.chance_eta2()).alias("excess"))


@query(f"""WITH {P1}{ANOVA}, uw AS (SELECT period, var_samp(gm) AS between_unweighted, avg(gv) AS within_unweighted FROM g GROUP BY period)
SELECT av.period, round(ssb / n, 6) AS between_weighted, round(ssw / n, 6) AS within_weighted, round(between_unweighted, 6) AS between_unweighted, round(within_unweighted, 6) AS within_unweighted FROM av JOIN uw ON av.period = uw.period""")
def variance_decomposition(t):
    z = scored(t)
    groups = z.groupBy("period", "cluster").agg(F.avg("z").alias("m"), F.var_pop("z").alias("v"), F.count("z").alias("n"))
    w = stats.variance_components(z, ["period"], "cluster", "z").select("period", r(F.col("ssb") / F.col("n")).alias("between_weighted"), r(F.col("ssw") / F.col("n")).alias("within_weighted"))
    u = groups.groupBy("period").agg(r(F.var_samp("m")).alias("between_unweighted"), r(F.avg("v")).alias("within_unweighted"))
    return w.join(u, "period")


@query(f"""WITH {P1}, c AS (SELECT period, cluster, avg(z) AS m, count(z) AS n FROM z GROUP BY period, cluster), gm AS (SELECT period, sum(n * m) / sum(n) AS mean FROM c GROUP BY period),
rk AS (SELECT c.*, mean, rank() OVER (PARTITION BY c.period ORDER BY abs(m)) + (count(*) OVER (PARTITION BY c.period, abs(m)) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY c.period ORDER BY n) + (count(*) OVER (PARTITION BY c.period, n) - 1) / 2.0 AS rn FROM c JOIN gm ON c.period = gm.period)
SELECT period, round(var_samp(m), 6) AS var_unweighted, round(sum(n * (m - mean) * (m - mean)) / sum(n), 6) AS var_weighted, round(avg(abs(m)), 6) AS abs_unweighted, round(sum(n * abs(m)) / sum(n), 6) AS abs_weighted, round(corr(ra, rn), 6) AS rho_extremity_size FROM rk GROUP BY period""")
def polarization_battery(t):
    means = stats.group_means(scored(t), ["period"], "cluster", "z").withColumn("a", F.abs("m"))
    field = Window.partitionBy("period")
    means = means.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(field) / F.sum("n").over(field)).withColumn("ra", stats.average_rank("a", "period")).withColumn("rn", stats.average_rank("n", "period"))
    dev = F.col("m") - F.col("mean")
    return means.groupBy("period").agg(
        r(F.var_samp("m")).alias("var_unweighted"), r(F.sum(F.col("n") * dev * dev) / F.sum("n")).alias("var_weighted"), r(F.avg("a")).alias("abs_unweighted"),
        r(F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("abs_weighted"), r(F.corr("ra", "rn")).alias("rho_extremity_size"),
    )


KENDALL = """,
kp AS (SELECT a.cluster, sum(sign(b.period - a.period) * sign(b.m - a.m)) AS s, count(*) FILTER (WHERE a.period <> b.period) AS tx, count(*) FILTER (WHERE a.m <> b.m) AS ty FROM c a JOIN c b ON a.cluster = b.cluster GROUP BY a.cluster),
kn AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster)"""
MEANS = f"WITH {P1}, c AS (SELECT period, cluster, round(avg(z), 9) AS m FROM z GROUP BY period, cluster){KENDALL}"


def _series(t: Tables) -> DataFrame:
    return scored(t).groupBy("period", "cluster").agg(F.round(F.avg("z"), 9).alias("m"))


@query(f"{MEANS} SELECT kp.cluster, CAST(n AS BIGINT) AS n, CAST(s / 2 AS BIGINT) AS s, round(s / sqrt(CAST(tx AS DOUBLE) * ty), 6) AS tau FROM kp JOIN kn ON kp.cluster = kn.cluster")
def kendall_trend(t):
    return stats.kendall(_series(t), ["cluster"], "period", "m").select("cluster", "n", "s", r("tau").alias("tau"))


@query(f"""{MEANS}, pv AS (SELECT * FROM (VALUES {", ".join(f"({n}, {s}, {stats.kendall_exact_p(n, s)!r})" for n in range(2, 8) for s in range(n * (n - 1) // 2 % 2, n * (n - 1) // 2 + 1, 2))}) AS v(n, s, p))
SELECT kp.cluster, round(CAST(p AS DOUBLE), 6) AS p FROM kp JOIN kn ON kp.cluster = kn.cluster JOIN pv ON pv.n = kn.n AND pv.s = abs(kp.s / 2)""")
def kendall_pvalue(t):
    tau = stats.kendall(_series(t), ["cluster"], "period", "m")
    rows = [(n, s, stats.kendall_exact_p(n, s)) for n in range(2, N_PERIODS + 1) for s in range(n * (n - 1) // 2 % 2, n * (n - 1) // 2 + 1, 2)]
    table = t.spark.createDataFrame(rows, "n long, abs_s long, p double")
    return tau.withColumn("abs_s", F.abs("s")).join(F.broadcast(table), ["n", "abs_s"]).select("cluster", r("p").alias("p"))


RANKED = "rank() OVER (PARTITION BY period ORDER BY {0}) + (count(*) OVER (PARTITION BY period, {0}) - 1) / 2.0"


@query(f"WITH {P1}, rk AS (SELECT period, {RANKED.format('n')} AS rx, {RANKED.format('score')} AS ry FROM p1) SELECT period, round(corr(rx, ry), 6) AS rho FROM rk GROUP BY period")
def spearman_size_extremity(t):
    return ranks.spearman_of_rows(p1(t), ["period"], "n", "score").select("period", r("rho").alias("rho"))


@query(f"WITH {P1} SELECT period, round(corr(score, n), 6) AS r FROM p1 GROUP BY period")
def pearson_corr(t):
    return p1(t).groupBy("period").agg(r(F.corr("score", "n")).alias("r"))


@query(f"WITH {P1}, q AS (SELECT entity, period, percent_rank() OVER (PARTITION BY period ORDER BY score) AS pct FROM p1) SELECT entity, period, round(pct, 6) AS pct, round(abs(pct - 0.5) * 2, 6) AS extremity FROM q")
def percent_rank_extremity(t):
    return panel.percent_rank_extremity(p1(t)).select("entity", "period", r("pct").alias("pct"), r("extremity").alias("extremity"))


@query(f"WITH {P1} SELECT entity, period, round(z, 6) AS z FROM z")
def zscore_base_period(t):
    return scored(t).select("entity", "period", r("z").alias("z"))


@query(f"WITH {P1}, e AS (SELECT period, min(score) AS lo, max(score) AS hi FROM p1 GROUP BY period) SELECT entity, p1.period, round((score - lo) / (hi - lo), 6) AS scaled FROM p1 JOIN e ON p1.period = e.period")
def minmax_score(t):
    return panel.minmax(p1(t)).select("entity", "period", r("scaled").alias("scaled"))


@query(f"WITH {P1}{CONTRIB} SELECT period, cluster, n, round(w, 6) AS w, round(d, 6) AS d, round(b, 8) AS b FROM b")
def contribution_by_cluster(t):
    return contrib.contributions(scored(t)).select("period", "cluster", "n", r("w").alias("w"), r("d").alias("d"), r("b", 8).alias("b"))


def _changes(t: Tables) -> DataFrame:
    return contrib.split_change(contrib.contributions(scored(t)), BASE, LAST)


@query(f"WITH {P1}{CONTRIB}{SPLIT} SELECT cluster, round(change, 8) AS change, round(by_position, 8) AS by_position, round(by_share, 8) AS by_share FROM s")
def contribution_split(t):
    return _changes(t).select("cluster", *[r(c, 8).alias(c) for c in ("change", "by_position", "by_share")])


@query(f"WITH {P1}{CONTRIB} SELECT period, CASE WHEN d >= 0 THEN 'above' ELSE 'below' END AS side, count(*) AS n_clusters, round(sum(b), 8) AS b FROM b GROUP BY 1, 2")
def side_asymmetry(t):
    side = F.when(F.col("d") >= 0, "above").otherwise("below")
    return contrib.contributions(scored(t)).groupBy("period", side.alias("side")).agg(F.count("*").alias("n_clusters"), r(F.sum("b"), 8).alias("b"))


@query(f"""WITH {P1}{CONTRIB}{SPLIT}, k AS (SELECT abs(change) AS a, row_number() OVER (ORDER BY abs(change) DESC, cluster) AS i FROM s), tops AS (SELECT * FROM (VALUES (5), (10), (20)) AS v(top))
SELECT CAST(top AS INT) AS top, round(sum(CASE WHEN i <= top THEN a END) / sum(a), 6) AS share FROM k CROSS JOIN tops GROUP BY top""")
def topk_concentration(t):
    return contrib.top_shares(_changes(t).withColumn("a", F.abs("change")), "a", (5, 10, 20)).select("top", r("share").alias("share"))


@query(f"WITH {P1}{CONTRIB}{SPLIT} SELECT cluster, CAST(row_number() OVER (ORDER BY change DESC, cluster) AS INT) AS i, round(sum(change) OVER (ORDER BY change DESC, cluster ROWS UNBOUNDED PRECEDING), 8) AS cumulative FROM s")
def cumulative_contribution(t):
    w = Window.orderBy(F.desc("change"), "cluster")
    return _changes(t).select("cluster", F.row_number().over(w).alias("i"), r(F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)), 8).alias("cumulative"))


sql_query("cumulative_curves", f"""WITH {P1}{CONTRIB}{SPLIT}, k AS (SELECT change, abs(change) AS a, row_number() OVER (ORDER BY change DESC, cluster) AS i, row_number() OVER (ORDER BY abs(change) DESC, cluster) AS j, count(*) OVER () AS n FROM s),
net AS (SELECT i, sum(change) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(change) OVER () AS net, i / CAST(n AS DOUBLE) AS uniform FROM k), ab AS (SELECT j, sum(a) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) / sum(a) OVER () AS absolute FROM k)
SELECT CAST(i AS INT) AS i, round(net, 6) AS net, round(absolute, 6) AS absolute, round(uniform, 6) AS uniform FROM net JOIN ab ON i = j""")
sql_query("ungrouped_vs_weighted_rank", f"""WITH {P1}{CONTRIB} SELECT period, cluster, CAST(rank() OVER (PARTITION BY period ORDER BY round(b, 12) DESC) AS INT) AS rank_weighted, CAST(rank() OVER (PARTITION BY period ORDER BY round(d * d, 12) DESC) AS INT) AS rank_unweighted FROM b""")


@query(f"""WITH {P1}, lo AS (SELECT DISTINCT cluster AS left_out FROM z), x AS (SELECT left_out, period, cluster, z FROM z JOIN lo ON z.cluster <> lo.left_out WHERE period IN (1995, 2001)),
g AS (SELECT left_out, period, cluster, count(z) AS gn, avg(z) AS gm, var_pop(z) AS gv FROM x GROUP BY 1, 2, 3), gm AS (SELECT left_out, period, avg(z) AS mean FROM x GROUP BY 1, 2)
SELECT g.left_out, g.period, round(sum(gn * (g.gm - mean) * (g.gm - mean)) / (sum(gn * (g.gm - mean) * (g.gm - mean)) + sum(gn * gv)), 6) AS eta2 FROM g JOIN gm ON g.left_out = gm.left_out AND g.period = gm.period GROUP BY 1, 2""")
def leave_group_out_eta2(t):
    z = scored(t)
    sums = contrib.group_sums(z.where(F.col("period").isin(BASE, LAST)))
    out = z.select("cluster").distinct().withColumn("left_out", F.col("cluster"))
    return contrib.eta2_without(sums, out, ["left_out"]).where("n > 0").select("left_out", "period", r("eta2").alias("eta2"))


BALANCED = "bal AS (SELECT entity FROM p1 GROUP BY entity HAVING count(DISTINCT period) = 7)"


@query(f"WITH {P1}, {BALANCED}, zz AS (SELECT z.* FROM z JOIN bal ON z.entity = bal.entity){CONTRIB.replace('FROM z ', 'FROM zz ').replace('z.period', 'zz.period')} SELECT period, cluster, n, round(b, 8) AS b FROM b")
def balanced_panel_contribution(t):
    return contrib.contributions(panel.balanced(scored(t), N_PERIODS)).select("period", "cluster", "n", r("b", 8).alias("b"))


@query(f"""WITH {P1}, e AS (SELECT entity, max(CASE WHEN period = 1995 THEN z END) AS a, max(CASE WHEN period = 2001 THEN z END) AS b FROM z GROUP BY entity), k AS (SELECT abs(a) AS x, b - a AS y, 0 AS period FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
rk AS (SELECT {RANKED.format('x')} AS rx, {RANKED.format('y')} AS ry FROM k) SELECT round(corr(rx, ry), 6) AS rho FROM rk""")
def ceiling_effect(t):
    ends = scored(t).groupBy("entity").agg(F.max(F.when(F.col("period") == BASE, F.col("z"))).alias("a"), F.max(F.when(F.col("period") == LAST, F.col("z"))).alias("b"))
    return ranks.spearman_of_rows(ends.select(F.lit(0).alias("one"), F.abs("a").alias("x"), (F.col("b") - F.col("a")).alias("y")), ["one"], "x", "y").select(r("rho").alias("rho"))


@query(f"WITH {P1}, {BALANCED} SELECT entity FROM bal")
def balanced_panel(t):
    return panel.complete_entities(p1(t), N_PERIODS)


@query(f"""WITH {P1}, pop AS (SELECT entity FROM p1 WHERE period = 1995), ps AS (SELECT DISTINCT period FROM p1), gr AS (SELECT entity, period FROM pop CROSS JOIN ps)
SELECT gr.period, count(*) AS n_population, count(p1.entity) AS n_present, count(*) - count(p1.entity) AS n_absent FROM gr LEFT JOIN p1 ON gr.entity = p1.entity AND gr.period = p1.period GROUP BY gr.period""")
def attrition(t):
    rows = p1(t)
    return panel.attrition(rows, rows.where(F.col("period") == BASE).select("entity"), list(range(BASE, LAST + 1)))


@query(f"WITH {P1}, k AS (SELECT entity, count(DISTINCT period) AS n_periods FROM p1 GROUP BY entity) SELECT n_periods, count(*) AS n_entities FROM k GROUP BY n_periods")
def completeness(t):
    return p1(t).groupBy("entity").agg(F.count_distinct("period").alias("n_periods")).groupBy("n_periods").agg(F.count("*").alias("n_entities"))


@query(f"WITH {P1}, e AS (SELECT entity, min(period) AS entry FROM p1 GROUP BY entity) SELECT entry, count(*) AS n FROM e GROUP BY entry")
def entry_cohorts(t):
    return panel.entry_period(p1(t)).groupBy("entry").agg(F.count("*").alias("n"))


@query(f"WITH {P1} SELECT entity, max(period) AS last_period, round(max_by(score, period), 4) AS last_value FROM p1 GROUP BY entity")
def last_valid(t):
    return panel.last_valid(p1(t), "score").select("entity", "last_period", r("last_value", 4).alias("last_value"))


@query(f"WITH {P1}, n AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INT) AS period, o_orderpriority AS p, count(*) AS c FROM orders GROUP BY 1, 2, 3), nn AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY c DESC, p) AS i FROM n), zz AS (SELECT z.period, nn.p AS cluster, z FROM z JOIN nn ON z.entity = nn.entity AND z.period = nn.period AND i = 1){ANOVA.replace('FROM z ', 'FROM zz ')} SELECT period, round(ssb / (ssb + ssw), 6) AS eta2_native FROM av")
def native_vs_fixed_eta2(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("native")).agg(F.count("*").alias("c"))
    best = n.withColumn("i", F.row_number().over(Window.partitionBy("entity", "period").orderBy(F.desc("c"), "native"))).where("i = 1")
    return stats.variance_components(scored(t).join(best, ["entity", "period"]), ["period"], "native", "z").select("period", r(stats.eta2()).alias("eta2_native"))


@query(f"WITH {P1} SELECT period, count(*) AS n, count(DISTINCT cluster) AS k, count(*) FILTER (WHERE z > 1) AS n_high, count(*) FILTER (WHERE z < -1) AS n_low FROM z GROUP BY period")
def sample_overview(t):
    n = scored(t).groupBy("period").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"))
    return n.join(tables.counts_if(scored(t), ["period"], n_high=F.col("z") > 1, n_low=F.col("z") < -1), "period")


sql_query("unpivot_scores", f"WITH {P1}, w AS (SELECT cluster, avg(CASE WHEN period = 1995 THEN z END) AS s1995, avg(CASE WHEN period = 1996 THEN z END) AS s1996 FROM z GROUP BY cluster) SELECT cluster, CAST(1995 AS INT) AS period, round(s1995, 6) AS score FROM w UNION ALL SELECT cluster, CAST(1996 AS INT), round(s1996, 6) FROM w")


@query(f"WITH {P1} SELECT cluster, round(avg(CASE WHEN period = 1995 THEN z END), 6) AS score_1995, round(avg(CASE WHEN period = 2000 THEN z END), 6) AS score_2000 FROM z GROUP BY cluster")
def pivot_scores(t):
    wide = scored(t).groupBy("cluster").pivot("period", [1995, 2000]).agg(F.avg("z"))
    return wide.select("cluster", *[r(str(p)).alias(f"score_{p}") for p in (1995, 2000)])


@query(f"WITH {P1}, a AS (SELECT entity, score AS score_1995 FROM p1 WHERE period = 1995), b AS (SELECT entity, score AS score_2001 FROM p1 WHERE period = 2001) SELECT coalesce(a.entity, b.entity) AS entity, round(score_1995, 4) AS score_1995, round(score_2001, 4) AS score_2001 FROM a FULL OUTER JOIN b ON a.entity = b.entity")
def full_outer_assembly(t):
    at = lambda p: p1(t).where(F.col("period") == p).select("entity", r("score", 4).alias(f"score_{p}"))
    return at(1995).join(at(2001), "entity", "full")


DEALT = f"""dr AS (SELECT * FROM (VALUES {", ".join(map(str, nulls.draws()))}) AS v(b, a, c))"""
#: What every cluster gets in every draw, and the observed clusters as draw 0: sh (period, b, cluster, s, n); ms has their measures.
PERMUTE = f""", {DEALT},
ix AS (SELECT period, z, row_number() OVER (PARTITION BY period ORDER BY md5(concat(CAST(entity AS VARCHAR), '-7')), entity) - 1 AS i FROM z),
pl AS (SELECT period, cluster, row_number() OVER (PARTITION BY period ORDER BY cluster, entity) - 1 AS p FROM z),
nn AS (SELECT period, count(*) AS nz FROM z GROUP BY period),
sh AS (SELECT ix.period, dr.b, pl.cluster, sum(ix.z) AS s, count(*) AS n FROM ix JOIN nn ON ix.period = nn.period CROSS JOIN dr JOIN pl ON pl.period = ix.period AND pl.p = (ix.i * (dr.a % nz) + dr.c) % nz GROUP BY 1, 2, 3
       UNION ALL SELECT period, 0, cluster, sum(z), count(*) FROM z GROUP BY period, cluster),
dd AS (SELECT period, b, s, n, round(abs(s / n), 12) AS d FROM sh),
rr AS (SELECT *, rank() OVER (PARTITION BY period, b ORDER BY d) + (count(*) OVER (PARTITION BY period, b, d) - 1) / 2.0E0 AS rd, rank() OVER (PARTITION BY period, b ORDER BY n) + (count(*) OVER (PARTITION BY period, b, n) - 1) / 2.0E0 AS rn FROM dd),
ms AS (SELECT period, b, count(*) AS k, sum(n) AS n, sum(s * s / n) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)) AS v, avg(abs(s / n)) AS au, sum(abs(s)) / sum(n) AS aw, round(corr(rd, rn), 9) AS rho FROM rr GROUP BY period, b),
nu AS (SELECT period, avg(v) AS v, avg(au) AS au, avg(aw) AS aw, avg(rho) AS rho FROM ms WHERE b > 0 GROUP BY period),
nt AS (SELECT m.period, sum(CASE WHEN m.v >= o.v THEN 1 ELSE 0 END) AS nv, sum(CASE WHEN m.rho <= o.rho THEN 1 ELSE 0 END) AS nr, count(*) AS draws FROM ms m JOIN ms o ON m.period = o.period AND o.b = 0 WHERE m.b > 0 GROUP BY m.period)"""


def _permuted(t: Tables) -> DataFrame:
    """Observed measures of each period (o...), means of the draws (n...), tail counts and draws."""
    z = cut(scored(t).select("entity", "period", "cluster", "z"))
    groups = z.groupBy("period", "cluster").agg(F.sum("z").alias("s"), F.count("*").alias("n"))
    places = nulls.shuffled_places(z, ["period"], F.concat(F.col("entity").cast("string"), F.lit("-7")), "entity")
    sums = nulls.dealt(places, groups)
    measures = cut(nulls.group_measures(sums.unionByName(groups.select("period", F.lit(0).cast("long").alias("b"), "cluster", "s", "n")), ["period", "b"]))
    cols = ("k", "n", "v", "au", "aw", "rho")
    observed = measures.where("b = 0").select("period", *[F.col(c).alias(f"o{c}") for c in cols])
    drawn = measures.where("b > 0").join(F.broadcast(observed), "period")
    return drawn.groupBy("period", *[f"o{c}" for c in cols]).agg(
        *[F.avg(c).alias(f"n{c}") for c in cols[2:]], F.count_if(F.col("v") >= F.col("ov")).alias("above"), F.count_if(F.col("rho") <= F.col("orho")).alias("below"), F.count("*").alias("draws")
    )


@query(f"""WITH {P1}{PERMUTE} SELECT o.period, o.k, CAST(o.n AS BIGINT) AS n, round(o.v, 6) AS var_observed, round(nu.v, 6) AS var_null, round(o.au, 6) AS abs_observed, round(nu.au, 6) AS abs_null, round(o.aw, 6) AS weighted_abs_observed, round(nu.aw, 6) AS weighted_abs_null,
round(o.rho, 6) AS rho_observed, round(nu.rho, 6) AS rho_null, round((nr + 1) / CAST(draws + 1 AS DOUBLE), 6) AS rho_p, round((nv + 1) / CAST(draws + 1 AS DOUBLE), 6) AS var_p, round(o.rho - nu.rho, 6) AS excess_rho, round(o.aw / o.au - nu.aw / nu.au, 6) AS excess_ratio
FROM ms o JOIN nu ON o.period = nu.period JOIN nt ON o.period = nt.period WHERE o.b = 0""")
def permutation_null(t):
    """Each period's measures against 999 permutations of the scores over the clusters."""
    p = lambda c: r((F.col(c) + 1) / (F.col("draws") + 1))
    shown = [("ov", "var_observed"), ("nv", "var_null"), ("oau", "abs_observed"), ("nau", "abs_null"), ("oaw", "weighted_abs_observed"), ("naw", "weighted_abs_null"), ("orho", "rho_observed"), ("nrho", "rho_null")]
    return _permuted(t).select(
        "period", F.col("ok").alias("k"), F.col("on").alias("n"), *[r(c).alias(a) for c, a in shown], p("below").alias("rho_p"), p("above").alias("var_p"),
        r(F.col("orho") - F.col("nrho")).alias("excess_rho"), r(F.col("oaw") / F.col("oau") - F.col("naw") / F.col("nau")).alias("excess_ratio"),
    )


@query(f"""WITH {P1}{PERMUTE}, tv AS (SELECT period, var_pop(z) AS v FROM z GROUP BY period)
SELECT o.period, round(o.v / tv.v, 6) AS eta2, round(nu.v / tv.v, 6) AS eta2_null, round(o.v / nu.v, 6) AS factor, round((nv + 1) / CAST(draws + 1 AS DOUBLE), 6) AS p, round((o.k - 1) / CAST(o.n - 1 AS DOUBLE), 6) AS bench FROM ms o JOIN nu ON o.period = nu.period JOIN nt ON o.period = nt.period JOIN tv ON o.period = tv.period WHERE o.b = 0""")
def eta2_null_ratio(t):
    total = scored(t).groupBy("period").agg(F.var_pop("z").alias("tv"))
    return _permuted(t).join(total, "period").select(
        "period", r(F.col("ov") / F.col("tv")).alias("eta2"), r(F.col("nv") / F.col("tv")).alias("eta2_null"), r(F.col("ov") / F.col("nv")).alias("factor"),
        r((F.col("above") + 1) / (F.col("draws") + 1)).alias("p"), r((F.col("ok") - 1) / (F.col("on") - 1)).alias("bench"),
    )


@query(f"""WITH {P1}, {DEALT}, q AS (SELECT entity, period, cluster, percent_rank() OVER (PARTITION BY period ORDER BY score) AS pct FROM p1),
pr AS (SELECT a.entity, b.pct - a.pct AS d FROM q a JOIN q b ON a.entity = b.entity WHERE a.period = 1995 AND b.period = 2001), ix AS (SELECT d, row_number() OVER (ORDER BY md5(concat(CAST(entity AS VARCHAR), '-11')), entity) - 1 AS i FROM pr),
en AS (SELECT entity, max(cluster) AS cluster FROM p1 GROUP BY entity), pl AS (SELECT cluster, row_number() OVER (ORDER BY cluster, entity) - 1 AS p, count(*) OVER () AS nz FROM en), nz AS (SELECT max(nz) AS nz FROM pl),
gd AS (SELECT b, cluster, abs(avg(d)) AS d FROM ix CROSS JOIN dr CROSS JOIN nz JOIN pl ON pl.p = (ix.i * (a % nz.nz) + c) % nz.nz GROUP BY 1, 2), nq AS (SELECT b, percentile_cont(0.9) WITHIN GROUP (ORDER BY d) AS q FROM gd GROUP BY b),
ob AS (SELECT abs(avg(CASE WHEN period = 2001 THEN pct END) - avg(CASE WHEN period = 1995 THEN pct END)) AS d FROM q GROUP BY cluster), oq AS (SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY d) AS q FROM ob WHERE d IS NOT NULL)
SELECT round(max(oq.q), 6) AS observed, round(avg(nq.q), 6) AS null_mean, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY nq.q), 6) AS null_low, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY nq.q), 6) AS null_high, count(*) AS n_draws FROM nq CROSS JOIN oq""")
def pseudo_label_null(t):
    """The 0.9 quantile over clusters of their mean shift in percent rank, against 999 draws of
    labels for the entities there at both ends, out of a pool in the clusters' real sizes."""
    q = cut(panel.percent_rank_extremity(p1(t)).select("entity", "period", "cluster", "pct"))
    at = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    pairs = q.groupBy("entity").agg((at(LAST, "pct") - at(BASE, "pct")).alias("d")).where("d is not null").withColumn("all", F.lit(0))
    pool = q.groupBy("entity").agg(F.max("cluster").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    places = nulls.shuffled_places(pairs, ["all"], F.concat(F.col("entity").cast("string"), F.lit("-11")), "entity")
    shift = nulls.dealt(places, pool, by="all", value="d").withColumn("d", F.abs(F.col("s") / F.col("n")))
    null = shift.groupBy("b").agg(F.percentile("d", 0.9).alias("q"))
    mean = lambda p: F.avg(F.when(F.col("period") == p, F.col("pct")))
    seen = q.groupBy("cluster").agg(F.abs(mean(LAST) - mean(BASE)).alias("d")).agg(F.percentile("d", 0.9).alias("o"))
    out = null.agg(F.avg("q").alias("m"), F.percentile("q", [0.025, 0.975]).alias("e"), F.count("*").alias("n_draws")).crossJoin(F.broadcast(seen))
    return out.select(r("o").alias("observed"), r("m").alias("null_mean"), r(F.col("e")[0]).alias("null_low"), r(F.col("e")[1]).alias("null_high"), "n_draws")


@query(f"""WITH {P1}{ANOVA}, m AS (SELECT 'eta2' AS measure, period, ssb / (ssb + ssw) AS v FROM av UNION ALL SELECT 'between', period, ssb / n FROM av UNION ALL SELECT 'k', period, CAST(k AS DOUBLE) FROM av), mm AS (SELECT measure, period, round(v, 9) AS v FROM m)
SELECT a.measure, round(sum(sign(b.period - a.period) * sign(b.v - a.v)) / nullif(sqrt(CAST(count(*) FILTER (WHERE a.period <> b.period) AS DOUBLE) * count(*) FILTER (WHERE a.v <> b.v)), 0), 6) AS tau, round(max(CASE WHEN a.period = 1995 THEN a.v END), 6) AS start_value, round(max(CASE WHEN a.period = 2001 THEN a.v END), 6) AS end_value, count(DISTINCT a.period) AS n
FROM mm a JOIN mm b ON a.measure = b.measure GROUP BY a.measure""")
def trend_table(t):
    av = cut(_anova(t))
    series = tables.long_series(av, ["period"], {"eta2": F.round(stats.eta2(), 9), "between": F.round(F.col("ssb") / F.col("n"), 9), "k": F.col("k").cast("double")})
    out = tables.trend(series, stats.kendall, BASE, LAST)
    return out.select("measure", r("tau").alias("tau"), r("start_value").alias("start_value"), r("end_value").alias("end_value"), "n")


@query(f"WITH {P1}{ANOVA}, tv AS (SELECT period, var_pop(z) AS v FROM z GROUP BY period) SELECT round(max(abs((ssb + ssw) / n - v)), 6) AS max_diff, count(*) AS n FROM av JOIN tv ON av.period = tv.period")
def decomposition_crosscheck(t):
    total = scored(t).groupBy("period").agg(F.var_pop("z").alias("v"))
    off = F.abs(F.col("sst") / F.col("n") - F.col("v"))
    return _anova(t).join(total, "period").agg(r(F.max(off)).alias("max_diff"), F.count("*").alias("n"))


@query(f"WITH {P1}{ANOVA} SELECT period, 'eta2_percent' AS measure, round(100 * ssb / (ssb + ssw), 4) AS v FROM av UNION ALL SELECT period, 'between', round(ssb / n, 4) FROM av")
def series_long(t):
    return tables.long_series(_anova(t), ["period"], {"eta2_percent": F.round(100 * stats.eta2(), 4), "between": F.round(F.col("ssb") / F.col("n"), 4)})


@query(f"WITH {P1}{CONTRIB}{SPLIT}, k AS (SELECT s.cluster, change, rank() OVER (ORDER BY round(change, 10) DESC) AS up, rank() OVER (ORDER BY round(change, 10)) AS down FROM s JOIN b ON s.cluster = b.cluster WHERE b.period = 2001 AND b.n >= 2) SELECT cluster, round(change, 8) AS change, CASE WHEN up <= 3 THEN 'up' ELSE 'down' END AS side FROM k WHERE up <= 3 OR down <= 3")
def robust_movers(t):
    large = contrib.contributions(scored(t)).where((F.col("period") == LAST) & (F.col("n") >= 2)).select("cluster")
    return tables.movers(_changes(t).join(large, "cluster", "left_semi"), "change", 3).select("cluster", r("change", 8).alias("change"), "side")


@query(f"WITH {P1} SELECT period, cluster, count(*) AS n, round(avg(z), 6) AS m, round(var_samp(z), 6) AS v FROM z GROUP BY period, cluster")
def cluster_period_means(t):
    return scored(t).groupBy("period", "cluster").agg(F.count("*").alias("n"), r(F.avg("z")).alias("m"), r(F.var_samp("z")).alias("v"))


@query(f"WITH {P1} SELECT cluster, count(*) FILTER (WHERE z > 0) AS n_pos, CAST(sum(CASE WHEN z < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg, round(sqrt(avg(z * z)), 6) AS rms FROM z WHERE cluster <> 0 GROUP BY cluster")
def group_conditional_counts(t):
    rows = scored(t).where("cluster <> 0")
    n = tables.counts_if(rows, ["cluster"], n_pos=F.col("z") > 0, n_neg=F.col("z") < 0)
    return n.join(rows.groupBy("cluster").agg(r(F.sqrt(F.avg(F.col("z") * F.col("z")))).alias("rms")), "cluster")


@query(f"WITH {P1} SELECT period, count(DISTINCT entity) AS n, count(DISTINCT CASE WHEN z > 0 THEN entity END) AS n_pos FROM z GROUP BY period")
def distinct_entities(t):
    return tables.distinct_if(scored(t), ["period"], "entity", n_pos=F.col("z") > 0)


@query(f"WITH {P1} SELECT entity, round(min_by(score, period), 4) AS first_value, round(max_by(score, period), 4) AS last_value FROM p1 GROUP BY entity")
def value_at_first_last(t):
    return tables.first_and_last(p1(t), ["entity"], "score", "period").select("entity", r("first_value", 4).alias("first_value"), r("last_value", 4).alias("last_value"))


@query(f"WITH {P1} SELECT period, round(median(z), 6) AS med, round(percentile_cont(0.1) WITHIN GROUP (ORDER BY z), 6) AS q10, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY z), 6) AS q90 FROM z GROUP BY period")
def group_quantiles(t):
    q = tables.group_quantiles(scored(t), ["period"], "z", med=0.5, q10=0.1, q90=0.9)
    return q.select("period", *[r(c).alias(c) for c in ("med", "q10", "q90")])


@query(f"WITH {P1}{CONTRIB} SELECT period, cluster, round(sum(w) OVER (PARTITION BY period ORDER BY w DESC, cluster ROWS UNBOUNDED PRECEDING), 6) AS share FROM b")
def running_share(t):
    return tables.running_share(contrib.contributions(scored(t)), ["period"], "w", "cluster").select("period", "cluster", r("share").alias("share"))


@query(f"WITH {P1}, s AS (SELECT period, avg(z) AS m, stddev_samp(z) AS sd FROM z GROUP BY period) SELECT z.period, round(avg((z - m) * (z - m) * (z - m)) / max(sd * sd * sd), 6) AS skew, round(avg(CASE WHEN abs(z) > 2 THEN 1.0E0 ELSE 0.0E0 END), 6) AS beyond FROM z JOIN s ON z.period = s.period GROUP BY z.period")
def sample_sd_skewness(t):
    return tables.skewness(scored(t), ["period"], "z", 2.0).select("period", r("skew").alias("skew"), r("beyond").alias("beyond"))


@query(f"WITH {P1} SELECT period, round(sum(score), 2) AS score, round(avg(z), 2) AS z FROM z GROUP BY period")
def rounded_numeric_frame(t):
    out = scored(t).groupBy("period").agg(F.sum("score").alias("score"), F.avg("z").alias("z"))
    return out.select(*[F.round(c, 2).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(f"WITH {P1}, s AS (SELECT cluster, sum(score) AS x FROM p1 GROUP BY cluster) SELECT cluster, round(x / power(10, floor(log10(abs(x))) - 2), 0) * power(10, floor(log10(abs(x))) - 2) AS x3 FROM s")
def significant_digits(t):
    s = p1(t).groupBy("cluster").agg(F.sum("score").alias("x"))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("x"))) - 2)
    return s.select("cluster", (F.round(F.col("x") / unit, 0) * unit).alias("x3"))


@query(f"WITH {P1}, s AS (SELECT cluster, avg(CASE WHEN period = 1999 THEN score END) AS mid, avg(CASE WHEN period IN (1998, 2000) THEN score END) AS side FROM p1 GROUP BY cluster) SELECT cluster, round(100 * (mid - side) / nullif(side, 0), 4) AS change FROM s")
def percent_change_vs_neighbors(t):
    return tables.change_at(p1(t), ["cluster"], "score", "period", 1999, (1998, 2000)).select("cluster", r("change", 4).alias("change"))


@query(f"WITH {P1}, e AS (SELECT DISTINCT entity FROM p1 WHERE period = 2001) SELECT p1.entity, period, e.entity IS NOT NULL AS stays FROM p1 LEFT JOIN e ON p1.entity = e.entity")
def member_flags(t):
    rows = p1(t)
    return tables.flagged(rows, rows.where("period = 2001"), "entity", "stays").select("entity", "period", "stays")


sql_query("finite_only", f"WITH {P1}, s AS (SELECT cluster, stddev_samp(z) AS sd FROM z WHERE period = 2001 GROUP BY cluster) SELECT cluster, round(sd, 6) AS sd FROM s WHERE sd IS NOT NULL AND NOT isnan(sd)")


@query(f"WITH {P1} SELECT entity, period FROM p1 WHERE cluster IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def whitelist_filter(t):
    allowed = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("cluster"))
    return p1(t).join(allowed, "cluster", "left_semi").select("entity", "period")


@query(f"WITH {P1} SELECT entity, period, n_name, r_name FROM p1 LEFT JOIN nation ON cluster = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_enrichment(t):
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("cluster"), "n_name", "r_name")
    return p1(t).join(names, "cluster", "left").select("entity", "period", "n_name", "r_name")


@query(f"WITH {P1} SELECT entity, period FROM p1 WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = cluster)")
def semi_join_partition(t):
    return p1(t).join(t.supplier.select(F.col("s_nationkey").alias("cluster")), "cluster", "left_semi").select("entity", "period")


@query("SELECT c_custkey AS entity FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_coverage(t):
    return t.customer.select(F.col("c_custkey").alias("entity")).join(t.orders.select(F.col("o_custkey").alias("entity")), "entity", "left_anti")


@query(f"WITH {P1}, a AS (SELECT avg(score) AS m FROM p1) SELECT period, count(*) FILTER (WHERE score > m) AS n_above FROM p1 CROSS JOIN a GROUP BY period")
def cross_scalar_join(t):
    rows = tables.with_group(p1(t), [], m=F.avg("score"))
    return tables.counts_if(rows, ["period"], n_above=F.col("score") > F.col("m"))


@query(f"WITH {P1} SELECT cluster, count(DISTINCT period) AS n FROM p1 GROUP BY cluster HAVING count(DISTINCT period) = 7")
def all_period_intersection(t):
    return tables.in_all(p1(t), "cluster", "period", N_PERIODS)


@query(f"WITH {P1} SELECT entity, period FROM p1 WHERE period = 1995 UNION ALL SELECT entity, period FROM p1 WHERE period = 1996")
def union_periods(t):
    at = lambda p: p1(t).where(F.col("period") == p).select("entity", "period")
    return at(1995).unionByName(at(1996))


@query(f"WITH {P1} SELECT entity FROM p1 WHERE period = 1995 INTERSECT SELECT entity FROM p1 WHERE period = 2000")
def intersect_periods(t):
    at = lambda p: p1(t).where(F.col("period") == p).select("entity")
    return at(1995).intersect(at(2000))


@query(f"WITH {P1} SELECT DISTINCT cluster, period FROM p1")
def distinct_clusters(t):
    return p1(t).select("cluster", "period").distinct()


@query(f"WITH {P1} SELECT 'only_first' AS side, count(*) AS n FROM (SELECT entity FROM p1 WHERE period = 1995 EXCEPT SELECT entity FROM p1 WHERE period = 2000) UNION ALL SELECT 'only_last', count(*) FROM (SELECT entity FROM p1 WHERE period = 2000 EXCEPT SELECT entity FROM p1 WHERE period = 1995)")
def entry_rule_difference(t):
    at = lambda p: p1(t).where(F.col("period") == p).select("entity")
    return tables.two_sided_difference(at(1995), at(2000), ("only_first", "only_last"))


@query(f"WITH {P1} SELECT entity, period, round(score, 4) AS score FROM p1 ORDER BY period DESC, score DESC, entity LIMIT 25")
def multi_key_sort_limit(t):
    return p1(t).orderBy(F.desc("period"), F.desc("score"), "entity").limit(25).select("entity", "period", r("score", 4).alias("score"))


@query(f"WITH {P1} SELECT entity, period, round(z, 6) AS z FROM z ORDER BY z, entity, period LIMIT 10")
def bottom_n(t):
    return scored(t).orderBy("z", "entity", "period").limit(10).select("entity", "period", r("z").alias("z"))


@query(f"WITH {P1}, k AS (SELECT entity, period, n, rank() OVER (PARTITION BY period ORDER BY n DESC) AS i FROM p1) SELECT entity, period, n FROM k WHERE i <= 3")
def top_n_with_ties(t):
    return tables.with_ties(p1(t), ["period"], "n", 3).select("entity", "period", "n")


@query(f"""WITH {P1}{CONTRIB}{SPLIT}, k AS (SELECT cluster, 'up' AS why, row_number() OVER (ORDER BY change DESC, cluster) AS i FROM s UNION ALL SELECT cluster, 'down', row_number() OVER (ORDER BY change, cluster) FROM s UNION ALL SELECT cluster, 'large', row_number() OVER (ORDER BY abs(change) DESC, cluster) FROM s)
SELECT cluster, string_agg(why, '+' ORDER BY why) AS reasons FROM k WHERE i <= 5 GROUP BY cluster""")
def tagged_top_lists(t):
    ch = _changes(t)
    tops = [("up", F.desc("change")), ("down", F.asc("change")), ("large", F.desc(F.abs("change")))]
    parts = [ch.orderBy(o, "cluster").limit(5).select("cluster", F.lit(w).alias("why")) for w, o in tops]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("why")), "+").alias("reasons"))


@query("SELECT c_mktsegment AS segment, string_agg(DISTINCT r_name, '+' ORDER BY r_name) AS reasons FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment")
def string_agg_reasons(t):
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.array_join(F.array_sort(F.collect_set("r_name")), "+").alias("reasons"))


@query(f"WITH {P1}, k AS (SELECT entity, score, row_number() OVER (ORDER BY score DESC, entity) AS i, count(*) OVER () AS n FROM p1 WHERE period = 1999) SELECT entity, round(score, 4) AS score FROM k WHERE i <= floor(n * 0.2)")
def percent_keep(t):
    return tables.best_share(p1(t).where("period = 1999"), 0.2, F.desc("score"), "entity").select("entity", r("score", 4).alias("score"))


@query(f"WITH {P1} SELECT entity, CAST(row_number() OVER (ORDER BY md5(concat(CAST(entity AS VARCHAR(20)), '-42')), entity) AS INT) AS place FROM p1 WHERE period = 1997")
def seeded_shuffle(t):
    rows = p1(t).where("period = 1997").select("entity", F.lit(0).alias("all"))
    key = F.md5(F.concat(F.col("entity").cast("string"), F.lit("-42")))
    return ranks.positions(rows, ["all"], [key, "entity"]).select("entity", (F.col("pos") + 1).cast("int").alias("place"))


@query(f"WITH {P1} SELECT entity, period, round(z - avg(z) OVER (PARTITION BY period), 6) AS dev, count(*) OVER (PARTITION BY period) AS n FROM z")
def partition_mean_attach(t):
    rows = tables.with_group(scored(t), ["period"], mean=F.avg("z"), size=F.count("*"))
    return rows.select("entity", "period", r(F.col("z") - F.col("mean")).alias("dev"), F.col("size").alias("n"))


@query(f"WITH {P1} SELECT cluster, round(avg(CASE WHEN period = 2001 THEN z END) - avg(CASE WHEN period = 1995 THEN z END), 6) AS change FROM z GROUP BY cluster")
def endpoint_change(t):
    return tables.ends_change(scored(t), ["cluster"], "z", "period", BASE, LAST).select("cluster", r("change").alias("change"))


sql_query("signed_format", f"WITH {P1} SELECT cluster, period, CASE WHEN avg(z) >= 0 THEN '+' ELSE '-' END AS sign, CAST(round(abs(avg(z)) * 100, 0) AS INT) AS hundredths FROM z GROUP BY cluster, period")
sql_query("composite_key", f"WITH {P1} SELECT concat(CAST(period AS VARCHAR(9)), '_', CAST(cluster AS VARCHAR(9))) AS key, count(*) AS n FROM p1 GROUP BY 1")
sql_query("year_from_timestamp", "SELECT CAST(year(l_shipdate) AS INT) AS period, count(*) AS n FROM lineitem GROUP BY 1")
sql_query("inline_dimension_join", f"WITH {P1} SELECT d.name, count(*) AS n FROM p1 JOIN (SELECT * FROM (VALUES (0, 'first'), (1, 'second'), (2, 'third')) AS v(id, name)) d ON cluster = d.id GROUP BY d.name")
sql_query("param_grid", f"WITH {P1}, g AS (SELECT * FROM (VALUES (0.5), (1.0), (1.5)) AS v(tau)) SELECT CAST(tau AS DOUBLE) AS tau, period, count(*) FILTER (WHERE abs(z) > tau) AS n FROM z CROSS JOIN g GROUP BY tau, period")
sql_query("key_only_scan", "SELECT DISTINCT o_custkey AS entity FROM orders")
sql_query("restricted_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")


@query(f"WITH {P1}, q AS (SELECT cluster, count(*) AS n FROM z WHERE period = 2001 GROUP BY cluster) SELECT period, count(*) AS n_kept FROM z JOIN q ON z.cluster = q.cluster WHERE n >= 2 GROUP BY period")
def share_threshold(t):
    z = scored(t)
    big = z.where("period = 2001").groupBy("cluster").agg(F.count("*").alias("m")).where("m >= 2")
    return z.join(big, "cluster", "left_semi").groupBy("period").agg(F.count("*").alias("n_kept"))


@query()
def hash_slice(t):
    return p1(t).where(F.pmod(F.xxhash64("entity"), F.lit(8)) == 3).select("entity", "period")


#: What is left out: the groups of one region. N_STEPS is its number of groups.
REGION, N_STEPS = 0, 5
_PICKS = "".join(
    f""", f{k} AS (SELECT g.draw, g.cluster, g.n FROM {"(SELECT draw, cluster, n FROM gd CROSS JOIN po)" if not k else f"f{k - 1}"} g{f" LEFT JOIN k{k - 1} x ON g.draw = x.draw AND g.cluster = x.cluster WHERE x.cluster IS NULL" if k else ""}),
k{k} AS (SELECT f.draw, f.cluster FROM (SELECT f{k}.*, row_number() OVER (PARTITION BY draw ORDER BY abs(f{k}.n - w.n), f{k}.cluster) AS i, least(10, count(*) OVER (PARTITION BY draw)) AS room FROM f{k} JOIN wa w ON w.step = {k}) f
WHERE i = CAST(('0x' || substr(md5(concat(CAST(draw AS VARCHAR), '-{k}')), 1, 7)) AS BIGINT) % room + 1)"""
    for k in range(N_STEPS)
)


@query(f"""WITH {P1}, lo AS (SELECT n_nationkey AS cluster FROM nation WHERE n_regionkey = {REGION}), en AS (SELECT entity, max(cluster) AS cluster FROM p1 GROUP BY entity), sz AS (SELECT cluster, count(*) AS n FROM en GROUP BY cluster),
wa AS (SELECT sz.cluster, n, row_number() OVER (ORDER BY sz.cluster) - 1 AS step FROM sz JOIN lo ON sz.cluster = lo.cluster), po AS (SELECT sz.cluster, n FROM sz WHERE cluster NOT IN (SELECT cluster FROM lo)), gd AS (SELECT unnest(range(1, 1000)) AS draw){_PICKS},
dp AS ({" UNION ALL ".join(f"SELECT draw, cluster FROM k{k}" for k in range(N_STEPS))} UNION ALL SELECT 0, cluster FROM wa), gs AS (SELECT period, cluster, count(z) AS n, sum(z) AS s, sum(z * z) AS q FROM z GROUP BY period, cluster),
va AS (SELECT DISTINCT draw FROM dp UNION ALL SELECT -1), lf AS (SELECT draw, period, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS qb FROM (SELECT va.draw, gs.* FROM va CROSS JOIN gs LEFT JOIN dp ON dp.draw = va.draw AND dp.cluster = gs.cluster WHERE dp.cluster IS NULL) x GROUP BY 1, 2),
et AS (SELECT draw, period, round((qb - s * s / n) / (q - s * s / n), 12) AS e FROM lf),
ta AS (SELECT a.draw, sum(sign(b.period - a.period) * sign(b.e - a.e)) / sqrt(CAST(count(*) FILTER (WHERE a.period <> b.period) AS DOUBLE) * count(*) FILTER (WHERE a.e <> b.e)) AS tau FROM et a JOIN et b ON a.draw = b.draw GROUP BY a.draw),
ch AS (SELECT draw, max(CASE WHEN period = 2001 THEN e END) - max(CASE WHEN period = 1995 THEN e END) AS d FROM et GROUP BY draw), nm AS (SELECT draw, sum(sz.n) AS n FROM dp JOIN sz ON sz.cluster = dp.cluster GROUP BY draw),
rs AS (SELECT ch.draw, round(100 * ch.d / f.d, 9) AS rest, round(tau, 9) AS tau, nm.n FROM ch CROSS JOIN (SELECT d FROM ch WHERE draw = -1) f JOIN ta ON ta.draw = ch.draw JOIN nm ON nm.draw = ch.draw), o AS (SELECT * FROM rs WHERE draw = 0)
SELECT round(max(o.rest), 4) AS rest_observed, round(median(rs.rest), 4) AS rest_median, round(avg(CASE WHEN rs.rest <= o.rest THEN 1.0E0 ELSE 0.0E0 END), 6) AS rest_p, round(max(o.tau), 6) AS tau_observed, round(median(rs.tau), 6) AS tau_median, round(avg(CASE WHEN rs.tau <= o.tau THEN 1.0E0 ELSE 0.0E0 END), 6) AS tau_p,
CAST(max(o.n) AS BIGINT) AS n_observed, CAST(median(rs.n) AS DOUBLE) AS n_median, count(*) AS n_draws FROM rs CROSS JOIN o WHERE rs.draw > 0""")
def size_matched_exclusion(t):
    """How much of the rise in eta2 is left without the groups of one region, and in 999 draws
    without groups of like sizes."""
    z = cut(scored(t).select("entity", "period", "cluster", "z"))
    sizes = cut(z.groupBy("entity").agg(F.max("cluster").alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n")))
    region = t.nation.where(F.col("n_regionkey") == REGION).select(F.col("n_nationkey").alias("cluster"))
    out = contrib.matched_draws(sizes, region, nulls.DRAWS).unionByName(sizes.join(region, "cluster", "left_semi").select(F.lit(0).cast("long").alias("draw"), "cluster"))
    out = cut(out)
    sums = contrib.group_sums(z)
    nothing = t.spark.createDataFrame([(-1, None)], "draw long, cluster int")
    series = cut(contrib.eta2_without(sums, out.withColumn("cluster", F.col("cluster").cast("int")).unionByName(nothing), ["draw"]).select("draw", "period", F.round("eta2", 12).alias("e")))
    tau = stats.kendall(series, ["draw"], "period", "e").select("draw", F.round("tau", 9).alias("tau"))
    at = lambda p: F.max(F.when(F.col("period") == p, F.col("e")))
    change = series.groupBy("draw").agg((at(LAST) - at(BASE)).alias("d"))
    full = change.where("draw = -1").select(F.col("d").alias("full"))
    n = out.join(sizes, "cluster").groupBy("draw").agg(F.sum("n").alias("n"))
    rest = cut(change.crossJoin(F.broadcast(full)).join(tau, "draw").join(n, "draw").select("draw", F.round(100 * F.col("d") / F.col("full"), 9).alias("rest"), "tau", "n"))
    seen = rest.where("draw = 0").select(F.col("rest").alias("or"), F.col("tau").alias("ot"), F.col("n").alias("on"))
    share = lambda a, b: r(F.avg((F.col(a) <= F.col(b)).cast("double")))
    return rest.where("draw > 0").crossJoin(F.broadcast(seen)).agg(
        r(F.max("or"), 4).alias("rest_observed"), r(F.median("rest"), 4).alias("rest_median"), share("rest", "or").alias("rest_p"), r(F.max("ot")).alias("tau_observed"), r(F.median("tau")).alias("tau_median"),
        share("tau", "ot").alias("tau_p"), F.max("on").alias("n_observed"), F.median("n").alias("n_median"), F.count("*").alias("n_draws"),
    )
