"""Queries on clusters through time: parts by year of shipping, and event types by day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import contrib, lineage, panel, stats, tables
from lattica.operators.components import connected_components, cut
from lattica.plans.registry import Tables, query, sql_query

FIRST, LAST = 1995, 2001

#: Native membership in SQL: mem (entity, period, cluster).
P2 = """
sq AS (SELECT l_partkey AS entity, CAST(year(l_shipdate) AS INT) AS period, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
mem AS (SELECT entity, period, CAST(l_suppkey % 10 AS INT) AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY q DESC, l_suppkey) AS i FROM sq) x WHERE i = 1)"""
FLOW = f"""{P2},
fl AS (SELECT a.period, a.cluster AS old, b.cluster AS new, count(*) AS inter FROM mem a JOIN mem b ON a.entity = b.entity AND b.period = a.period + 1 GROUP BY 1, 2, 3),
ed AS (SELECT *, sum(inter) OVER (PARTITION BY period, old) AS n_old, sum(inter) OVER (PARTITION BY period, new) AS n_new FROM fl),
best AS (SELECT period, old, new, inter, inter / CAST(n_old AS DOUBLE) AS share_old, inter / CAST(n_old + n_new - inter AS DOUBLE) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY period, old ORDER BY inter / CAST(n_old AS DOUBLE) DESC, new) AS i FROM ed) x WHERE i = 1)"""
CHAIN = f"""{FLOW},
ch AS (SELECT old AS line, period, old AS cluster, CAST(NULL AS DOUBLE) AS link FROM best WHERE period = (SELECT min(period) FROM best)
       UNION ALL SELECT ch.line, ch.period + 1, best.new, best.share_old FROM ch JOIN best ON best.period = ch.period AND best.old = ch.cluster)"""


def membership(t: Tables) -> DataFrame:
    q = t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("period"), "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    i = F.row_number().over(Window.partitionBy("entity", "period").orderBy(F.desc("q"), "l_suppkey"))
    return q.withColumn("i", i).where("i = 1").select("entity", "period", F.pmod("l_suppkey", F.lit(10)).cast("int").alias("cluster"))


def edges(t: Tables) -> DataFrame:
    return lineage.flows(membership(t))


def _lines(t: Tables) -> DataFrame:
    rows = cut(edges(t))
    ends = rows.agg(F.min("period"), F.max("period")).first()
    return lineage.chains(lineage.best_successors(rows), ends[0], ends[1] + 1) if ends[0] is not None else lineage.chains(rows, 0, 0)


@query(f"WITH {FLOW} SELECT period, old, new, inter, round(inter / CAST(n_old AS DOUBLE), 6) AS share_old, round(inter / CAST(n_new AS DOUBLE), 6) AS share_new, round(inter / CAST(n_old + n_new - inter AS DOUBLE), 6) AS jaccard FROM ed")
def membership_flow(t):
    return edges(t).select("period", "old", "new", "inter", *[F.round(c, 6).alias(c) for c in ("share_old", "share_new", "jaccard")])


@query(f"WITH {FLOW}, k AS (SELECT a.period, a.cluster, count(b.entity) / CAST(count(*) AS DOUBLE) AS kept FROM mem a LEFT JOIN mem b ON a.entity = b.entity AND b.period = a.period + 1 WHERE a.period < 2001 GROUP BY 1, 2) SELECT period, round(percentile_cont(0.1) WITHIN GROUP (ORDER BY kept), 6) AS q10, round(median(kept), 6) AS med FROM k GROUP BY period")
def retention(t):
    m = membership(t)
    later = m.select("entity", (F.col("period") - 1).alias("period"), F.lit(1.0).alias("there"))
    kept = m.where(F.col("period") < LAST).join(later, ["entity", "period"], "left").groupBy("period", "cluster").agg((F.count("there") / F.count("*")).alias("kept"))
    return kept.groupBy("period").agg(F.round(F.percentile("kept", 0.1), 6).alias("q10"), F.round(F.median("kept"), 6).alias("med"))


@query(f"WITH {FLOW} SELECT period, old, new, round(share_old, 6) AS share_old FROM best")
def best_successor(t):
    return lineage.best_successors(edges(t)).select("period", "old", "new", F.round("share_old", 6).alias("share_old"))


@query(f"WITH {FLOW}, sp AS (SELECT period, old, count(*) FILTER (WHERE inter / CAST(n_old AS DOUBLE) >= 0.1) AS parts FROM ed GROUP BY 1, 2), mg AS (SELECT period, new, count(*) FILTER (WHERE inter / CAST(n_new AS DOUBLE) >= 0.1) AS sources FROM ed GROUP BY 1, 2), a AS (SELECT period, count(*) FILTER (WHERE parts > 1) AS splits FROM sp GROUP BY 1), b AS (SELECT period, count(*) FILTER (WHERE sources > 1) AS merges FROM mg GROUP BY 1) SELECT a.period, splits, merges FROM a JOIN b ON a.period = b.period")
def split_merge(t):
    e = edges(t)
    splits = e.groupBy("period", "old").agg(F.count_if(F.col("share_old") >= 0.1).alias("x")).groupBy("period").agg(F.count_if(F.col("x") > 1).alias("splits"))
    merges = e.groupBy("period", "new").agg(F.count_if(F.col("share_new") >= 0.1).alias("x")).groupBy("period").agg(F.count_if(F.col("x") > 1).alias("merges"))
    return splits.join(merges, "period")


@query(f"WITH {FLOW}, k AS (SELECT period, old, count(*) AS n FROM ed GROUP BY period, old) SELECT period, n, count(*) AS n_clusters FROM k GROUP BY period, n")
def branch_counts(t):
    return edges(t).groupBy("period", "old").agg(F.count("*").alias("n")).groupBy("period", "n").agg(F.count("*").alias("n_clusters"))


@query(f"WITH RECURSIVE {CHAIN} SELECT line, CAST(period AS INT) AS period, cluster, round(link, 6) AS link FROM ch")
def chain_follow(t):
    return _lines(t).select("line", "period", "cluster", F.round("link", 6).alias("link"))


@query(f"WITH RECURSIVE {CHAIN} SELECT line, CAST(period AS INT) AS period, min(CASE WHEN link IS NULL OR link >= 0.12 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY period ROWS UNBOUNDED PRECEDING) = 1 AS intact FROM ch")
def chain_intact(t):
    return lineage.intact(_lines(t), 0.12).select("line", "period", "intact")


#: Standardised scores of the members, and what each cluster of a period contributes: cs (period, cluster, n, m, w, d, b).
SCORED = """,
sc AS (SELECT l_partkey AS entity, CAST(year(l_shipdate) AS INT) AS period, avg(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), sb AS (SELECT avg(score) AS mean, stddev_samp(score) AS sd FROM sc WHERE period = 1995),
mz AS (SELECT mem.entity, mem.period, cluster, (score - mean) / sd AS z FROM mem JOIN sc ON mem.entity = sc.entity AND mem.period = sc.period CROSS JOIN sb), fz AS (SELECT period, avg(z) AS fm, count(*) AS fn FROM mz GROUP BY period),
cs AS (SELECT mz.period, cluster, count(*) AS n, avg(z) AS m, count(*) / CAST(max(fn) AS DOUBLE) AS w, avg(z) - max(fm) AS d FROM mz JOIN fz ON mz.period = fz.period GROUP BY 1, 2),
en AS (SELECT a.line, a.cluster AS cluster_first, b.cluster AS cluster_last, a.period AS p0, b.period AS p1 FROM ch a JOIN ch b ON a.line = b.line WHERE a.period = (SELECT min(period) FROM ch) AND b.period = (SELECT max(period) FROM ch)),
ld AS (SELECT line, cluster_first, cluster_last, p0, p1, x.m AS m0, y.m AS m1, x.w AS w0, y.w AS w1, x.d AS d0, y.d AS d1 FROM en JOIN cs x ON x.period = p0 AND x.cluster = cluster_first JOIN cs y ON y.period = p1 AND y.cluster = cluster_last)"""


def _scored(t: Tables) -> DataFrame:
    """Members with their standardised score: entity, period, cluster, z."""
    score = t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("period")).agg(F.avg("l_extendedprice").alias("score"))
    return panel.zscore_by_base(membership(t).join(score, ["entity", "period"]), FIRST).select("entity", "period", "cluster", "z")


def _line_ends(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines that last from the first to the last period, with what their clusters contribute at both ends."""
    span = lines.agg(F.min("period").alias("p0"), F.max("period").alias("p1"))
    rows = lines.join(parts, ["period", "cluster"]).crossJoin(F.broadcast(span))
    at = lambda c, p: F.max(F.when(F.col("period") == F.col(p), F.col(c)))
    ends = rows.groupBy("line").agg(at("cluster", "p0").alias("cluster_first"), at("cluster", "p1").alias("cluster_last"), *[at(c, p).alias(f"{c}{p[1]}") for c in ("m", "w", "d") for p in ("p0", "p1")])
    return ends.where("cluster_first is not null and cluster_last is not null")


@query(f"""WITH RECURSIVE {CHAIN}{SCORED} SELECT line, cluster_first, cluster_last, round(w0, 6) AS w_first, round(w1, 6) AS w_last, round(d0, 6) AS d_first, round(d1, 6) AS d_last, round(w1 * d1 * d1 - w0 * d0 * d0, 8) AS change,
round((w0 + w1) / 2 * (d1 * d1 - d0 * d0), 8) AS by_position, round((w1 - w0) * (d0 * d0 + d1 * d1) / 2, 8) AS by_share FROM ld""")
def lineage_decomposition(t):
    """What each line that lasts contributes to the between variance at both ends, and whether the
    change comes from its position or its share."""
    e = _line_ends(cut(_lines(t)), contrib.contributions(_scored(t)))
    q0, q1 = F.col("d0") * F.col("d0"), F.col("d1") * F.col("d1")
    return e.select(
        "line", "cluster_first", "cluster_last", *[F.round(c, 6).alias(n) for c, n in (("w0", "w_first"), ("w1", "w_last"), ("d0", "d_first"), ("d1", "d_last"))], F.round(F.col("w1") * q1 - F.col("w0") * q0, 8).alias("change"),
        F.round((F.col("w0") + F.col("w1")) / 2 * (q1 - q0), 8).alias("by_position"), F.round((F.col("w1") - F.col("w0")) * (q0 + q1) / 2, 8).alias("by_share"),
    )


SWEEP = (0.0, 0.1, 0.12, 0.15)


@query(f"""WITH RECURSIVE {CHAIN}{SCORED}, th AS (SELECT CAST(tau AS DOUBLE) AS tau FROM (VALUES {", ".join(f"({x})" for x in SWEEP)}) AS v(tau)), ok AS (SELECT tau, line, min(CASE WHEN link IS NULL OR link >= tau THEN 1 ELSE 0 END) AS ok FROM ch CROSS JOIN th GROUP BY 1, 2),
fx AS (SELECT s.cluster AS line, avg(CASE WHEN mz.period = p1 THEN z END) - avg(CASE WHEN mz.period = p0 THEN z END) AS fixed FROM mem s JOIN (SELECT min(period) AS p0, max(period) AS p1 FROM ch) e ON s.period = p0 JOIN mz ON mz.entity = s.entity GROUP BY s.cluster),
mv AS (SELECT tau, ld.line, round(m1 - m0, 9) AS moved, round(fixed, 9) AS fixed FROM ok JOIN ld ON ok.line = ld.line AND ok = 1 JOIN fx ON fx.line = ld.line),
rk AS (SELECT tau, rank() OVER (PARTITION BY tau ORDER BY moved) + (count(*) OVER (PARTITION BY tau, moved) - 1) / 2.0E0 AS a, rank() OVER (PARTITION BY tau ORDER BY fixed) + (count(*) OVER (PARTITION BY tau, fixed) - 1) / 2.0E0 AS b, sign(moved) = sign(fixed) AS same FROM mv),
nk AS (SELECT tau, count(*) FILTER (WHERE ok = 1) AS n_intact FROM ok GROUP BY tau), ag AS (SELECT tau, count(*) AS n_compared, count(*) FILTER (WHERE same) AS n_same_direction, CASE WHEN count(*) > 1 THEN round(corr(a, b), 6) END AS rho FROM rk GROUP BY tau)
SELECT nk.tau, n_intact, coalesce(n_compared, 0) AS n_compared, coalesce(n_same_direction, 0) AS n_same_direction, rho FROM nk LEFT JOIN ag ON nk.tau = ag.tau""")
def lineage_param_sweep(t):
    """For each least link: lines that stay intact, and how their movement agrees with that of the
    members they started with."""
    lines, members = cut(_lines(t)), cut(_scored(t))
    grid = t.spark.createDataFrame([(x,) for x in SWEEP], "tau double")
    held = F.min(F.when(F.col("link").isNull() | (F.col("link") >= F.col("tau")), 1).otherwise(0))
    ok = lines.crossJoin(F.broadcast(grid)).groupBy("tau", "line").agg(held.alias("ok"))
    span = lines.agg(F.min("period").alias("p0"), F.max("period").alias("p1"))
    start = members.crossJoin(F.broadcast(span)).where(F.col("period") == F.col("p0")).select("entity", F.col("cluster").alias("line"), "p0", "p1")
    mean = lambda p: F.avg(F.when(F.col("period") == F.col(p), F.col("z")))
    fixed = start.join(members.select("entity", "period", "z"), "entity").groupBy("line").agg((mean("p1") - mean("p0")).alias("fixed"))
    moved = _line_ends(lines, contrib.contributions(members)).select("line", F.round(F.col("m1") - F.col("m0"), 9).alias("moved"))
    both = ok.where("ok = 1").join(moved, "line").join(fixed, "line").withColumn("fixed", F.round("fixed", 9))
    rho = stats.spearman(both, ["tau"], "moved", "fixed")
    n = both.groupBy("tau").agg(F.count("*").alias("n_compared"), F.count_if(F.signum("moved") == F.signum("fixed")).alias("n_same_direction")).join(rho, "tau", "left")
    intact = ok.groupBy("tau").agg(F.count_if(F.col("ok") == 1).alias("n_intact"))
    return intact.join(n, "tau", "left").select("tau", "n_intact", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_compared", "n_same_direction")], F.when(F.col("n_compared") > 1, F.round("rho", 6)).alias("rho"))


@query(f"WITH RECURSIVE {CHAIN}, e AS (SELECT line, cluster FROM ch WHERE period = (SELECT max(period) FROM ch)), q AS (SELECT line, min(link) AS min_link FROM ch GROUP BY line), m AS (SELECT line, count(*) OVER (PARTITION BY cluster) AS merge_n FROM e) SELECT q.line, round(min_link, 6) AS min_link, merge_n FROM q LEFT JOIN m ON q.line = m.line")
def lineage_quality(t):
    lines = cut(_lines(t))
    last = lines.join(F.broadcast(lines.agg(F.max("period").alias("period"))), "period").select("line", F.count("*").over(Window.partitionBy("cluster")).alias("merge_n"))
    return lines.groupBy("line").agg(F.round(F.min("link"), 6).alias("min_link")).join(last, "line", "left")


LINKED = f"""{P2}, sz AS (SELECT period, cluster, count(*) AS n FROM mem GROUP BY 1, 2),
it AS (SELECT a.period AS pa, a.cluster AS ca, b.period AS pb, b.cluster AS cb, count(*) AS inter FROM mem a JOIN mem b ON a.entity = b.entity AND a.period < b.period GROUP BY 1, 2, 3, 4),
lk AS (SELECT pa * 100 + ca AS a, pb * 100 + cb AS b FROM it JOIN sz x ON x.period = pa AND x.cluster = ca JOIN sz y ON y.period = pb AND y.cluster = cb WHERE inter / CAST(x.n + y.n - inter AS DOUBLE) >= 0.085)"""


def _line_edges(t: Tables) -> DataFrame:
    m = membership(t)
    sizes = m.groupBy("period", "cluster").agg(F.count("*").alias("n"))
    b = m.select("entity", F.col("period").alias("pb"), F.col("cluster").alias("cb"))
    inter = m.join(b, "entity").where("period < pb").groupBy("period", "cluster", "pb", "cb").agg(F.count("*").alias("inter"))
    pairs = inter.join(sizes, ["period", "cluster"]).join(sizes.select(F.col("period").alias("pb"), F.col("cluster").alias("cb"), F.col("n").alias("n2")), ["pb", "cb"])
    close = pairs.where(F.col("inter") / (F.col("n") + F.col("n2") - F.col("inter")) >= 0.085)
    return close.select((F.col("period") * 100 + F.col("cluster")).cast("long").alias("a"), (F.col("pb") * 100 + F.col("cb")).cast("long").alias("b"))


CLOSURE = "sym AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT reach.node, sym.b FROM reach JOIN sym ON reach.other = sym.a), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


@query(f"WITH RECURSIVE {LINKED}, {CLOSURE} SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM comp")
def line_components(t):
    return connected_components(_line_edges(t)).select("node", "component")


@query(f"WITH RECURSIVE {LINKED}, {CLOSURE}, lab AS (SELECT node, component, CASE WHEN node % 3 = 0 THEN node % 7 END AS label FROM comp), one AS (SELECT component, max(label) AS label, count(DISTINCT label) AS kinds FROM lab GROUP BY component) SELECT CAST(node AS BIGINT) AS node, CAST(coalesce(lab.label, CASE WHEN kinds = 1 THEN one.label END) AS BIGINT) AS label, kinds > 1 AS conflict FROM lab JOIN one ON lab.component = one.component")
def line_label_backfill(t):
    comp = connected_components(_line_edges(t)).withColumn("label", F.when(F.col("node") % 3 == 0, F.col("node") % 7))
    one = comp.groupBy("component").agg(F.max("label").alias("line_label"), F.count_distinct("label").alias("kinds"))
    return comp.join(one, "component").select("node", F.coalesce("label", F.when(F.col("kinds") == 1, F.col("line_label"))).alias("label"), (F.col("kinds") > 1).alias("conflict"))


@query(f"""WITH {P2}{SCORED[: SCORED.index(",{}en AS".format(chr(10)))]}, pool AS (SELECT period, cluster, count(*) AS n_members, min(entity) AS example, count(*) FILTER (WHERE entity % 5 = 0) AS n_labelled FROM mem GROUP BY 1, 2)
SELECT pool.period, pool.cluster, n_members, example, n_labelled, round(100.0E0 * n_labelled / n_members, 4) AS percent_labelled, round(w * d * d, 8) AS contribution FROM pool JOIN cs ON pool.period = cs.period AND pool.cluster = cs.cluster""")
def labeling_pool(t):
    """Clusters to be labelled: members, an example, how many have a label, and the contribution by
    which they are to be taken in turn."""
    pool = membership(t).groupBy("period", "cluster").agg(F.count("*").alias("n_members"), F.min("entity").alias("example"), F.count_if(F.col("entity") % 5 == 0).alias("n_labelled"))
    parts = contrib.contributions(_scored(t)).select("period", "cluster", F.round("b", 8).alias("contribution"))
    return pool.join(parts, ["period", "cluster"]).withColumn("percent_labelled", F.round(100.0 * F.col("n_labelled") / F.col("n_members"), 4))


@query(f"WITH {FLOW} SELECT period, old, new, round(inter / CAST(n_old AS DOUBLE), 6) AS in_old, round(inter / CAST(n_new AS DOUBLE), 6) AS in_new FROM ed")
def containment_shares(t):
    return edges(t).select("period", "old", "new", F.round("share_old", 6).alias("in_old"), F.round("share_new", 6).alias("in_new"))


sql_query("shared_member_pairs", f"WITH {P2} SELECT a.period AS period_a, a.cluster AS cluster_a, b.period AS period_b, b.cluster AS cluster_b, count(*) AS shared FROM mem a JOIN mem b ON a.entity = b.entity AND a.period < b.period GROUP BY a.period, a.cluster, b.period, b.cluster")


@query(f"WITH {P2} SELECT entity, period, p_brand FROM mem JOIN part ON entity = p_partkey WHERE period = 2000")
def index_lookup_join(t):
    return membership(t).where("period = 2000").join(t.part.select(F.col("p_partkey").alias("entity"), "p_brand"), "entity").select("entity", "period", "p_brand")


sql_query("dedupe_first", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS i FROM lineitem) x WHERE i = 1")

#: Labels in SQL: each user's day has the label whether there was a purchase.
LAB = "lab AS (SELECT user_id AS entity, CAST(day(ts) AS INT) AS period, bool_or(event_type = 'purchase') AS label FROM events GROUP BY 1, 2)"


def user_days(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("period")).agg(F.bool_or(F.col("event_type") == "purchase").alias("label"))


STATIC = f"WITH {LAB}, st AS (SELECT entity, coalesce(bool_or(CASE WHEN period = 1 THEN label END), CASE WHEN bool_and(CASE WHEN period > 1 THEN label END) = bool_or(CASE WHEN period > 1 THEN label END) THEN bool_or(CASE WHEN period > 1 THEN label END) END) AS label FROM lab GROUP BY entity)"


@query(f"{STATIC} SELECT entity, label FROM st")
def static_label(t):
    return panel.static_label(user_days(t), 1)


@query(f"""{STATIC}, bs AS (SELECT entity, max(CASE WHEN period = 1 AND label IS NOT NULL THEN 1 ELSE 0 END) AS base FROM lab GROUP BY entity),
ss AS (SELECT st.entity, CASE WHEN base = 1 AND NOT label THEN 'A base no' WHEN base = 1 AND label THEN 'B base yes' WHEN NOT label THEN 'C later no' WHEN label THEN 'D later yes' ELSE 'E open' END AS status FROM st JOIN bs ON st.entity = bs.entity),
od AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS period FROM orders), pp AS (SELECT DISTINCT 'all periods' AS basis, entity FROM od UNION ALL SELECT 'first period', entity FROM od WHERE period = 1995 UNION ALL SELECT 'last period', entity FROM od WHERE period = 2001
UNION ALL SELECT 'fixed partition', entity FROM od JOIN customer ON entity = c_custkey WHERE period = 1995 AND c_nationkey <> 0), kk AS (SELECT basis, coalesce(status, 'F no entry') AS status, count(*) AS n FROM pp LEFT JOIN ss ON pp.entity = ss.entity GROUP BY 1, 2)
SELECT basis, status, n, round(100.0E0 * n / sum(n) OVER (PARTITION BY basis), 4) AS percent FROM kk""")
def label_provenance(t):
    """Where the labels of four populations come from."""
    orders = cut(t.orders.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")).distinct())
    fixed = t.customer.where("c_nationkey <> 0").select(F.col("c_custkey").alias("entity"))
    first = orders.where(F.col("period") == FIRST)
    parts = {"all periods": orders.select("entity").distinct(), "first period": first, "last period": orders.where(F.col("period") == LAST), "fixed partition": first.join(fixed, "entity", "left_semi")}
    populations = reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("basis"), "entity") for name, rows in parts.items()])
    return panel.provenance(populations, panel.label_status(user_days(t), 1)).withColumn("percent", F.round("percent", 4))


@query(f"{STATIC}, c AS (SELECT lab.entity, count(*) FILTER (WHERE period > 1 AND lab.label <> st.label) AS n_other, count(*) FILTER (WHERE period > 1) AS n_later, max_by(lab.label, period) AS final FROM lab JOIN st ON lab.entity = st.entity WHERE st.label IS NOT NULL GROUP BY lab.entity, st.label) SELECT c.entity, n_other > 0 AS flips_any, n_other * 2 > n_later AS flips_majority, final <> st.label AS flips_end FROM c JOIN st ON c.entity = st.entity")
def flippers(t):
    days = user_days(t)
    st = panel.static_label(days, 1).where("label is not null").withColumnRenamed("label", "first")
    later = F.col("period") > 1
    c = days.join(st, "entity").groupBy("entity", "first").agg(F.count_if(later & (F.col("label") != F.col("first"))).alias("x"), F.count_if(later).alias("n"), F.max_by("label", "period").alias("final"))
    return c.select("entity", (F.col("x") > 0).alias("flips_any"), (F.col("x") * 2 > F.col("n")).alias("flips_majority"), (F.col("final") != F.col("first")).alias("flips_end"))


FLIP = f"{STATIC}, fp AS (SELECT lab.entity, count(*) FILTER (WHERE period > 1 AND lab.label <> st.label) AS n_other, count(*) FILTER (WHERE period > 1) AS n_later, max_by(lab.label, period) AS final, bool_or(st.label) AS first FROM lab JOIN st ON lab.entity = st.entity WHERE st.label IS NOT NULL GROUP BY lab.entity)"
_KEPT = ("TRUE", "NOT (n_other > 0)", "NOT (n_other * 2 > n_later)", "NOT (final <> first)")


@query(f"""{FLIP}, ud AS (SELECT user_id AS entity, CAST(day(ts) AS INT) AS period, avg(value) AS z FROM events GROUP BY 1, 2), pv AS (SELECT ud.entity, period, CAST(ud.entity % 10 AS INT) AS cluster, z, {", ".join(f"{c} AS k{i}" for i, c in enumerate(_KEPT))} FROM ud JOIN fp ON ud.entity = fp.entity),
vs AS ({" UNION ALL ".join(f"SELECT {i} AS v, period, cluster, z FROM pv WHERE k{i}" for i in range(4))}), gs AS (SELECT v, period, cluster, count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM vs GROUP BY 1, 2, 3),
es AS (SELECT v, period, sum(n) AS n, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / nullif(sum(q) - sum(s) * sum(s) / sum(n), 0) AS e FROM gs GROUP BY 1, 2)
SELECT period, CAST(max(CASE WHEN v = 0 THEN n END) AS BIGINT) AS n, CAST(coalesce(max(CASE WHEN v = 1 THEN n END), 0) AS BIGINT) AS n_without_any, {", ".join(f"round(max(CASE WHEN v = {i} AND n > 10 THEN e END), 6) AS {c}" for i, c in enumerate(("eta2", "eta2_without_any", "eta2_without_majority", "eta2_without_end")))} FROM es GROUP BY period""")
def flipper_effect(t):
    """Each period's eta2 of all labelled entities, and without those whose label flips by each rule."""
    kinds = cut(flippers(t))
    score = t.events.groupBy(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("period")).agg(F.avg("value").alias("z"))
    rows = score.join(kinds, "entity").withColumn("cluster", (F.col("entity") % 10).cast("int"))
    kept = F.explode(F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate([F.lit(True), ~F.col("flips_any"), ~F.col("flips_majority"), ~F.col("flips_end")])]), lambda x: x.isNotNull()))
    e = stats.variance_components(rows.select("period", "cluster", "z", kept.alias("v")), ["v", "period"], "cluster", "z").withColumn("e", F.when(F.col("n") > 10, stats.eta2()))
    at = lambda c, i: F.max(F.when(F.col("v") == i, F.col(c)))
    names = ("eta2", "eta2_without_any", "eta2_without_majority", "eta2_without_end")
    return e.groupBy("period").agg(at("n", 0).alias("n"), F.coalesce(at("n", 1), F.lit(0)).alias("n_without_any"), *[F.round(at("e", i), 6).alias(c) for i, c in enumerate(names)])


@query("SELECT event_type, count(*) AS n, round(var_samp(value), 4) AS v FROM events GROUP BY event_type")
def variance_by_category(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.var_samp("value"), 4).alias("v"))


@query("SELECT coalesce(event_type, 'none') AS event_type, count(*) AS n, round(100.0E0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY 1")
def frequency_percent(t):
    kinds = t.events.select(F.coalesce("event_type", F.lit("none")).alias("event_type"))
    return tables.percentages(kinds, ["event_type"]).withColumn("percent", F.round("percent", 4))


@query(f"WITH {LAB} SELECT entity, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS n_yes, CAST(sum(CASE WHEN label THEN 0 ELSE 1 END) AS BIGINT) AS n_no, max_by(label, period) AS last_label FROM lab GROUP BY entity")
def rowwise_label_votes(t):
    days = user_days(t)
    last = days.groupBy("entity").agg(F.max_by("label", "period").alias("last_label"))
    return tables.counts_if(days, ["entity"], n_yes=F.col("label"), n_no=~F.col("label")).join(last, "entity")


@query("SELECT DISTINCT event_type, user_id AS entity FROM events WHERE day(ts) = 3")
def explode_entities(t):
    return t.events.where(F.dayofmonth("ts") == 3).groupBy("event_type").agg(F.collect_set("user_id").alias("users")).select("event_type", F.explode("users").alias("entity"))


sql_query("noise_guard", "SELECT count(*) FILTER (WHERE event_type IS NULL) AS n_null, count(*) FILTER (WHERE value < 0) AS n_negative FROM events")


@query("SELECT count(*) AS n, round(min(value), 4) AS lo, round(max(value), 4) AS hi, count(*) - count(value) AS n_null, count(DISTINCT user_id) AS n_users FROM events")
def table_profile(t):
    p = tables.profile(t.events, "value", "user_id")
    return p.select("n", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n_null", F.col("n_keys").alias("n_users"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_get(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, nullif(regexp_extract(props, '\"k\":\\s*([0-9]+)', 1), '') AS k FROM events")
def regex_label_extract(t):
    return t.events.select("event_id", F.nullif(F.regexp_extract("props", r'"k":\s*([0-9]+)', 1), F.lit("")).alias("k"))


@query(f"WITH {LAB} SELECT entity, bool_or(CASE WHEN period = 1 THEN label END) AS d1, bool_or(CASE WHEN period = 2 THEN label END) AS d2, bool_or(CASE WHEN period = 3 THEN label END) AS d3 FROM lab WHERE period <= 3 GROUP BY entity")
def label_wide_assembly(t):
    wide = user_days(t).groupBy("entity").pivot("period", [1, 2, 3]).agg(F.bool_or("label"))
    return wide.where("`1` is not null or `2` is not null or `3` is not null").select("entity", *[F.col(str(p)).alias(f"d{p}") for p in (1, 2, 3)])
