"""Entity-period panels: scores, standardisation, membership and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import ranks


def entity_period_scores(rows: DataFrame, entity: str, period: Column, score: str, cluster: str) -> DataFrame:
    """entity, period, score (mean), cluster, n of each entity and period."""
    return rows.groupBy(F.col(entity).alias("entity"), period.cast("int").alias("period")).agg(F.avg(score).alias("score"), F.max(cluster).alias("cluster"), F.count("*").alias("n"))


def zscore_by_base(panel: DataFrame, base: int, score: str = "score", out: str = "z") -> DataFrame:
    """Standardise by mean and sample deviation of the base period; one row of statistics is
    broadcast, so the panel is not shuffled."""
    stats = panel.where(F.col("period") == base).agg(F.avg(score).alias("__m"), F.stddev_samp(score).alias("__s"))
    return panel.crossJoin(F.broadcast(stats)).withColumn(out, F.try_divide(F.col(score) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def percent_rank_extremity(panel: DataFrame, score: str = "score") -> DataFrame:
    """Adds pct (percent rank within the period, ties equal) and extremity |pct - 0.5| * 2; rows
    without a score are left out."""
    return ranks.percent_ranked(panel, ["period"], score).withColumn("extremity", F.abs(F.col("pct") - 0.5) * 2)


def minmax(panel: DataFrame, score: str = "score") -> DataFrame:
    """Adds scaled: the score's place between its period's extremes, null where they are equal."""
    ends = panel.groupBy("period").agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    return panel.join(ends, "period").withColumn("scaled", F.try_divide(F.col(score) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def complete_entities(panel: DataFrame, n_periods: int) -> DataFrame:
    """Entities present in ``n_periods`` periods."""
    return panel.groupBy("entity").agg(F.count_distinct("period").alias("n_periods")).where(F.col("n_periods") == n_periods).select("entity")


def balanced(panel: DataFrame, n_periods: int) -> DataFrame:
    return panel.join(complete_entities(panel, n_periods), "entity", "left_semi")


def static_label(labels: DataFrame, base: int) -> DataFrame:
    """One label per entity: the base period's, else what all later ones agree on, else null."""
    first = F.bool_or(F.when(F.col("period") == base, F.col("label")))
    later = F.col("period") > base
    every, some = F.bool_and(F.when(later, F.col("label"))), F.bool_or(F.when(later, F.col("label")))
    agreed = labels.groupBy("entity").agg(first.alias("b"), every.alias("e"), some.alias("s"))
    return agreed.select("entity", F.coalesce("b", F.when(F.col("e") == F.col("s"), F.col("e"))).alias("label"))


def entry_period(panel: DataFrame, value: str | None = None) -> DataFrame:
    """entity, entry (first period), and the value held then."""
    extra = [F.min_by(value, "period").alias(f"entry_{value}")] if value else []
    return panel.groupBy("entity").agg(F.min("period").alias("entry"), *extra)


def last_valid(panel: DataFrame, value: str) -> DataFrame:
    """entity, last period with a value, and that value."""
    kept = panel.where(F.col(value).isNotNull())
    return kept.groupBy("entity").agg(F.max("period").alias("last_period"), F.max_by(value, "period").alias("last_value"))


def attrition(panel: DataFrame, population: DataFrame, periods: list[int]) -> DataFrame:
    """period, n_population, n_present, n_absent of a fixed population."""
    grid = population.sparkSession.createDataFrame([(p,) for p in periods], "period int")
    here = population.crossJoin(F.broadcast(grid)).join(panel.select("entity", "period").distinct().withColumn("here", F.lit(True)), ["entity", "period"], "left")
    return here.groupBy("period").agg(F.count("*").alias("n_population"), F.count_if("here").alias("n_present"), F.count_if(F.col("here").isNull()).alias("n_absent"))


def label_status(labels: DataFrame, base: int) -> DataFrame:
    """entity, status: where the static label comes from. A, B: the base period's verdict is no or
    yes; C, D: it is filled in from later periods, no or yes; E: there is none."""
    there = labels.groupBy("entity").agg(F.bool_or((F.col("period") == base) & F.col("label").isNotNull()).alias("__base"))
    label = F.col("label")
    status = F.when(F.col("__base") & ~label, "A base no").when(F.col("__base") & label, "B base yes").when(~label, "C later no").when(label, "D later yes").otherwise("E open")
    return static_label(labels, base).join(there, "entity").select("entity", status.alias("status"))


def provenance(populations: DataFrame, status: DataFrame) -> DataFrame:
    """basis, status, n, percent of ``populations`` (basis, entity); F: an entity without any label."""
    known = populations.join(status, "entity", "left").groupBy("basis", F.coalesce("status", F.lit("F no entry")).alias("status")).agg(F.count("*").alias("n"))
    return known.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("basis")))
