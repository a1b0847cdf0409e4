"""Token counts, TF-IDF by entity and by class, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import cut

TOKEN = r"[\p{L}]+"


def tokens(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys..., token: every run of letters of the lower-cased text."""
    return docs.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("token"))


def token_counts(docs: DataFrame, *keys: str) -> DataFrame:
    return tokens(docs, *keys).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def without_tokens(counts: DataFrame, stop: DataFrame) -> DataFrame:
    """Left-anti join: unlike NOT IN it needs no null-aware plan."""
    return counts.join(stop, "token", "left_anti")


def document_frequency(counts: DataFrame, doc: str, period: str) -> DataFrame:
    return counts.select(period, doc, "token").distinct().groupBy(period, "token").agg(F.count("*").alias("df"))


def tf_idf(counts: DataFrame, doc: str, period: str) -> DataFrame:
    """doc, period, token, tfidf = n / total * ln(N / df), with N and df by period.

    The counts are written down once: totals, document frequencies and N all come from them."""
    counts = cut(counts.select(doc, period, "token", "n"))
    totals = counts.groupBy(period, doc).agg(F.sum("n").alias("total"))
    sizes = totals.groupBy(period).agg(F.count("*").alias("docs"))
    df = counts.groupBy(period, "token").agg(F.count("*").alias("df"))  # a row for each document and token
    rows = counts.join(totals.join(sizes, period), [period, doc]).join(df, [period, "token"])
    return rows.select(doc, period, "token", (F.col("n") / F.col("total") * F.ln(F.col("docs") / F.col("df"))).alias("tfidf"))


def class_tf_idf(counts: DataFrame, cluster: str, period: str) -> DataFrame:
    """cluster, period, token, ctfidf = n / total * ln(1 + A / f): f is the token's count over
    clusters, A the mean total of the period's clusters. The counts are written down once."""
    counts = cut(counts.select(cluster, period, "token", "n"))
    totals = counts.groupBy(period, cluster).agg(F.sum("n").alias("total"))
    mean = totals.groupBy(period).agg(F.avg("total").alias("a"))
    f = counts.groupBy(period, "token").agg(F.sum("n").alias("f"))
    rows = counts.join(totals.join(mean, period), [period, cluster]).join(f, [period, "token"])
    return rows.select(cluster, period, "token", (F.col("n") / F.col("total") * F.ln(1 + F.col("a") / F.col("f"))).alias("ctfidf"))


def top(rows: DataFrame, by: list[str], value: str, k: int, *ties: str) -> DataFrame:
    """The k best of each group with their rank; the window's group limit prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), *ties))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def valid_text(text: Column, least: int = 20) -> Column:
    """Whether at least so many characters are left without links."""
    return F.length(F.trim(F.regexp_replace(text, r"https?://\S+", ""))) >= least


def is_bot(author: Column, known: list[str]) -> Column:
    name = F.lower(author)
    return name.isin(known) | F.endswith(name, F.lit("bot")) | F.startswith(name, F.lit("bot_"))


def numbered(items: Column) -> Column:
    """One text of numbered lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.replace(x, F.lit("\n"), F.lit(" ")))), "\n")


def shortened(prompt: Column, most: int = 500) -> Column:
    """Numbered lines cut to ``most`` characters, with a mark."""
    cut = F.transform(F.split(prompt, "\n"), lambda x: F.when(x.rlike(r"^\d+\. ") & (F.length(x) > most), F.concat(F.left(x, F.lit(most)), F.lit(" [...]"))).otherwise(x))
    return F.array_join(cut, "\n")
