"""Columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_cell(value: Column) -> Column:
    """The value as a cell of a Markdown table: bars escaped, line ends as spaces, null as nothing."""
    return F.coalesce(F.regexp_replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit(""))


def decimal_comma(value: Column, digits: int, sign: bool = False) -> Column:
    """A number with a comma and ``digits`` places; negative ones with a typographic minus, and
    with ``sign`` a plus before positive ones. Null stays null."""
    shown = F.replace(F.format_string(f"%.{digits}f", F.abs(value.cast("double"))), F.lit("."), F.lit(","))
    rounded = F.round(value.cast("double"), digits)
    return F.when(value.isNotNull(), F.concat(F.when(rounded < 0, "\u2212").when(F.lit(sign) & (rounded > 0), "+").otherwise(""), shown))


def complete_prefix(names: DataFrame, typed: DataFrame, name: str = "name", prefix: str = "prefix") -> DataFrame:
    """The rows of ``typed`` with ``full``: the one of ``names`` that its prefix starts, or is; null
    where none or several do. ``typed`` is what people enter: it is the small side."""
    known = names.select(F.col(name).alias("__name")).where("__name is not null").distinct()
    rows = typed.select(F.col(prefix).alias("__p")).where("__p is not null").distinct()
    found = known.join(rows, F.startswith(F.col("__name"), F.col("__p")))
    one = found.groupBy("__p").agg(F.count("*").alias("__n"), F.max("__name").alias("__any"), F.max(F.when(F.col("__name") == F.col("__p"), F.col("__name"))).alias("__exact"))
    one = one.select("__p", F.coalesce("__exact", F.when(F.col("__n") == 1, F.col("__any"))).alias("full"))
    return typed.join(one, F.col(prefix) == F.col("__p"), "left").drop("__p")
