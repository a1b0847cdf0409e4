"""Where plans register their queries and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Register a function of ``Tables``; ``oracle`` is SQL for the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def sql_query(name: str, sql: str) -> None:
    """Register one SQL text that Catalyst plans over the Parquet tables and the oracle runs too.

    The tables are views of passing names while the text is analysed: the session keeps none."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, own, views = Tables(spark, sf_dir), sql, []
        for table in TABLES:
            named = re.compile(rf"(?i)\b(FROM|JOIN)(\s+){table}\b")
            if named.search(own):
                views.append(f"__{table}_{uuid.uuid4().hex}")
                getattr(tables, table).createOrReplaceTempView(views[-1])
                own = named.sub(rf"\1\2{views[-1]}", own)
        try:
            return spark.sql(own)
        finally:
            for view in views:
                spark.catalog.dropTempView(view)

    QUERIES[name] = run
    ORACLE[name] = sql
