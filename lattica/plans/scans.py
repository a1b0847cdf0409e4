"""Queries on sources, sinks and incremental counting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.components import cut
from lattica.plans.registry import Tables, query, sql_query
from lattica.sources import files
from lattica.streaming import accumulate


def scratch(t: Tables, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    cut(t.spark.range(1))
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders")
def multi_file_scan(t):
    path = scratch(t, "parts")
    t.orders.select("o_orderkey", F.year("o_orderdate").alias("y")).write.partitionBy("y").parquet(path)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("SELECT doc_id, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id, role FROM conversations")
def union_by_name(t):
    return t.documents.select("doc_id").unionByName(t.conversations.select(F.col("conv_id").alias("doc_id"), "role"), allowMissingColumns=True)


@query("SELECT doc_id, source, n_chars FROM documents")
def json_lines_scan(t):
    path = scratch(t, "lines")
    files.write_json_lines(t.documents.select("doc_id", "source", "n_chars"), path)
    return files.read_json_lines(t.spark, path, "doc_id long, source string, n_chars long")


@query("SELECT CAST(year(o_orderdate) AS INT) AS period, count(*) AS n FROM orders GROUP BY 1")
def file_metadata(t):
    path = scratch(t, "named")
    t.orders.select("o_orderkey", F.year("o_orderdate").alias("y")).write.partitionBy("y").parquet(path)
    rows = t.spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows.select(files.file_part(r"y=(\d{4})").cast("int").alias("period")).groupBy("period").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(day(ts) AS INT) AS period, count(*) AS n FROM events GROUP BY 1, 2")
def monthly_incremental_counts(t) -> DataFrame:
    source, target, log = scratch(t, "stream"), scratch(t, "counts"), scratch(t, "log")
    rows = t.events.select("event_type", F.dayofmonth("ts").alias("period"))
    rows.repartition(4, "period").write.parquet(source)
    accumulate.accumulate_counts(t.spark, source, "event_type string, period int", ["event_type", "period"], target, log, 2)
    accumulate.accumulate_counts(t.spark, source, "event_type string, period int", ["event_type", "period"], target, log, 2)
    return accumulate.accumulated(t.spark, target, ["event_type", "period"])


sql_query("key_column_profile", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem")
