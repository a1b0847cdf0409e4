"""Readers and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.strings import decimal_comma, markdown_cell
from lattica.operators.components import cut
from lattica.operators.vectors import nearest

SUBMISSION = "subreddit string, author string, title string, selftext string, score long"


def read_vector_text(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """entity, embedding of a text file of vectors: a header ``n dim``, then a name and numbers
    on each line. The header and lines of another length are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p"))
    width = F.size("p") - 1
    kept = rows.where(width == dim) if dim else rows.where(width > 1)
    return kept.select(F.col("p")[0].alias("entity"), F.transform(F.slice("p", F.lit(2), width), lambda x: x.cast("float")).alias("embedding"))


def write_vector_text(rows: DataFrame, path: str, entity: str = "entity", vec: str = "embedding", digits: int = 6) -> None:
    """One line ``name v1 ... vd`` for each row; the header is a line of its own part."""
    line = F.concat_ws(" ", F.col(entity), F.array_join(F.transform(vec, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), " "))
    dim = rows.select(F.size(vec)).first()
    head = rows.sparkSession.createDataFrame([(f"{rows.count()} {dim[0] if dim else 0}",)], "value string")
    head.unionByName(rows.select(line.alias("value"))).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = SUBMISSION) -> DataFrame:
    """Rows of JSON lines (plain or compressed); broken lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0), value: the lines of one file with their numbers. Lines are numbered within each
    partition and shifted by the lines of the partitions before, so that no task has them all."""
    rows = cut(spark.read.text(path).withColumn("__at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # one row for each partition of the file
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__part", (before - F.col("__first")).alias("__shift"))
    return rows.withColumn("__part", F.shiftright("__at", 33)).join(shifts, "__part").select((F.col("__at") + F.col("__shift")).cast("long").alias("n"), "value")


def read_vector_folder(spark: SparkSession, folder: str, header: bool = False) -> DataFrame:
    """entity, embedding of a folder with ``vectors.tsv`` (numbers on each line) and
    ``metadata.tsv`` (a name on each line, or the first of several fields): the lines belong
    together by their place. ``header`` says that the names have a first line of their own."""
    vectors = numbered_lines(spark, f"{folder}/vectors.tsv").select("n", F.transform(F.split("value", "\t"), lambda x: x.cast("float")).alias("embedding"))
    names = numbered_lines(spark, f"{folder}/metadata.tsv").select((F.col("n") - int(header)).alias("n"), F.split("value", "\t")[0].alias("entity"))
    return names.join(vectors, "n").select("entity", "embedding")


def drop_empty_columns(rows: DataFrame) -> DataFrame:
    """The rows without the columns that hold nothing but nulls."""
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(rows.columns)]).first()
    return rows.select(*[F.col(f"`{c}`") for i, c in enumerate(rows.columns) if counts[i]])


def batches(rows: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows on the driver, at most ``size`` at a time; one partition is held besides."""
    held: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def write_markdown_table(rows: DataFrame, path: str, digits: int = 2, most: int = 10_000) -> None:
    """One Markdown table of at most ``most`` rows, in the order of the rows' columns: numbers
    with a decimal comma, bars escaped. For reports; more rows are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a table for reading has {most} rows at most")
    cells = [decimal_comma(F.col(f"`{c}`"), digits) if kind in ("double", "float") or kind.startswith("decimal") else F.col(f"`{c}`").cast("string") for c, kind in rows.dtypes]
    line = lambda of: "| " + " | ".join(of) + " |"
    body = rows.orderBy(*[F.col(f"`{c}`") for c in rows.columns]).select(F.concat_ws("", F.lit("| "), F.concat_ws(" | ", *map(markdown_cell, cells)), F.lit(" |")).alias("value"))
    head = [line([c.replace("|", "\\|") for c in rows.columns]), line(["---:" if kind in ("double", "float", "int", "bigint") else "---" for _, kind in rows.dtypes])]
    text = "\n".join([*head, *(r["value"] for r in body.collect())])
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def stored_neighbours(rows: DataFrame, k: int, folder: str, key: str) -> DataFrame:
    """The k nearest neighbours of ``rows`` (id, e unit), read from ``folder`` where they were
    written before under the same ``key``, number and rows, else found and written."""
    state = rows.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("id", "e")), F.lit(0))).first()
    path = f"{folder}/{key}-k{k}-{state[0]}-{state[1] & (2**64 - 1):x}"
    hadoop = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        nearest(rows, k).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Words such as null, nan or NA stay strings; only the empty field is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").option("nanValue", "").csv(path)


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with differing columns as one table, missing ones null."""
    parts = [spark.read.parquet(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_part(pattern: str, group: int = 1) -> Column:
    """What ``pattern`` finds in the name of the row's file, null if nothing."""
    return F.nullif(F.regexp_extract(F.input_file_name(), pattern, group), F.lit(""))


def write_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``rows`` has; running it again changes nothing."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
