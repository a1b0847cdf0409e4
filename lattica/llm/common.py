"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker takes up at once.
SLICE_BYTES = 2 << 20
#: Rows of a narrow table in one partition of a checkpoint.
PARTITION_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where neither the session nor the context names one, a temporary folder is set on a local
    master, whose driver and executors are one process; elsewhere that is an error, as executors
    would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return jsc.getCheckpointDir().get()


def merges_partitions(spark: SparkSession) -> bool:
    """Whether Spark puts a shuffle's small partitions together by itself."""
    return all(spark.conf.get(f"spark.sql.adaptive.{x}") == "true" for x in ("enabled", "coalescePartitions.enabled"))


def durable(df: DataFrame, rows: int | None = None, waves: int = 1) -> DataFrame:
    """Cut lineage with an eager reliable checkpoint in the shared folder.

    Every partition becomes a file. Where Spark doesn't put small partitions together, a narrow
    table of about so many ``rows`` is put into no more than tasks run at once (``waves`` times)
    or ``PARTITION_ROWS`` asks for.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    if rows is not None and not merges_partitions(spark):
        parts = max(waves * spark.sparkContext.defaultParallelism, rows // PARTITION_ROWS + 1)
        if parts < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(parts)
    return df.checkpoint(eager=True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def running_offsets(counts: DataFrame, keys: list[str], lane: str, n: str, out: str) -> DataFrame:
    """Exclusive prefix sums of ``n`` over ``lane`` inside ``keys``.

    ``counts`` has one row for each key and lane, so its windows hold at most as many rows as
    there are lanes, however many rows a key has.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into a new folder of the shared checkpoint folder and read it back."""
    path = f"{_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(stored_table: DataFrame) -> None:
    """Delete the folder that ``stored`` wrote for this table, which nothing reads any more."""
    spark = stored_table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in stored_table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if path.getName().startswith("stored-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, column: str, most_bytes: int = SLICE_BYTES):
    """The batches' rows in batches of about ``most_bytes`` of the string ``column``, so that what
    a worker makes of them stays bounded; a longer value is a batch of its own. Batches without a
    row go through."""
    for batch in batches:
        n = batch.num_rows
        if batch.column(column).nbytes <= most_bytes or n < 2:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end


_HELD: list = [None, None]


def worker_keeps(key: tuple, build: Callable[[], object]):
    """What ``build`` makes, kept by a worker process from task to task until it is asked for
    something else: a worker that goes on to another operator keeps nothing of the last one."""
    if _HELD[0] != key:
        _HELD[:] = None, None
        pa.default_memory_pool().release_unused()
        _HELD[:] = key, build()
    return _HELD[1]


def with_totals(rows: DataFrame, key: str, spread: str, totals: dict[str, Column], having: Column | None = None) -> DataFrame:
    """``rows`` with aggregates over ``key`` added; of the keys whose totals fit ``having``.

    One key may have most of the rows: they are dealt into 64 parts by a hash of ``spread``, and a
    key's totals go to those of the parts that it has, so that no task gets all rows of a key.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(64)).cast("int"))
    sums = salted.groupBy(key).agg(*[c.alias(n) for n, c in totals.items()], F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__salt"))).alias("__parts"))
    if having is not None:
        sums = sums.where(having)
    there = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("__parts"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return salted.join(sums.withColumn("__salt", F.explode(there)).drop("__parts"), [key, "__salt"]).drop("__salt")
