"""Global row numbers and carries without a one-task window.

Rows are ranged by the ordering columns and written once to the cluster's shared folder, so that every pass
sees the same ranges even after an executor is lost. What the ranges tell each other is one row a range."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_claimed: ContextVar[list[str] | None] = ContextVar("claimed", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a local session (one process) gets a temporary folder; on a cluster, whose executors
    would each write to their own disk, this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own[:] = _own or ["file://" + tempfile.mkdtemp(prefix="tabulark-")]
    return _own[0]


def claim(path: str) -> str:
    """``path``, which goes when the ``owned_tables`` around the call end."""
    held = _claimed.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that jobs write to the shared folder inside are removed at the end, whether it ends well or not.

    Results are lazy and read these tables: write them, or use them up, inside."""
    paths: list[str] = []
    token = _claimed.set(paths)
    try:
        yield
    finally:
        _claimed.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = claim(f"{shared_folder(spark)}/ordinal-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_range``, which counts up along the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def with_global_ordinal(df: DataFrame, order: list[Column], name: str = "rn") -> tuple[DataFrame, int]:
    """``df`` with its row numbers from 1 in the given (total) order, and the row count."""
    rows = ranged(df, order)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("_range", F.coalesce(earlier, F.lit(0)).alias("_begin"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = rows.withColumn("_local", local).join(F.broadcast(begins), "_range")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return numbered.withColumn(name, (F.col("_begin") + F.col("_local")).cast("bigint")).drop("_range", "_local", "_begin"), total


def with_next_valid(df: DataFrame, key: str, valid: Column, name: str) -> DataFrame:
    """``df`` with the key of the first valid row from each row on, in key order and around the end.

    Null if no row is valid. Ranges pass on their first valid key, one row each."""
    rows = ranged(df.withColumn("_valid", F.when(valid, F.col(key))), [F.col(key)])
    on = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = rows.groupBy("_range").agg(F.min("_valid").alias("_first"))
    after = F.min("_first").over(Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing))
    carries = firsts.select("_range", after.alias("_after"), F.min("_first").over(Window.partitionBy()).alias("_any"))
    own = F.first("_valid", ignorenulls=True).over(on)
    found = rows.withColumn("_own", own).join(F.broadcast(carries), "_range")
    return found.withColumn(name, F.coalesce("_own", "_after", "_any")).drop("_range", "_own", "_after", "_any", "_valid")


def with_group_carry(df: DataFrame, by: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``by`` that come earlier in the given (total) order.

    Each range passes on one row for each ``by`` in it, so that a large group is many tasks; these rows grow with
    the groups, and are joined, not broadcast."""
    rows = ranged(df.withColumn("_value", value), [F.col(by), *order])
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range", by).agg(F.sum("_value").alias("_n"))
    begin = F.coalesce(F.sum("_n").over(earlier.partitionBy(by).orderBy("_range")), F.lit(0))
    begins = sums.select(F.col("_range").alias("_at"), F.col(by).alias("_by"), begin.alias("_begin"))
    local = F.coalesce(F.sum("_value").over(earlier.partitionBy("_range", by).orderBy(*order)), F.lit(0))
    same = (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by"))
    found = rows.withColumn("_local", local).join(begins, same)
    return found.withColumn(name, (F.col("_begin") + F.col("_local")).cast("bigint")).drop("_value", "_range", "_at", "_by", "_begin", "_local")
