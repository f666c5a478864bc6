"""Written tables in the cluster's shared folder, used to cut lineage between the phases of a job.

The folder is the session's ``spark.checkpoint.dir`` (see :func:`tabulark.functions.ordinal.shared_folder`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.ordinal import claim, shared_folder

#: Spark's setting to remove a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of how many bytes (and one row more) a Python worker gets at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """The written tables of one job.

    A lost executor costs at most the tasks of the running phase: finished phases are files. Tables
    that a later phase no longer reads are dropped as soon as their successor is written, and Spark
    removes the shuffle files of a phase when its write has ended. What the result still reads goes with the
    ``owned_tables`` around the job.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = claim(f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, drop: tuple[str, ...] = (), batch_bytes: int | None = None, **options: str) -> DataFrame:
        """``df`` as a table, written with the writer's ``options``; its Python workers get ``batch_bytes`` at once."""
        settings = {CLEANUP: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
        was = {k: self.spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").options(**options).parquet(self.path(name))
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)
        for old in drop:
            self.drop(old)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name for internal use that the frame does not have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
