"""Harvest runs that resume: a versioned manifest that each run commits once, and the run itself.

A manifest is a folder. ``versions/<run>`` is the table a run leaves, and ``CURRENT`` names the run whose table
counts. A run writes its images' rows under its own name, then its version, then swaps ``CURRENT`` by a rename over
the old one. Whatever is repeated before the swap is written again in its place, and after the swap a run of the
same name does nothing: a run repeated after a failure at any point leaves the same manifest and the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import harvest

_TABLE = "type string, next_index bigint, saved bigint"


class Manifest:
    """``type, next_index, saved``: where each type's list goes on, and how many of its images are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The run that was committed last."""
        path, system = self._at("CURRENT")
        return self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0] if system.exists(path) else None

    def read(self) -> DataFrame:
        run = self.current()
        return self.spark.createDataFrame([], _TABLE) if run is None else self.spark.read.schema(_TABLE).parquet(f"{self.path}/versions/{run}")

    def write_version(self, run_id: str, table: DataFrame) -> None:
        table.select("type", F.col("next_index").cast("bigint"), F.col("saved").cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{run_id}")

    def swap(self, run_id: str) -> None:
        """Makes a written version the current one, at once."""
        new, system = self._at(f"CURRENT.{run_id}")
        stream = system.create(new, True)
        stream.write(bytearray(run_id.encode()))
        stream.close()
        jvm, old = self.spark._jvm, self._at("CURRENT")[0]
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, old, over)


def with_total(manifest: DataFrame) -> DataFrame:
    """The manifest with ``global_total``, the images that all types hold by their counts (not by their targets)."""
    # One row: the sum over a table of one row a type.
    total = manifest.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("global_total"))
    return manifest.join(F.broadcast(total))


def as_json(manifest: DataFrame) -> DataFrame:
    """``value``: the manifest as one JSON object, each type's next index and the global total."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.col("next_index").alias("n")))))
    total = F.coalesce(F.sum("saved"), F.lit(0)).cast("bigint")
    return manifest.agg(F.to_json(F.map_concat(entries, F.create_map(F.lit("global_total"), total))).alias("value"))


def harvest_run(articles: DataFrame, manifest: Manifest, targets: DataFrame, run_id: str, images: str) -> DataFrame:
    """One run over ``type, pos, article_id, images`` towards ``type, target``; returns the manifest after it.

    A type goes on at its next index and takes articles whole until its images reach the target; ``images/run_id=…``
    gets ``type, pos, article_id, images, first_number``, numbered on from the images that the type has. A type
    without a manifest row begins at 0; one without a target or without articles left keeps its row."""
    if manifest.current() == run_id:
        return manifest.read()
    known = manifest.read()
    aims = targets.join(known.select("type", F.col("saved").alias("have")), "type", "left")
    taken = harvest.resume_quota(articles, known.select("type", "next_index"), aims)
    numbered = taken.join(known.select("type", "saved"), "type", "left").withColumn("first_number", F.coalesce("saved", F.lit(0)) + F.col("before") + 1)
    files.append_ids(numbered.select("type", "pos", "article_id", "images", "first_number"), images, run_id)
    kept = manifest.spark.read.parquet(f"{images}/run_id={run_id}")
    progress = kept.groupBy("type").agg((F.max("pos") + 1).alias("now"), F.sum("images").alias("more"))
    both = known.join(progress, "type", "full_outer")
    manifest.write_version(run_id, both.select("type", F.coalesce("now", "next_index").alias("next_index"), (F.coalesce("saved", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("saved")))
    manifest.swap(run_id)
    return manifest.read()
