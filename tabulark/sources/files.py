"""File sources: labels, images, word and id lists, inventories; and the quarantine of unreadable images."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import integrity
from ..functions.ordinal import written


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^.]+$", 1)


def folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_labels(spark: SparkSession, folder: str, skip_root: bool = False) -> DataFrame:
    """``category, base_name, body, label_path`` of every .json below; bad UTF-8 becomes U+FFFD."""
    path = F.col("_metadata.file_path")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    found = read.select(folder_of(path).alias("category"), base_name(path).alias("base_name"), F.col("content").cast("string").alias("body"), path.alias("label_path"))
    # Spark puts only a few files in a task, by what opening them may cost elsewhere: that would be very many tasks.
    found = found.coalesce(_parts(spark))
    return found.where(F.col("category") != folder.rstrip("/").rsplit("/", 1)[-1]) if skip_root else found


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_labels(labels: DataFrame, folder: str, per_file: int = 1) -> None:
    """Adds a .json file for each row's ``body`` in the folder of its ``category`` (a folder's name; null: ``folder``
    itself), or for up to ``per_file`` rows of a category, as lines.

    Tasks write through the file system that ``folder`` names (a shared one), first under a name of their own, so
    that a task that is run again leaves the same whole files."""
    spark, job = labels.sparkSession, uuid.uuid4().hex
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    # Where Spark would write it; pyarrow wants a local file's two slashes.
    target = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    target = re.sub("^file:/(?!/)", "file:///", target)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        task, own, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        held: dict[str | None, list[str]] = {}
        folders: dict[str | None, str] = {}

        def write(category: str | None) -> int:
            if category not in folders:
                folders[category] = root if category is None else f"{root}/{category}"
                system.create_dir(folders[category], recursive=True)
            with system.open_output_stream(f"{folders[category]}/.{own}") as out:
                out.write("".join(f"{x}\n" for x in held.pop(category)).encode())
            system.move(f"{folders[category]}/.{own}", f"{folders[category]}/part-{task:05d}-{made:08d}-{job}.json")
            return made + 1

        for batch in batches:
            for category, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(category, []).append("" if body is None else body)
                if len(held[category]) == per_file:
                    made = write(category)
        for category in list(held):
            made = write(category)
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["files"])

    rows = labels.select(F.col("category").cast("string"), F.col("body").cast("string"))
    # A file costs far more than a row's bytes, by which Spark makes its tasks.
    rows.repartition(_parts(spark)).mapInArrow(tasks, "files bigint").write.format("noop").mode("overwrite").save()


def read_images(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg}") -> DataFrame:
    """``category, base_name, extension, image_path, length, content``; unused columns are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.col("path")
    return read.select(folder_of(path).alias("category"), base_name(path).alias("base_name"), F.regexp_extract(path, r"\.([^.]+)$", 1).alias("extension"), path.alias("image_path"), "length", "content")


def is_image(content: Column) -> Column:
    """A whole PNG or JPEG file."""
    return integrity.damage(content).isNull()


def quarantined(images: DataFrame) -> DataFrame:
    """``image_path, length, reason`` of files that are no whole image."""
    reason = integrity.damage(F.col("content"))
    return images.select("image_path", "length", reason.alias("reason")).where("reason IS NOT NULL")


def write_quarantine(images: DataFrame, path: str, run_id: str) -> None:
    """Appends the images that are not whole under their run; a run that is written again replaces itself."""
    append_ids(quarantined(images), path, run_id)


def decodable(spark: SparkSession, folder: str) -> DataFrame:
    """``image_path, width, height`` of files that Spark's image source decodes, as a second opinion."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    return read.select(F.col("image.origin").alias("image_path"), "image.width", "image.height")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``pos, id``: the lines of an id list in their order, blanks around them cut; repeats and empty lines stay.

    A list is a file, or a folder of files in the order of their names. Each split of a file is a task: lines are
    numbered within their split, and splits pass on how many lines they have, so that position, which a run resumes
    from, does not depend on where a file was cut."""
    file, begin = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    # Within a task the numbers go up with the lines; the table is written so that every pass sees the same ones.
    lines = written(spark.read.text(path).select(file.alias("_file"), begin.alias("_begin"), F.monotonically_increasing_id().alias("_line"), F.trim("value").alias("id")))
    splits = written(lines.groupBy("_file", "_begin").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a split, some 128 MB of lines each.
    placed = splits.withColumn("_before", before).drop("_n")
    return lines.join(placed, ["_file", "_begin"]).select((F.col("_before") + F.col("_line") - F.col("_first")).alias("pos"), "id")


def append_ids(ids: DataFrame, path: str, run_id: str, mode: str = "overwrite") -> None:
    """Appends ``ids`` to the runs before, under their own run. A run that is written again replaces itself, so that a
    retry adds nothing; with ``mode="append"`` it adds to itself, as lines added to a file do."""
    ids.write.mode(mode).parquet(f"{path}/run_id={run_id}")


def write_vocabulary(words: DataFrame, path: str) -> None:
    """A JSON array of the words in ``pos`` order, as ``read_vocabulary`` reads it; a bounded sample, so one row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    words.agg(F.to_json(ordered).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_vocabulary(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """``pos, word`` from a JSON array of strings; the default where there is none."""
    try:
        found = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "word"))
        return default if found.isEmpty() else found
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return default
        raise


def inventory(images: DataFrame, kinds: list[str]) -> DataFrame:
    """``type, n``: files per type, 0 for a type without a folder."""
    names = images.sparkSession.createDataFrame([(k,) for k in kinds], "type string")
    counts = images.groupBy(F.col("category").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
