"""Label documents as a stream: each is validated by its own kind as it comes, bad ones go to quarantine.

A batch is one pass and one write: its rows lie under its number, good and bad ones in partitions of it, so that a
batch written again after a failure replaces itself. Its counts are observed on the way and kept under the same
number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents
from ..operators.samples import class_field


def label_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10_000) -> DataFrame:
    """``chart_type, body`` of label files, one document each."""
    read = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger)
    return read.format("text").load(folder).select(class_field(F.col("value")).alias("chart_type"), F.col("value").alias("body"))


def reason(body: Column) -> Column:
    """Null for a complete document of a known kind; else why it goes to quarantine: it is "unreadable" (no JSON
    object, or cut short), of an "unknown kind", or "incomplete" (a required field, nested ones too, is missing)."""
    parsed = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    kind = class_field(body)
    complete = F.lit(False)
    for name in documents.SCHEMAS:
        complete = F.when(kind == name, documents.is_complete(body, name)).otherwise(complete)
    return F.when(~is_object, "unreadable").when(~kind.isin(*documents.SCHEMAS), "unknown kind").when(~F.coalesce(complete, F.lit(False)), "incomplete")


def start_ingest(stream: DataFrame, path: str, checkpoint: str, body: str = "body") -> StreamingQuery:
    """Writes ``path/rows/batch=…/verdict=good|bad`` (bad rows with their ``reason``) and ``path/counts/batch=…``."""

    def write(batch: DataFrame, number: int) -> None:
        why = batch.withColumn("reason", reason(F.col(body)))
        judged = why.withColumn("verdict", F.when(F.col("reason").isNull(), "good").otherwise("bad"))
        seen = Observation(f"ingest-{number}")
        bad = F.count(F.when(F.col("verdict") == "bad", 1))
        watched = judged.observe(seen, F.count(F.lit(1)).alias("rows"), bad.alias("bad"))
        watched.write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/rows/batch={number}")
        counts = batch.sparkSession.createDataFrame([(seen.get["rows"], seen.get["bad"])], "rows bigint, bad bigint")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The bad rows of all batches, with their reasons."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").where("verdict = 'bad'")
