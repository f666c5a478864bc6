"""Corpus preparation in four stages: quality rules, near-duplicate removal, substring deduplication, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads it back for the next; only the last
one's stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulark.functions.ordinal import owned_tables
from tabulark.llm import neardup, packing, quality, suffixes
from tabulark.llm.queries import vocabulary
from tabulark.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A null or empty text has no words and goes; repeated rows are judged each;
    an empty table stays empty; columns of any name stay."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word shingles, 0.8).

    Documents without words and those with a null doc_id stay; of rows repeated with one doc_id all stay or all go;
    other columns are carried, and an empty table stays empty."""
    return neardup.keep_one(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that also start earlier.

    A null text stays null, a text may become empty; a null doc_id is compared with nothing; rows repeated with one
    doc_id are one document; n_chars follows the text; other columns are carried; an empty table stays empty."""
    return suffixes.without_repeated(docs, width=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 tokens. A null or empty text is the end id alone; a null doc_id stays null;
    repeated rows are packed each; other columns are not read; an empty table gives no pieces."""
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Packing needs a tokenizer, which SQL does not have; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), ()
    for name, stage in STAGES:
        # A stage's own tables go when it is written, its input when the next stage's is.
        with owned_tables(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), name, drop=before)
        before = (name,)
    return docs
