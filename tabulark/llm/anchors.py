"""Content-chosen anchors, which bring equal windows of different documents together.

In every window of a text the k-gram with the smallest hash (the leftmost of equals) is the window's anchor.
Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so
shuffling one row per anchor finds all windows that may recur at a fraction of a row per position. A
window whose anchor occurs once cannot recur. What anchors let through is confirmed exactly later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh
from .textarrays import gram_hashes, list_array, mix, prefix_hash, slices, sliding_argmin, utf8, word_hashes

FOUND = "array<struct<h:bigint,p:int,lo:int,hi:int>>"


def word_keys(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the word k-grams of all texts, and the first word of each (n + 1 entries)."""
    words, firsts = word_hashes(data, offsets)
    return gram_hashes(words, gram), firsts


def byte_keys(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the byte k-grams of all texts, and the first byte of each (n + 1 entries)."""
    if len(data) < gram:
        return np.zeros(0, dtype=np.uint64), offsets
    sums, inverse = prefix_hash(data)
    return mix((sums[gram:] - sums[: len(data) - gram + 1]) * inverse[: len(data) - gram + 1]), offsets


def of_slice(keys: np.ndarray, firsts: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """Text, hash, place, first and last window start (all within the text) of every anchor."""
    where = sliding_argmin(keys, window - gram + 1)
    starts = np.arange(len(where))
    text = np.searchsorted(firsts, starts, side="right") - 1
    inside = starts + window <= firsts[text + 1]
    starts, where, text = starts[inside], where[inside].astype(np.int64), text[inside]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, none
    opens = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text[1:] != text[:-1])]))
    closes = np.concatenate([opens[1:], [len(starts)]]) - 1
    base = firsts[text[opens]]
    return text[opens], keys[where[opens]], where[opens] - base, starts[opens] - base, starts[closes] - base


def anchors(docs: DataFrame, keys_of, gram: int, window: int) -> DataFrame:
    """``doc_id, t1, t2`` (hashes of the text) and ``a`` (every anchor: hash, place, window starts from ``lo`` to
    ``hi``) for ``doc_id, text``."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for first, end, part, bounds in slices(data, offsets):
                keys, firsts = keys_of(part, bounds, gram)
                text, h, *places = of_slice(keys, np.asarray(firsts), gram, window)
                fields = [pa.array(h.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in places]]
                lists = list_array(pa.StructArray.from_arrays(fields, names=["h", "p", "lo", "hi"]), np.bincount(text, minlength=end - first))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, end - first) for i in range(3)], lists], names=["doc_id", "t1", "t2", "a"])

    read = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    return read.mapInArrow(tasks, f"doc_id bigint, t1 bigint, t2 bigint, a {FOUND}")


def search(docs: DataFrame, keys_of, gram: int, window: int, across_documents: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Where windows may recur: ``doc_id, a`` with the anchors whose hash occurs elsewhere too (in another
    document), and, apart, the copies: ``doc_id`` of documents whose whole text, of a window or more, a
    smaller document has.

    Copies leave first, so that a group of them costs a row each from then on. A hash that a third of all
    rows share is one row a task when it is counted. The hashes that recur, and the texts that several documents
    have, are written before rows are looked up among them, so that both sides of these joins are plain shuffles,
    which Spark cuts at a hot key."""
    found = scratch.write(anchors(docs, keys_of, gram, window), "all")
    texts = found.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    texts = scratch.write(texts, "texts")
    copies = found.select("doc_id", "t1", "t2", (F.size("a") > 0).alias("whole")).join(texts, ["t1", "t2"]).where(F.col("doc_id") != F.col("first"))
    copies = scratch.write(copies.select("doc_id", "whole"), "copies", drop=("texts",))
    found = scratch.write(found.select("doc_id", "a").join(copies, "doc_id", "left_anti"), "anchors", drop=("all",))
    flat = found.select("doc_id", F.inline("a"))
    if across_documents:
        again = flat.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("h")
    else:
        again = flat.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = scratch.write(again, "again")
    hits = flat.join(again, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "p", "lo", "hi")).alias("a"))
    return scratch.write(hits, "hits", drop=("anchors", "again")), copies.where("whole").select("doc_id")


def whole_spans(copies: DataFrame) -> DataFrame:
    """A span ``a, b`` over all of each copy."""
    return copies.select("doc_id", F.lit(0).alias("a"), F.lit((1 << 31) - 1).alias("b"))


def numbers(lists: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds (n + 1 entries) and the flattened fields of a column of lists of structs."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat = lists.flatten()
    return bounds, [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as disjoint ones that do not touch, ascending."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], begins[1:] > reach[:-1]])
    return begins[opens], reach[np.concatenate([opens[1:], [True]])]


def keyed_documents(df: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, text`` with one row per non-null doc_id, and, if rows share a doc_id, those ids with the hash
    ``t`` of their document's text (else None).

    Rows that share a doc_id are one document, with the smallest of their texts (null: empty). Only if a count
    over the ids finds such rows are texts grouped."""
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc_id is not null")
    several = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if several.isEmpty():
        return docs, None
    docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs, docs.join(several, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("t"))


def by_document(spans: DataFrame, shared: DataFrame | None) -> DataFrame:
    """``doc_id, spans, t`` from intervals ``doc_id, a, b``; ``t`` is null where no rows share the doc_id."""
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return lists.withColumn("t", F.lit(None).cast("bigint")) if shared is None else lists.join(shared, "doc_id", "left")


def with_spans(df: DataFrame, spans: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """``df`` with each row's spans ``array<struct<a:int,b:int>>`` (null: none) under a name of its own.

    Of rows that share a doc_id only those with their document's text have its spans."""
    key, name, of = fresh(df, "_span_id"), fresh(df, "_spans"), fresh(df, "_span_text")
    own = spans.select(F.col("doc_id").alias(key), F.col("spans").alias(name), F.col("t").alias(of))
    joined = df.join(own, F.col(f"`{doc_id}`").cast("bigint") == F.col(key), "left")
    same = F.col(of).isNull() | (F.col(of) == F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return joined.withColumn(name, F.when(same, F.col(name))).drop(key, of), name
