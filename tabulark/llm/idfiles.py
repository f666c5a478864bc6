"""Token-id files: whole texts encoded, written in document order as coded frames, and read back.

A frame is one row ``file, frame, start, doc_ids, doc_tokens, blocks``: some whole documents whose ids,
concatenated, are cut into blocks of :mod:`idcoder`. ``start`` counts the ids of the file before the
frame. Files are range partitions of the document ids, so file order is document order. The rows
are kept in Parquet, whose commit protocol makes a write by many executors, some lost, safe. A table
``_files`` beside them says how many frames and ids each file has, so that reading notices what is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import idcoder
from .scratch import parts
from .tokenize import on_workers

FRAME_IDS = 1 << 16
FRAMES_AT_ONCE = idcoder.LANES * idcoder.BLOCK_IDS

FRAME = "file int, frame bigint, start bigint, doc_ids array<bigint>, doc_tokens array<bigint>, blocks binary"
_FRAME = pa.schema(
    [("file", pa.int32()), ("frame", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("blocks", pa.binary())]
)
_IDS = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _coded(frames: list[tuple], largest: int) -> pa.RecordBatch:
    """Frames of (file, frame, start, doc_ids, doc_tokens, ids) with their ids coded side by side."""
    cut = [[f[5][i : i + idcoder.BLOCK_IDS] for i in range(0, len(f[5]), idcoder.BLOCK_IDS)] for f in frames]
    coded = iter(idcoder.encode([b for blocks in cut for b in blocks], largest))
    payloads = [b"".join(next(coded) for _ in blocks) for blocks in cut]
    columns = [*zip(*[f[:5] for f in frames], strict=True), payloads]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FRAME.types, strict=True)], schema=_FRAME)


def encode_frames(df: DataFrame, vocabulary: str, end_id: int, largest: int = 65535, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The frames of all rows, in ascending ``doc_id`` (null first, equal ids by a hash of their text and then by it).

    The hash parts rows that share an id, or have none, among files like any others."""
    encoder = on_workers(df.sparkSession, vocabulary)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(), np.array([end_id], dtype="<u4").tobytes()
        file, frame, start = TaskContext.get().partitionId(), 0, 0
        ready: list[tuple] = []
        docs: list[tuple] = []
        size = held = 0

        def close() -> None:
            nonlocal frame, start, docs, size, held
            ready.append((file, frame, start, [d for d, _ in docs], [len(i) // 4 for _, i in docs], np.frombuffer(b"".join(i for _, i in docs), dtype="<u4")))
            frame, start, held, docs, size = frame + 1, start + size, held + size, [], 0

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                ids += end
                if docs and size + len(ids) // 4 > FRAME_IDS:
                    close()
                docs.append((key, ids))
                size += len(ids) // 4
                if held >= FRAMES_AT_ONCE:
                    yield _coded(ready, largest)
                    ready, held = [], 0
        if docs:
            close()
        if ready:
            yield _coded(ready, largest)

    read = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    place = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = read.repartitionByRange(parts(df.sparkSession), *place).sortWithinPartitions(*place, "text")
    return ordered.mapInArrow(tasks, FRAME)


def decode_frames(frames: DataFrame, largest: int = 65535) -> DataFrame:
    """One row per document: ``file, doc_id, start`` (within the file), ``n_tokens, ids`` (little-endian u32).

    Raises :class:`idcoder.CorruptBlock` where a block fails its checks."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def decoded() -> Iterator[pa.RecordBatch]:
            blocks: list[bytes] = []
            counts = []
            for f in held:
                payload, at, first = f["blocks"], 0, len(blocks)
                while at < len(payload):
                    words = int(np.frombuffer(payload, dtype="<u4", count=1, offset=at + 8)[0]) if at + 16 <= len(payload) else 0
                    blocks.append(payload[at : at + 16 + 4 * words])
                    at += 16 + 4 * words
                counts.append(len(blocks) - first)
            ids = iter(idcoder.decode(blocks, largest))
            for f, n in zip(held, counts, strict=True):
                raw = b"".join(next(ids).tobytes() for _ in range(n))
                if len(raw) != 4 * sum(f["doc_tokens"]):
                    raise idcoder.CorruptBlock("a frame's length")
                ends = np.cumsum(f["doc_tokens"])
                begins = ends - f["doc_tokens"]
                columns = [[f["file"]] * len(ends), f["doc_ids"], begins + f["start"], f["doc_tokens"], [raw[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _IDS.types, strict=True)], schema=_IDS)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += sum(row["doc_tokens"])
                if size >= FRAMES_AT_ONCE:
                    yield from decoded()
                    held, size = [], 0
        if held:
            yield from decoded()

    return frames.select("file", "frame", "start", "doc_ids", "doc_tokens", "blocks").mapInArrow(tasks, "file int, doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _files(frames: DataFrame) -> DataFrame:
    """``file, frames, ids``: a row per file, whose number the cluster sets, not the data."""
    ids = F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return frames.groupBy("file").agg(F.count(F.lit(1)).alias("frames"), F.sum(ids).alias("ids"))


def write_ids(df: DataFrame, path: str, vocabulary: str, end_id: int, **names: str) -> None:
    encode_frames(df, vocabulary, end_id, **names).write.mode("overwrite").parquet(path)
    _files(df.sparkSession.read.schema(FRAME).parquet(path)).write.mode("overwrite").parquet(f"{path}/_files")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids``.

    Defined results: a null or empty text is a document of the end id alone; null doc_ids come first
    and stay null; equal doc_ids are ordered by a hash of their text; a very long text is one document of one
    frame, whose ids are held whole; an empty table gives no rows; other columns are not written. A file or frame that is missing raises."""
    frames = spark.read.schema(FRAME).parquet(path)
    written = spark.read.schema("file int, frames bigint, ids bigint").parquet(f"{path}/_files")
    before = F.coalesce(F.sum("w.ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.col("w.frames").eqNullSafe(F.col("r.frames")) & F.col("w.ids").eqNullSafe(F.col("r.ids"))
    both = written.alias("w").join(_files(frames).alias("r"), "file", "full_outer")
    missing = F.raise_error(F.lit("frames or files are missing")).cast("bigint")
    offsets = both.select("file", F.when(whole, before).otherwise(missing).alias("before"))
    return decode_frames(frames).join(F.broadcast(offsets), "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
