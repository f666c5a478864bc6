"""Sum-of-squares online packing of token sequences into windows of fixed length.

Every task packs the documents that it reads, in the order it reads them, with no shuffle. A level
array counts the open windows of each fill level; a document goes to the level at which the sum of
the squared counts of partially filled windows rises least (a new window is level 0; ties take the
fullest). A document longer than a window first fills whole windows of its own. At the end of a task, and
where more than ``MOST_OPEN`` windows are open, which bounds its memory, the open windows are topped up from the
emptiest ones by cutting pieces, so that one window a task is left with padding.

How many windows are still open depends on the lengths, hardly on the number of documents: of the windows
that hold more than one piece, placement closes most in a task of some thousand documents (``closed_by``
counts them), and few in one of some hundred. Small partitions are therefore read together (``LEAST_BYTES``, by
the planner's estimate of what is read).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenize import on_workers

MOST_OPEN = 1 << 14
LEAST_BYTES = 4 << 20
ROWS_OUT = 2048

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


class SumOfSquares:
    """The open windows of one task. A piece is (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, window: int, first_sequence: int = 0, most_open: int = MOST_OPEN):
        self.window, self.sequence, self.most_open = window, first_sequence, most_open
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window)]
        self.open = 0
        self.closed: list[list] = []
        self.closed_by = {"whole": 0, "placed": 0, "topped": 0}

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for at in range(0, whole, self.window):
            self._close([(doc_id, at, total, ids[4 * at : 4 * (at + self.window)])], "whole")
        if whole < total:
            self._place((doc_id, whole, total, ids[4 * whole :]), total - whole)
        if self.open > self.most_open:
            self.top_up()

    def _close(self, window: list, how: str) -> None:
        self.closed.append(window)
        self.closed_by[how] += 1

    def best_level(self, size: int) -> int:
        """The level whose use adds least to the sum of squared counts, or 0 for a new window."""
        top = self.window - size
        now, then = self.counts[: top + 1], self.counts[size : self.window + 1]
        change = 2 * (then - now) + 2
        change[-1] = 1 - 2 * now[-1]  # the window becomes full and leaves the count
        usable = now > 0
        usable[0] = True
        change[0] = 2 * then[0] + 1 if top else 0  # no window of level 0 is counted
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return top - int(np.argmin(change[::-1]))

    def _place(self, piece: tuple, size: int) -> None:
        level = self.best_level(size)
        if level:
            window = self.levels[level].pop()
            self.counts[level] -= 1
        else:
            window = []
            self.open += 1
        window.append(piece)
        if level + size == self.window:
            self.open -= 1
            self._close(window, "placed")
            return
        self.levels[level + size].append(window)
        self.counts[level + size] += 1

    def top_up(self, last: bool = False) -> None:
        """Close all open windows by moving cut pieces from the emptiest to the fullest."""
        still = [(level, w) for level in range(self.window - 1, 0, -1) for w in self.levels[level]]
        self.levels = [[] for _ in range(self.window)]
        self.counts[:] = 0
        self.open = 0
        low, high = 0, len(still) - 1
        while low < high:
            level, window = still[low]
            need = self.window - level
            while need and low < high:
                other_level, other = still[high]
                doc_id, start, total, ids = other.pop()
                size = len(ids) // 4
                take = min(size, need)
                window.append((doc_id, start, total, ids[: 4 * take]))
                if take < size:
                    other.append((doc_id, start + take, total, ids[4 * take :]))
                need -= take
                still[high] = (other_level - take, other)
                if not other:
                    high -= 1
            if need:
                still[low] = (self.window - need, window)
                break
            self._close(window, "topped")
            low += 1
        if low <= high and still:
            level, window = still[low]
            if level == self.window or last:
                self._close(window, "topped")
            else:
                self.levels[level].append(window)
                self.counts[level] += 1
                self.open = 1

    def rows(self) -> Iterator[tuple]:
        for window in self.closed:
            offset = 0
            for doc_id, start, total, ids in window:
                yield doc_id, start, len(ids) // 4, total, self.sequence, offset, ids
                offset += len(ids) // 4
            self.sequence += 1
        self.closed = []


def pack(df: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian u32).

    A document is the ids of its whole text (null: empty) and then ``end_id``. Sequence ids are unique,
    not gapless; offsets are gapless from 0 in each sequence. Defined results: a null or empty text is a
    document of the end id alone; a null doc_id stays null; rows that repeat are packed each; an empty
    table gives no pieces; other columns of the input are not read, whatever their names.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(), np.array([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        packer = SumOfSquares(window, (context.partitionId() if context else 0) << 40)

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            rows = list(packer.rows()) if len(packer.closed) >= least else []
            for at in range(0, len(rows), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + ROWS_OUT], strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                packer.add(key, ids + end)
                yield from ready(512)
        packer.top_up(last=True)
        yield from ready(1)

    read = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # An estimate from the files' sizes, without reading them; where there is none, partitions stay as they are.
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    encoder = on_workers(df.sparkSession, vocabulary)
    together = read.coalesce(1 + size // LEAST_BYTES) if size // LEAST_BYTES < 1 << 30 else read
    return together.mapInArrow(tasks, SCHEMA)
