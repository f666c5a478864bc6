"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Every word shingle is hashed once. The high bits choose one of ``bins`` bins, the rest compete for its
minimum. An empty bin borrows from the bin that a hash of (bin, attempt) names, attempts counting up
until one that was filled is found. The lowest ``bits`` bits of each bin are packed. Two unrelated
bins agree by chance with probability 2**-bits, which the estimate takes out.

Defined results: a text of fewer words than a shingle is one shingle, its whole word sequence; a text
without words (null and empty among them) has the empty fingerprint ``""``, which is like another
empty one (1.0) and unlike all others (0.0); a very long text is hashed in one go, at some ten bytes a byte;
repeated rows have equal fingerprints; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, parts
from .textarrays import mix, shingle_sets

BINS = 512
BITS = 4
WIDTH = 5
#: An id that more rows have may be several ranges, at most SLICES.
HOT_ROWS, SLICES = 1 << 14, 1 << 10

_ATTEMPTS: dict[int, list[np.ndarray]] = {}


def _attempt(bins: int, k: int) -> np.ndarray:
    """Where each empty bin looks at its k-th attempt."""
    known = _ATTEMPTS.setdefault(bins, [])
    while len(known) <= k:
        seeds = np.arange(bins, dtype=np.uint64) + np.uint64((len(known) + 1) << 32)
        known.append((mix(mix(seeds)) % np.uint64(bins)).astype(np.int64))
    return known[k]


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The densified minimum of every bin; ``shingles`` are distinct 64-bit hashes, at least one."""
    best = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    places = ((shingles >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
    np.minimum.at(best, places, mix(shingles))
    filled = np.zeros(bins, dtype=bool)
    filled[places] = True
    empty, k = np.flatnonzero(~filled), 0
    while len(empty):
        source = _attempt(bins, k)[empty]
        done = filled[source]
        best[empty[done]] = best[source[done]]
        empty, k = empty[~done], k + 1
    return best


def pack(best: np.ndarray, bits: int = BITS) -> str:
    """The low bits of all bins, as hexadecimal digits."""
    low = (best & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes().hex()


def fingerprints(texts: list[str], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> list[str]:
    return [pack(signature(s, bins), bits) if len(s) else "" for s in shingle_sets(pa.array(texts, pa.large_string()), width, lower=False)]


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> float:
    """The estimated Jaccard similarity of two fingerprints' shingle sets."""
    if not a or not b:
        return float(a == b)
    unlike = np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8)
    same = bins - np.count_nonzero(np.unpackbits(unlike).reshape(bins, bits).any(axis=1))
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (same / bins - chance) / (1 - chance))))


def add_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``df`` and a string column with each row's fingerprint, computed where the row is read."""

    @F.pandas_udf("string")
    def made(texts):
        import pandas as pd

        return pd.Series(fingerprints(["" if t is None else t for t in texts], width, bins, bits), dtype=object)

    return df.withColumn(fresh(df, name), made(F.col(f"`{text}`")))


def in_order(df: DataFrame, key: str, text: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows dealt to ranges of ``key``, downwards, each followed by a copy of the row that comes next (the first row of the
    next lower range; at the end the very first), marked in ``_next``. Rows of one key are ordered by ``_place``.

    The ranges' bounds and first keys are a few numbers per range; rows move once. A range is one key at least; a key,
    or none, that more than ``hot_rows`` rows and a fourth of a range's share have is several ranges, by a hash of the
    text, which is these rows' ``_place`` (0 for others)."""
    from pyspark.ml.feature import Bucketizer

    spark, n = df.sparkSession, parts(df.sparkSession)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(hot_rows, total // (4 * n))
    hot = {r[key]: r["n"] for r in counts.where(F.col("n") > least).collect()}  # at most 4 n keys
    bounds = set(df.where(F.col(key).isNotNull()).approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else set()
    bounds |= {float(b) for k in hot if k is not None for b in (k, k + 1)}
    if bounds:
        keyed = df.withColumn("_key", F.col(key).cast("double"))
        found = Bucketizer(splits=[float("-inf"), *sorted(bounds), float("inf")], inputCol="_key", outputCol="_range", handleInvalid="keep").transform(keyed)
        ranged = found.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(F.col("_range").cast("int"))).drop("_key")
    else:
        ranged = df.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(0))
    ranged = ranged.withColumn("_place", F.lit(0).cast("bigint"))
    first = F.struct(F.col(key).alias("first"), (-F.col("_place")).alias("place"))
    if hot:
        # A hot key is alone in its range; from there on it is one range a slice, the smallest hashes in the first.
        ranges = F.lit(None).cast("int")
        for k, many in hot.items():
            ranges = F.when(F.col(key).isNull() if k is None else F.col(key) == k, F.lit(min(SLICES, 1 + many // least))).otherwise(ranges)
        place = F.shiftright(F.xxhash64(text), 1)  # its negative is a number too
        named = ranged.withColumn("_slices", ranges).withColumn("_place", F.when(F.col("_slices").isNotNull(), place).otherwise(F.col("_place")))
        slice_ = F.floor((F.col("_place") / float(1 << 63) + 0.5) * F.col("_slices"))
        ranged = named.withColumn("_range", F.expr(f"_range * {SLICES}") + F.coalesce(F.lit(SLICES - 1) - F.least(slice_, F.lit(SLICES - 1)), F.lit(0)).cast("int")).drop("_slices")
    firsts = {r["_range"]: r["first"] for r in ranged.groupBy("_range").agg(F.max(first).alias("first")).collect()}
    order = sorted(firsts, reverse=True)
    copies = [(after, firsts[after].first, -firsts[after].place, r) for r, after in zip(order, order[1:] + order[:1], strict=True)]
    copies = F.broadcast(spark.createDataFrame(copies, "at int, first bigint, place bigint, to int"))  # a row per range
    both = ranged.join(copies, (F.col("_range") == F.col("at")) & F.col(key).eqNullSafe(F.col("first")) & (F.col("_place") == F.col("place")), "left")
    placed = lambda r, is_next: F.struct(r.cast("int").alias("_range"), F.lit(is_next).alias("_next"))
    own = F.array(placed(F.col("_range"), False))
    dealt = both.select(*df.columns, "_place", F.inline(F.when(F.col("to").isNull(), own).otherwise(F.concat(own, F.array(placed(F.col("to"), True))))))
    # Ranges are dealt in order, not by their hash, which would put several into one task.
    return dealt.repartitionByRange(n, "_range")


_PAIRS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def edited_pairs(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, bins: int = BINS, bits: int = BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each document against an edit of itself and against the next document (descending ``doc_id``; null
    last; equal ids by text, those that very many rows have by a hash of it first; after the last the first).

    The edited text has its last third of code points replaced by the first as many (or all) of the next
    document. Returns ``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next``.
    A single document is its own next."""

    def rows(pairs: list[tuple]) -> pa.RecordBatch:
        texts = [t for _, t, _ in pairs]
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, after in pairs]
        own = fingerprints([*texts, pairs[-1][2]], width, bins, bits)
        of_edit = fingerprints(edited, width, bins, bits)
        columns = [[k for k, _, _ in pairs], [len(t) for t in texts], edited, own[:-1], of_edit]
        columns.append([likeness(a, b, bins, bits) for a, b in zip(own, of_edit, strict=False)])
        columns.append([likeness(a, b, bins, bits) for a, b in zip(own, own[1:], strict=False)])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PAIRS.types, strict=True)], schema=_PAIRS)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row whose next has not come yet
        pairs: list[tuple] = []  # consecutive: each one's next is the following one's text
        size = 0
        for batch in batches:
            ranges, nexts, keys = (batch.column(i).to_pylist() for i in range(3))
            for where, is_next, key, value in zip(ranges, nexts, keys, batch.column(3), strict=True):
                value = value.as_py() or ""
                if last is not None and last[0] == where:
                    pairs.append((last[1], last[2], value))
                    size += len(value)
                    last = None
                elif pairs and not is_next:  # a new range: its texts do not follow on
                    yield rows(pairs)
                    pairs, size = [], 0
                if not is_next:
                    last = (where, key, value)
                if size > 1 << 20:
                    yield rows(pairs)
                    pairs, size = [], 0
        if pairs:
            yield rows(pairs)

    read = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = in_order(read, "doc_id", "text", hot_rows).sortWithinPartitions("_range", F.col("_next").asc(), F.col("doc_id").desc_nulls_last(), "_place", "text")
    return ordered.select("_range", "_next", "doc_id", "text").mapInArrow(tasks, "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
