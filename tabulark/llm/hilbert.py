"""Hilbert-curve sharding: metadata dimensions quantised, rows sorted by curve index, equal runs cut.

Built-in column expressions only. Rows that are close in all dimensions are close on the curve, so a
shard covers a small box of each dimension, and a filter on several of them skips most shards.

Defined results: null dimensions count as 0; within a cell null ordering columns (a null doc_id) sort first; rows equal
in all ordering columns may change places; a very long text is only measured;
an empty table gives an empty table; where an input column is called ``curve``, ``shard`` or ``slot`` it stays,
and the new one gets underscores appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import with_global_ordinal
from .scratch import fresh


def quantised_log(size: Column, bits: int) -> Column:
    """Sixteen steps to a doubling, cut to ``bits`` bits."""
    return F.least(F.floor(F.log2(size + F.lit(1)) * 16), F.lit((1 << bits) - 1)).cast("bigint")


def quantised_name(name: Column, bits: int) -> Column:
    """A hash of a categorical value (null: 0)."""
    return F.when(name.isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(name), F.lit(1 << bits)).cast("bigint"))


def hilbert_index(dimensions: list[Column], bits: int) -> Column:
    """The index along the Hilbert curve of a point with ``bits`` bits in each dimension.

    Skilling's transform (2004): undo excess work from the highest bit down, Gray-encode, and interleave."""
    n = len(dimensions)
    zero = F.lit(0).cast("bigint")
    point = F.array(*[F.coalesce(d, zero).cast("bigint") for d in dimensions])
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    highest = 1 << (bits - 1)

    def exchange(i: int, q: Column) -> Callable[[Column], Column]:
        low = q - 1

        def step(x: Column) -> Column:
            first, own = F.get(x, F.lit(0)), F.get(x, F.lit(i))
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            inverted = own.bitwiseAND(q) != 0
            changed = [F.get(x, F.lit(j)) for j in range(n)]
            changed[i] = F.when(inverted, own).otherwise(own.bitwiseXOR(swap))
            changed[0] = F.when(inverted, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
            return F.array(*changed)

        return step

    def undo(at: Column, q: Column) -> Column:
        for i in range(n):
            at = let(at, exchange(i, q))
        return at

    turned = F.aggregate(F.array(*[F.lit(highest >> k).cast("bigint") for k in range(bits - 1)]), point, undo)

    def gray(x: Column) -> Column:
        values = [F.get(x, F.lit(0))]
        for i in range(1, n):
            values.append(F.get(x, F.lit(i)).bitwiseXOR(values[-1]))
        return F.array(*values)

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        qs = F.array(*[F.lit(highest >> k).cast("bigint") for k in range(bits - 1)])
        flip = F.aggregate(qs, zero, lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return let(flip, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def interleave(x: Column) -> Column:
        index = zero
        for bit in range(bits - 1, -1, -1):
            for i in range(n):
                index = index * 2 + F.shiftright(F.get(x, F.lit(i)), bit).bitwiseAND(F.lit(1).cast("bigint"))
        return index

    return let(let(let(turned, gray), finish), interleave)


def shard_by_curve(df: DataFrame, dimensions: dict[str, Column], bits: int, shards: int, ties: list[str]) -> DataFrame:
    """``df`` with ``curve``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shards are runs of the curve whose row counts differ by one at most. ``ties`` are columns that order rows
    of one curve cell, so that a cell with a third of all rows is cut like any other run. The rows' own columns
    travel as one struct, so that no name of theirs can clash."""
    keys = [f"k{i}" for i in range(len(ties))]
    placed = df.select(F.struct("*").alias("row"), hilbert_index(list(dimensions.values()), bits).alias("curve"), *[F.col(f"`{t}`").alias(k) for t, k in zip(ties, keys, strict=True)])
    ranked, total = with_global_ordinal(placed, [F.col(c) for c in ("curve", *keys)], "rank")
    # In integers: shard s holds the ranks from ceil(s * total / shards) on.
    total = max(total, 1)
    shard = F.expr(f"cast(((rank - 1) * {shards}) div {total} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    cut = ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - 1 - first)
    return cut.select("row.*", *[F.col(c).alias(fresh(df, c)) for c in ("curve", "shard", "slot")])
