"""The k smallest rows of each group by a hash, found by counts instead of a sort.

A hash is read in steps of three hexadecimal digits. Rows of a group are counted by the digits so far; the counts, at
most 4096 a group and step, tell in which of these bins the k-th row lies and how many rows lie before it. That bin
alone is counted by its next digits, until it is small. Rows before it are taken as they stand; only the bin's own
rows are ordered. No task sees more of a group than such a bin, and rows move only within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS, HASH_DIGITS = 3, 32

#: A bin of at most so many rows is ordered by one task.
SMALL = 1 << 16


def smallest(rows: DataFrame, by: list[str], hashed: str, ties: list[str], most: int, small: int = SMALL) -> DataFrame:
    """The ``most`` first rows of each group ``by`` (none: of all), in the order of ``hashed`` (32 hexadecimal digits)
    and then of ``ties``. Null groups count as a group; an empty table stays empty."""
    if most <= 0:
        return rows.limit(0)
    groups = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    keys = rows.select(*groups, F.col(hashed).alias("_hash"))
    bounds, width = None, 0
    while bounds is None or (width < HASH_DIGITS and bounds.where(F.col("size") > small).limit(1).count()):
        width = min(width + DIGITS, HASH_DIGITS)
        digits = F.substring("_hash", 1, width)
        if bounds is None:
            inner, settled = keys.withColumn("need", F.lit(most).cast("bigint")), None
        else:
            # A bin that is small already keeps its digits; the others are counted on.
            wide, settled = bounds.where(F.col("size") > small), bounds.where(F.col("size") <= small)
            inner = _meet(keys, wide.select(*names, "prefix", "need"), names).where(F.col("_hash").startswith(F.col("prefix"))).drop("prefix")
        counts = inner.groupBy(*names, digits.alias("prefix")).agg(F.count(F.lit(1)).alias("size"), F.first("need").alias("need"))
        before = Window.partitionBy(*names).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        here = placed.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("size") >= F.col("need")))
        found = here.select(*names, "prefix", (F.col("need") - F.col("before")).alias("need"), "size")
        # Counts are a few rows a group: kept as rows, so that no later step counts again.
        found = found if settled is None else settled.unionByName(found)
        bounds = rows.sparkSession.createDataFrame(found.collect(), found.schema) if not by else _kept(found)
    joined = _meet(rows.select("*", *groups), bounds.select(*names, "prefix", "need"), names, "left")
    digits = F.expr(f"substring(`{hashed}`, 1, length(prefix))")
    # A group with fewer rows than are wanted has no bound.
    sure = joined.where(F.col("prefix").isNull() | (digits < F.col("prefix")))
    edge = joined.where(digits == F.col("prefix"))
    order = Window.partitionBy(*names, "prefix").orderBy(hashed, *ties)
    cut = edge.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= F.col("need")).drop("_place")
    return sure.unionByName(cut).select(*rows.columns)


def _kept(found: DataFrame) -> DataFrame:
    from .ordinal import written

    return written(found)


def _meet(rows: DataFrame, bounds: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Rows with their group's bound; without groups there is one bound."""
    if not names:
        return rows.join(F.broadcast(bounds), F.lit(True), how)
    other = bounds.select(*[F.col(n).alias(f"{n}_") for n in names], *[c for c in bounds.columns if c not in names])
    same = None
    for n in names:
        one = F.col(n).eqNullSafe(F.col(f"{n}_"))
        same = one if same is None else same & one
    return rows.join(other, same, how).drop(*[f"{n}_" for n in names])
