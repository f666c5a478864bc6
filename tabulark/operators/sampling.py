"""Seeded samples and batches with exact sizes, in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import h
from ..functions.ordinal import with_global_ordinal, with_group_carry, written
from ..functions.permutation import permuted
from ..functions.selection import smallest


def census(rows: DataFrame, category: str, cap: int, known: list[str] | None = None) -> DataFrame:
    """``category, n, quota, short``: known categories without rows count in the divisor; none at all is an error."""
    counts = rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    if known:
        names = rows.sparkSession.createDataFrame([(k,) for k in known], "category string")
        counts = names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    # One row per category: the divisor is their number.
    total = counts.agg(F.count(F.lit(1)).alias("k"))
    quota = F.when(F.col("k") == 0, F.raise_error(F.lit("no categories")).cast("bigint")).otherwise(F.floor(F.lit(cap) / F.col("k")))
    return counts.join(F.broadcast(total)).select("category", "n", quota.alias("quota"), (F.col("n") < quota).alias("short"))


def balanced(rows: DataFrame, category: str, key: str, cap: int, seed: str, known: list[str] | None = None) -> DataFrame:
    """At most cap // categories rows of each, by hash, with their place ``rn``; what a short category lacks is not
    redistributed.

    The rows are selected by counts of hash bins, and numbered by ranges and carries: a category of any size and a cap
    of any size are many tasks."""
    k = len(known) if known else rows.select(category).distinct().count()
    if not k:
        raise ValueError("no categories")
    kept = smallest(rows.withColumn("_h", h(seed, F.col(key))), [category], "_h", [key], cap // k)
    placed = with_group_carry(kept, category, [F.col("_h"), F.col(key)], F.lit(1), "rn")
    return placed.withColumn("rn", (F.col("rn") + 1).cast("int")).drop("_h")


def exact_fraction(rows: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """Exactly floor(n * ratio) rows."""
    numbered, total = with_global_ordinal(rows.withColumn("_h", h(seed, F.col(key))), [F.col("_h"), F.col(key)])
    return numbered.where(F.col("rn") <= int(total * ratio)).drop("_h")


def shuffle_cap(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """The first ``most`` rows of a global shuffle, with their ordinal. Only they are moved and numbered."""
    kept = smallest(rows.withColumn("_h", h(seed, F.col(key))), [], "_h", [key], most)
    return with_global_ordinal(kept, [F.col("_h"), F.col(key)], "ordinal")[0].drop("_h")


def first_n(pairs: DataFrame, most: int) -> DataFrame:
    """The first pairs by category and name; an early category may take them all.

    Categories are counted; those that fit are taken whole, and only the one that the cut falls into is ordered,
    by ranges. Its share is exact; pairs equal in both columns may take each other's place."""
    sizes = written(pairs.groupBy("category").agg(F.count(F.lit(1)).alias("_n")))
    # One row a category, in the order of a sort: nulls first.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("_before", before).where(F.col("_before") < most).withColumnRenamed("category", "_category")
    near = pairs.join(placed, F.col("category").eqNullSafe(F.col("_category")))
    whole = near.where(F.col("_before") + F.col("_n") <= most)
    cut, _ = with_global_ordinal(near.where(F.col("_before") + F.col("_n") > most), [F.col("category"), F.col("base_name")], "_rank")
    return whole.unionByName(cut.where(F.col("_rank") <= F.lit(most) - F.col("_before")).drop("_rank")).select(*pairs.columns)


def batches(rows: DataFrame, key: str, size: int, accumulate: int, seed: str) -> DataFrame:
    """``batch, step`` of each row of the shuffled order; a last partial batch is dropped."""
    numbered, total = with_global_ordinal(rows.withColumn("_h", h(seed, F.col(key))), [F.col("_h"), F.col(key)])
    batch = F.floor((F.col("rn") - 1) / size)
    return numbered.withColumn("batch", batch).where(F.col("batch") < total // size).withColumn("step", F.floor(F.col("batch") / accumulate)).drop("_h")


def epochs(rows: DataFrame, key: str, count: int, size: int, accumulate: int, seed: str) -> DataFrame:
    """``epoch, place, batch, step`` of each row in each of ``count`` epochs; a last partial batch is dropped.

    Rows are numbered once. An epoch's place is a keyed permutation of that number, so that further epochs, or one
    row's place in any of them, cost arithmetic and no sort."""
    numbered, total = with_global_ordinal(rows, [F.col(key)], "_ordinal")
    each = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("epoch")) if count > 0 else numbered.withColumn("epoch", F.lit(0)).limit(0)
    placed = each.withColumn("place", permuted(F.col("_ordinal") - 1, total, seed, F.col("epoch")))
    batch = F.floor(F.col("place") / size)
    return placed.withColumn("batch", batch).where(F.col("batch") < total // size).withColumn("step", F.floor(F.col("batch") / accumulate)).drop("_ordinal")
