"""Connected components of a link table, by joins.

Defined results: a link with a null end, or of an id with itself, links nothing; links may repeat and run in either
direction; an empty table gives an empty table; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, component`` for every id that has a link ``a, b``; component is the smallest id reachable.

    Each round takes the smallest label among the neighbours, then the label of that label, so the
    distance to go halves about every round. Labels and links meet in shuffles and are written every
    round; minima are aggregated before they move, so a vertex with very many links is no hot spot."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.write(both, f"{name}-links")
    labels = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels, both["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ends = labels.select(F.col("id").alias("label"), F.col("label").alias("end"))
        jumped = closer.join(ends, "label", "left").select("id", "was", F.least("label", F.coalesce("end", "label")).alias("label"))
        turn += 1
        step = scratch.write(jumped, f"{name}-{turn}", drop=(f"{name}-{turn - 1}",))
        labels = step.select("id", "label")
        if step.where("was <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
