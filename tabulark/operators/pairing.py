"""Labels and images: pairing with preference, what stays unpaired, and substitutes for corrupt samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import with_next_valid


def pair_prefer(labels: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], image: str) -> DataFrame:
    """Labels with the first image source's match, else the second's; without either they are dropped."""
    one = first.select(*keys, F.col(image).alias("_one")).dropDuplicates(keys)
    two = second.select(*keys, F.col(image).alias("_two")).dropDuplicates(keys)
    both = labels.join(one, keys, "left").join(two, keys, "left").withColumn(image, F.coalesce("_one", "_two"))
    return both.where(F.col(image).isNotNull()).drop("_one", "_two")


def unpaired(labels: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    return labels.join(images.select(*keys), keys, "left_anti")


def next_valid(samples: DataFrame, key: str, valid: str) -> DataFrame:
    """``substitute``: the sample itself if valid, else the next valid one, around the end (null if none is)."""
    return with_next_valid(samples, key, F.col(valid), "substitute")
