"""Augmentation plans: which transforms a sampled file gets, with which parameters, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import between, pick, u


def augment_plan(files: DataFrame, key: str, name: str) -> DataFrame:
    """``key, position, transform, p1``: transforms in order. Names with ``_anchor`` get the spatial ones too.

    A plan is idempotent: a rerun plans the same."""
    k = F.col(key)
    pixel = [("compress", 0.5, pick("quality", 60, 90, k)), ("noise", 0.5, between("variance", 10, 50, k)), ("blur", 0.3, pick("kernel", 3, 5, k)), ("dropout", 0.3, F.lit(0))]
    spatial = [("rotate", 0.5, between("angle", -4, 4, k)), ("perspective", 0.5, F.lit(0)), ("pad", 0.5, F.lit(0))]
    anchor = F.contains(F.col(name), F.lit("_anchor"))
    steps = []
    for position, (what, chance, value) in enumerate([*spatial, *pixel]):
        fires = u(f"do-{what}", k) < chance
        fires = fires & anchor if position < len(spatial) else fires
        steps.append(F.when(fires, F.struct(F.lit(position).alias("position"), F.lit(what).alias("transform"), F.round(value.cast("double"), 6).alias("p1"))))
    return files.select(key, F.inline(F.array_compact(F.array(*steps))))
