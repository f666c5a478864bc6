"""Seeded chart tables: every row follows from its chart's key, so any part can be made again alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import between, normal, pick, u

# Shares of chart kinds.
MIX = (("kaplan_meier", 0.50), ("forest_plot", 0.10), ("waterfall_plot", 0.10), ("simple_bar", 0.06), ("stacked_bar", 0.06), ("multi_line", 0.06), ("dual_axis_combo", 0.075), ("scatter", 0.045))


def kind_of(key: Column) -> Column:
    draw, total, chosen = u("mix", key), 0.0, None
    for kind, share in MIX[:-1]:
        total = round(total + share, 6)
        chosen = F.when(draw < total, kind) if chosen is None else chosen.when(draw < total, kind)
    return chosen.otherwise(MIX[-1][0])


def _numbers(count: Column, name: str) -> Column:
    return F.explode(F.sequence(F.lit(1), count)).alias(name)


def survival_rows(charts: DataFrame, key: str) -> DataFrame:
    """``key, arm, subject, t, e``: 2 to 4 arms of 50 to 200 subjects; Weibull events, uniform censoring."""
    k = F.col(key)
    arms = charts.select(key, _numbers(pick("arms", 2, 4, k), "arm"))
    shaped = arms.select("*", between("shape", 0.8, 1.5, k, F.col("arm")).alias("shape"), between("scale", 20, 100, k, F.col("arm")).alias("scale"), between("rate", 0.1, 0.5, k, F.col("arm")).alias("rate"))
    rows = shaped.select("*", _numbers(pick("subjects", 50, 200, k, F.col("arm")), "subject"))
    ids = (k, F.col("arm"), F.col("subject"))
    event = F.col("scale") * F.pow(-F.log(F.lit(1.0) - u("event", *ids)), F.lit(1.0) / F.col("shape"))
    censor = u("censor", *ids) * F.col("scale") * (1 + 2 * F.col("rate"))
    return rows.select(key, "arm", "subject", F.least(event, censor).alias("t"), (event <= censor).cast("int").alias("e"))


def study_rows(charts: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    rows = charts.select(key, _numbers(pick("studies", 3, 10, k), "study"))
    ids = (k, F.col("study"))
    ratio, margin = F.greatest(F.lit(0.1), normal("ratio", 1.0, 0.4, *ids)), between("margin", 0.1, 0.5, *ids)
    return rows.select(key, "study", ratio.alias("ratio_value"), F.greatest(F.lit(0.01), ratio - margin).alias("ci_lower"), (ratio + margin).alias("ci_upper"))


def bar_rows(charts: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    rows = charts.select(key, _numbers(pick("patients", 20, 50, k), "patient"))
    value = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), normal("change", -10.0, 30.0, k, F.col("patient"))))
    ranked = rows.select(key, "patient", value.alias("value"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "patient")).cast("bigint"))


def series_rows(charts: DataFrame, key: str) -> DataFrame:
    """``key, kind, series, x, y, bottom``: bars, stacks, walks and clusters by the chart's kind."""
    k = F.col(key)
    kinds = charts.select(key, F.element_at(F.array(*[F.lit(m[0]) for m in MIX[3:]]), pick("anchor", 1, 5, k)).alias("kind"))
    many = F.when(F.col("kind") == "simple_bar", 1).when(F.col("kind") == "dual_axis_combo", 2).otherwise(pick("series", 2, 4, k))
    rows = kinds.select("*", _numbers(many, "series")).select("*", _numbers(pick("points", 4, 12, k), "x"))
    ids = (k, F.col("series"), F.col("x"))
    step = F.when(F.col("kind") == "multi_line", normal("walk", 0.0, 5.0, *ids)).otherwise(between("height", 5, 100, *ids))
    slope = F.when(u("slope", k, F.col("series")) < 0.5, between("k", 0.5, 2.0, k, F.col("series"))).otherwise(0.0)
    raw = rows.select("*", step.alias("step"), slope.alias("slope"))
    walk = F.sum("step").over(Window.partitionBy(key, "series").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 50
    y = F.when(F.col("kind") == "multi_line", walk).when(F.col("kind") == "scatter", F.col("step") + F.col("x") * F.col("slope")).otherwise(F.col("step"))
    below = F.coalesce(F.sum("y").over(Window.partitionBy(key, "x").orderBy("series").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    made = raw.withColumn("y", y)
    return made.withColumn("bottom", F.when(F.col("kind") == "stacked_bar", below).otherwise(0.0)).select(key, "kind", "series", "x", "y", "bottom")
