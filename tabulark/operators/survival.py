"""Survival summaries: durations with censoring, event table, product-limit curve, ticks, numbers at risk.

The event table is aggregated to one row per (arm, time) before any window, so a window sees unique
times and no arm's subjects meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import u

TICK_STEPS = (5, 10, 20, 25, 50)
MOST_TICKS = 15


def censored(event: Column, censor: Column) -> tuple[Column, Column]:
    """Observed time and event flag; an event at the censoring time counts as an event."""
    return F.least(F.coalesce(event, censor), censor), F.coalesce(event <= censor, F.lit(False)).cast("int")


def next_order_spells(orders: DataFrame, customer: DataFrame, study_end: str = "2001-08-01") -> DataFrame:
    """Days from each order to its customer's next one, by market segment, censored at the study's end."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    spells = orders.select("o_orderkey", "o_custkey", day.alias("day"), F.to_date(F.lead("o_orderdate").over(w)).alias("next"))
    t, e = censored(F.date_diff("next", "day"), F.date_diff(F.lit(study_end).cast("date"), F.col("day")))
    arms = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("arm"))
    return spells.join(arms, "o_custkey").select("o_orderkey", "arm", t.cast("double").alias("t"), e.alias("e"))


def event_table(spells: DataFrame) -> DataFrame:
    """``arm, t, d`` (events), ``c`` (censored), ``n`` (at risk: time >= t)."""
    at = spells.groupBy("arm", "t").agg(F.sum("e").cast("bigint").alias("d"), F.sum(1 - F.col("e")).cast("bigint").alias("c"))
    on = Window.partitionBy("arm").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return at.withColumn("n", F.sum(F.col("d") + F.col("c")).over(on))


def curve(spells: DataFrame) -> DataFrame:
    """``arm, t, s``: the product-limit estimate at every unique time, opened by (0, 1) unless time 0 is there."""
    events = event_table(spells)
    so_far = Window.partitionBy("arm").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = events.select("arm", "t", F.product(1 - F.col("d") / F.col("n")).over(so_far).alias("s"))
    origin = events.groupBy("arm").agg(F.min("t").alias("first")).where("first > 0").select("arm", F.lit(0.0).alias("t"), F.lit(1.0).alias("s"))
    return steps.unionByName(origin)


def censor_ticks(spells: DataFrame) -> DataFrame:
    """``arm, ticks``: the distinct times with a censoring, ascending."""
    return event_table(spells).where("c > 0").groupBy("arm").agg(F.array_sort(F.collect_list("t")).alias("ticks"))


def axis_ticks(spells: DataFrame, margin: float = 1.0) -> DataFrame:
    """``arm, xmax, step, tick``: ticks 0 to xmax + step, by one of the steps that need at most MOST_TICKS."""
    axis = spells.groupBy("arm").agg((F.max("t") * margin).alias("xmax"))
    fits = F.filter(F.array(*[F.lit(s) for s in TICK_STEPS]), lambda s: F.col("xmax") / s <= MOST_TICKS)
    chosen = axis.withColumn("fits", fits).where(F.size("fits") > 0)
    step = F.element_at("fits", (F.floor(u("tick-step", F.col("arm")) * F.size("fits")) + 1).cast("int"))
    stepped = chosen.withColumn("step", step)
    ticks = F.sequence(F.lit(0), F.floor(F.col("xmax") + F.col("step")).cast("int"), F.col("step"))
    return stepped.select("arm", "xmax", "step", F.explode(ticks).alias("tick"))


def coarse_ticks(spells: DataFrame, ticks: int = 10) -> DataFrame:
    """``arm, tick``: equal steps along each arm's axis, for axes too long for ``axis_ticks``."""
    axis = spells.groupBy("arm").agg(F.max("t").alias("xmax"))
    return axis.select("arm", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ticks)), lambda i: F.floor(F.col("xmax") * i / ticks).cast("double"))).alias("tick"))


def at_risk(spells: DataFrame, ticks: DataFrame) -> DataFrame:
    """``arm, tick, at_risk``: subjects with a time beyond each tick.

    Ticks and the event table are one ordered table with a running sum; no range join."""
    events = event_table(spells).select("arm", F.col("t"), (F.col("d") + F.col("c")).alias("r"), F.lit(None).cast("double").alias("tick"))
    grid = ticks.select("arm", F.col("tick").cast("double").alias("t"), F.lit(0).cast("bigint").alias("r"), F.col("tick").cast("double").alias("tick"))
    later = Window.partitionBy("arm").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    same = Window.partitionBy("arm", "t")
    both = events.unionByName(grid).withColumn("at_risk", F.sum("r").over(later) - F.sum("r").over(same))
    return both.where("tick is not null").select("arm", "tick", "at_risk")
