"""Clinical summaries: pooled studies, waterfall bars, running, stacked and paired series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import with_group_carry


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def study_effects(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Per nation: price of returned lines over that of the others, with an interval; floors 0.1 and 0.01."""
    returned = F.col("l_returnflag") == "R"
    own = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", "n_nationkey", "n_name", "n_regionkey")
    # Lines shrink to suppliers before they meet nations.
    price = F.col("l_extendedprice")
    lines = lineitem.groupBy("l_suppkey").agg(
        F.sum(F.when(returned, price)).alias("rs"),
        F.sum(F.when(returned, price * price)).alias("rq"),
        F.count(F.when(returned, 1)).alias("rn"),
        F.sum(F.when(~returned, price)).alias("os"),
        F.count(F.when(~returned, 1)).alias("on"),
    )
    by = lines.join(own, lines["l_suppkey"] == own["s_suppkey"]).groupBy("n_regionkey", "n_nationkey", "n_name")
    sums = by.agg(*[F.sum(c).alias(c) for c in ("rs", "rq", "rn", "os", "on")]).where("rn > 1 and on > 0")
    other, mean = F.col("os") / F.col("on"), F.col("rs") / F.col("rn")
    deviation = F.sqrt(F.greatest(F.lit(0.0), (F.col("rq") - F.col("rs") * mean) / (F.col("rn") - 1)))
    margin = 1.96 * deviation / F.sqrt("rn") / other
    ratio = F.greatest(F.lit(0.1), mean / other)
    return sums.select(
        F.col("n_regionkey").alias("chart"),
        F.col("n_nationkey").alias("study"),
        F.col("n_name").alias("study_label"),
        ratio.alias("ratio_value"),
        F.greatest(F.lit(0.01), ratio - margin).alias("ci_lower"),
        (ratio + margin).alias("ci_upper"),
    )


def pooled(studies: DataFrame) -> DataFrame:
    """Per chart: the plain mean ratio, and the mean upper margin over the root of the count, on both sides."""
    error = F.avg(F.col("ci_upper") - F.col("ratio_value")) / F.sqrt(F.count(F.lit(1)))
    sums = studies.groupBy("chart").agg(F.avg("ratio_value").alias("ratio_value"), error.alias("e"))
    return sums.select("chart", "ratio_value", (F.col("ratio_value") - F.col("e")).alias("ci_lower"), (F.col("ratio_value") + F.col("e")).alias("ci_upper"))


def forest_rows(studies: DataFrame) -> DataFrame:
    """Studies with plot positions n to 1, and the overall row at 0."""
    w = Window.partitionBy("chart")
    place = F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("study")) + 1
    detail = studies.select("chart", place.cast("bigint").alias("position"), "study_label", "ratio_value", "ci_lower", "ci_upper")
    overall = pooled(studies).select("chart", F.lit(0).cast("bigint").alias("position"), F.lit("Overall").alias("study_label"), "ratio_value", "ci_lower", "ci_upper")
    return detail.unionByName(overall)


def percent_changes(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Per customer of at least two orders: percent change in price, first to last order."""
    moment = F.struct("o_orderdate", "o_orderkey")
    by = orders.groupBy("o_custkey").agg(F.min_by("o_totalprice", moment).alias("a"), F.max_by("o_totalprice", moment).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1 and a > 0")
    own = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("chart"))
    return by.join(own, "o_custkey").select("chart", F.col("o_custkey").alias("id"), (100 * (F.col("b") - F.col("a")) / F.col("a")).alias("value"))


def waterfall(values: DataFrame) -> DataFrame:
    """``chart, id, rank, label, value, colour``: clipped to +-100, descending, over 20 red, under -30 green."""
    cut = values.withColumn("value", clip(F.col("value"), -100.0, 100.0))
    numbered = with_group_carry(cut, "chart", [F.desc("value"), F.col("id")], F.lit(1), "before")
    ranked = numbered.withColumn("rank", F.col("before") + 1)
    colour = F.when(F.col("value") > 20, "red").when(F.col("value") < -30, "green").otherwise("blue")
    return ranked.select("chart", "id", "rank", F.format_string("Patient %d", "rank").alias("label"), "value", colour.alias("colour"))


def running(series: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    return series.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def stacked(series: DataFrame, at: list[str], order: str, value: str) -> DataFrame:
    """Where each segment of a stack begins: the sum of those before it."""
    w = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("bottom", F.coalesce(F.sum(value).over(w), F.lit(0)))


def dual_axis(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two series ``chart, position, label, value`` side by side; matched by position, as labels may repeat."""
    a = left.select("chart", "position", F.col("label").alias("l1"), F.col("value").alias("bar"))
    b = right.select("chart", "position", F.col("label").alias("l2"), F.col("value").alias("line"))
    return a.join(b, ["chart", "position"], "full_outer").select("chart", "position", F.coalesce("l1", "l2").alias("label"), "bar", "line")
