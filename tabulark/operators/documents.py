"""Chart documents: rows to nested JSON, and typed, validated reading of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STUDY = "struct<study_label:string,ratio_value:double,ci_lower:double,ci_upper:double>"
_POINT = "struct<x:string,y:double>"
KM = "chart_type string, axes struct<x:struct<label:string,max_value:double>,y:struct<label:string,max_value:double>>, arms array<struct<treatment_label:string,coordinates:array<array<double>>,censoring_ticks:array<double>>>"
FOREST = f"chart_type string, axes map<string,struct<label:string>>, studies array<{_STUDY}>, overall_effect {_STUDY}"
WATERFALL = "chart_type string, axes map<string,struct<label:string>>, bars array<struct<label:string,value:double>>"
SERIES = f"chart_type string, axes map<string,struct<label:string>>, series array<struct<series_name:string,series_type:string,data:array<{_POINT}>>>"
SERIES_KINDS = ("simple_bar", "stacked_bar", "multi_line", "dual_axis_combo", "scatter")
SCHEMAS = {"kaplan_meier": KM, "forest_plot": FOREST, "waterfall_plot": WATERFALL} | {k: SERIES for k in SERIES_KINDS}


def _given(of: Column, *names: str) -> Column:
    """Whether the struct and its named fields are there."""
    ok = of.isNotNull()
    for name in names:
        ok = ok & of[name].isNotNull()
    return ok


def _each(items: Column, test: Callable[[Column], Column]) -> Column:
    return items.isNotNull() & F.forall(items, test)


def _study(of: Column) -> Column:
    return _given(of, "study_label", "ratio_value", "ci_lower", "ci_upper")


def _complete(doc: Column, kind: str) -> Column:
    """Whether every required field is there, nested ones too."""
    if kind == "kaplan_meier":
        axes = _given(doc["axes"]["x"], "label", "max_value") & _given(doc["axes"]["y"], "label", "max_value")
        pair = lambda p: p.isNotNull() & (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull())
        arm = lambda a: _given(a, "treatment_label") & _each(a["coordinates"], pair) & _each(a["censoring_ticks"], lambda v: v.isNotNull())
        return axes & _each(doc["arms"], arm)
    if kind == "forest_plot":
        return doc["axes"].isNotNull() & _each(doc["studies"], _study) & _study(doc["overall_effect"])
    if kind == "waterfall_plot":
        return doc["axes"].isNotNull() & _each(doc["bars"], lambda b: _given(b, "label", "value"))
    point = lambda p: _given(p, "x", "y")
    return doc["axes"].isNotNull() & _each(doc["series"], lambda s: _given(s, "series_name", "series_type") & _each(s["data"], point))


def _axes(**labels: str) -> Column:
    return F.struct(*[F.struct(F.lit(label).alias("label")).alias(axis) for axis, label in labels.items()]).alias("axes")


def waterfall_documents(bars: DataFrame) -> DataFrame:
    """``chart, category, body``: one JSON document per chart, bars in rank order. A chart is one row: give large
    groups bounded charts."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label", "value")))
    made = bars.groupBy("chart").agg(F.transform(ordered, lambda b: F.struct(b["label"].alias("label"), F.round(b["value"], 4).alias("value"))).alias("bars"))
    body = F.struct(F.lit("waterfall_plot").alias("chart_type"), _axes(y="Change from baseline (%)"), F.col("bars"))
    return made.select("chart", F.lit("waterfall_plot").alias("category"), F.to_json(body).alias("body"))


def forest_documents(rows: DataFrame) -> DataFrame:
    """``chart, category, body`` from forest rows: studies from the highest position down, the row at 0 is the overall
    effect."""
    rounded = {c: F.round(c, 4).alias(c) for c in ("ratio_value", "ci_lower", "ci_upper")}
    study = F.struct(F.col("study_label"), *rounded.values())
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("position") > 0, F.struct((-F.col("position")).alias("at"), study.alias("study"))))), lambda x: x["study"])
    made = rows.groupBy("chart").agg(listed.alias("studies"), F.max(F.when(F.col("position") == 0, study)).alias("overall_effect"))
    body = F.struct(F.lit("forest_plot").alias("chart_type"), _axes(x="Hazard Ratio (95% CI)"), F.col("studies"), F.col("overall_effect"))
    return made.select(F.col("chart").cast("string").alias("chart"), F.lit("forest_plot").alias("category"), F.to_json(body).alias("body"))


def points(xs: Column, ys: Column) -> Column:
    """Data points of two vectors; what the longer one has beyond the shorter is left out."""
    n = F.least(F.size(xs), F.size(ys))
    return F.zip_with(F.slice(xs, 1, n), F.slice(ys, 1, n), lambda x, y: F.struct(x.cast("string").alias("x"), y.cast("double").alias("y")))


def series_documents(rows: DataFrame, kind: str = "multi_line", series_type: str = "line", x_label: str = "Month", y_label: str = "Count") -> DataFrame:
    """``chart, category, body`` from ``chart, series, label, value``: a series' points in label order."""
    ordered = F.array_sort(F.collect_list(F.struct("label", "value")))
    by = rows.groupBy("chart", "series").agg(ordered.alias("o"))
    one = F.struct(F.col("series").alias("series_name"), F.lit(series_type).alias("series_type"), points(F.col("o")["label"], F.col("o")["value"]).alias("data"))
    made = by.groupBy("chart").agg(F.array_sort(F.collect_list(one)).alias("series"))
    body = F.struct(F.lit(kind).alias("chart_type"), _axes(x=x_label, y1=y_label), F.col("series"))
    return made.select("chart", F.lit(kind).alias("category"), F.to_json(body).alias("body"))


def km_documents(curve: DataFrame, ticks: DataFrame, chart: str = "km") -> DataFrame:
    """``chart, category, body``: one document with every arm's coordinates in time order, and its censoring ticks."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("t", "s"))), lambda p: F.array(p["t"], F.round(p["s"], 4)))
    arms = curve.groupBy("arm").agg(points.alias("coordinates"), F.max("t").alias("top")).join(ticks, "arm", "left")
    arm = F.struct(F.col("arm").alias("treatment_label"), "coordinates", F.coalesce("ticks", F.array().cast("array<double>")).alias("censoring_ticks"))
    made = arms.agg(F.array_sort(F.collect_list(arm)).alias("arms"), F.max("top").alias("top"))
    axis = lambda label, top: F.struct(F.lit(label).alias("label"), top.alias("max_value"))
    body = F.struct(F.lit("kaplan_meier").alias("chart_type"), F.struct(axis("Days", F.col("top")).alias("x"), axis("Survival", F.lit(1.0)).alias("y")).alias("axes"), "arms")
    return made.select(F.lit(chart).alias("chart"), F.lit("kaplan_meier").alias("category"), F.to_json(body).alias("body"))


def _typed(body: Column, kind: str) -> Column:
    return F.from_json(body, f"{SCHEMAS[kind]}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _valid(doc: Column, kind: str) -> Column:
    return doc.isNotNull() & doc["_corrupt"].isNull() & (doc["chart_type"] == kind) & _complete(doc, kind)


def is_complete(body: Column, kind: str) -> Column:
    """Whether a JSON text is a complete document of the kind."""
    return F.element_at(F.transform(F.array(_typed(body, kind)), lambda doc: F.coalesce(_valid(doc, kind), F.lit(False))), 1)


def validate(documents: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """``documents`` with ``doc`` (typed), and ``valid``: parses, is of the kind, and has every required field."""
    read = documents.withColumn("doc", _typed(F.col(body), kind))
    return read.withColumn("valid", F.coalesce(_valid(F.col("doc"), kind), F.lit(False)))


def write_documents(documents: DataFrame, path: str) -> None:
    """Label sink: JSON lines by category, no file per chart."""
    documents.write.mode("overwrite").partitionBy("category").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``chart, body, category`` of what ``write_documents`` wrote; a line that is no JSON object gives nulls."""
    return spark.read.schema("chart string, body string, category string").json(path)
