"""Harvest bookkeeping: link and id extraction, quotas, continuing and dense numbering, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..functions.ordinal import with_group_carry

# What the address of an unwanted link or image contains.
UNWANTED = "logo|icon|google|button"
# The element, and the classes of elements, whose images are figures.
FIGURES = ("figure", ("part-figure", "fig"))


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, pos, link, url``: wanted links in page order, relative ones resolved against the page."""
    links = pages.select("page_id", F.col("url").alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "link"))
    wanted = links.where((F.col("link") != "") & ~F.lower("link").rlike(UNWANTED))
    return wanted.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", urls.join(F.col("page"), F.col("link")).alias("url"))


def image_links(pages: DataFrame) -> DataFrame:
    """``page_id, pos, link, url``: the wanted images of each page's figures in order; ``pos`` counts all images of the
    page from 0. The lazy address (``data-src``) goes before ``src``, and an empty one counts as none."""
    found = markup.inside(markup.tags(F.col("html")), "img", *FIGURES)
    read = pages.select("page_id", F.col("url").alias("page"), F.inline(found)).withColumn("link", F.coalesce(markup.attribute(F.col("tag"), "data-src"), markup.attribute(F.col("tag"), "src")))
    wanted = read.where(F.col("link").isNotNull() & ~F.lower("link").rlike(UNWANTED))
    return wanted.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", urls.join(F.col("page"), F.col("link")).alias("url"))


def image_responses(responses: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Responses whose content type names an image; none counts as no image."""
    return responses.where(F.coalesce(F.col(content_type), F.lit("")).contains("image"))


def response_ids(bodies: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """``total, pos, article_id`` from stored XML search responses, with the columns ``keep``; no total counts as "0"."""
    names = keep or []
    total = F.coalesce(F.nullif(F.xpath_string(body, F.lit("/eSearchResult/Count")), F.lit("")), F.lit("0"))
    found = bodies.select(*names, total.alias("total"), F.posexplode(F.xpath(body, F.lit("//Id/text()"))).alias("pos", "id"))
    return found.select(*names, "total", "pos", F.concat(F.lit("PMC"), "id").alias("article_id"))


def capped_union(queries: list[DataFrame], cap: int) -> DataFrame:
    """Ids of several queries, each cut to ``cap`` by position, one after another; repeats stay and are counted.

    Ids are numbered by ranges and carries, so that neither a query's list nor an id found very often is one task."""
    every = None
    for number, q in enumerate(queries):
        part = q.select("pos", "article_id").withColumn("query", F.lit(number))
        every = part if every is None else every.unionByName(part)
    first = with_group_carry(every, "query", [F.col("pos"), F.col("article_id")], F.lit(1), "rank").where(F.col("rank") < cap)
    again = with_group_carry(first, "article_id", [F.col("query"), F.col("pos")], F.lit(1), "occurrence")
    return again.select("query", "pos", "article_id", (F.col("occurrence") + 1).alias("occurrence"))


def resume_quota(articles: DataFrame, manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """Articles from the saved position on, whole, while the images before them are below the type's target."""
    rest = articles.join(manifest, "type", "left").where(F.col("pos") >= F.coalesce("next_index", F.lit(0)))
    counted = with_group_carry(rest, "type", [F.col("pos")], F.col("images"), "before").join(targets, "type")
    return counted.where(F.coalesce("have", F.lit(0)) + F.col("before") < F.col("target")).select("type", "pos", "article_id", "images", "before")


def number_in(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"chart_(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def chart_name(number: Column, kind: Column) -> Column:
    return F.format_string("chart_%03d_%s.png", number, kind)


def dense_reindex(files: DataFrame) -> DataFrame:
    """``type, name, number, new_name``: .png files of a type numbered 1 to n by the number in their names."""
    own = files.where(F.col("name").endswith(".png")).withColumn("number", number_in(F.col("name")))
    ranked = with_group_carry(own, "type", [F.col("number"), F.col("name")], F.lit(1), "before")
    return ranked.select("type", "name", "number", chart_name(F.col("before") + 1, F.col("type")).alias("new_name"))


def continuing_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New files numbered on from each type's largest number (a count would reuse numbers after a gap)."""
    top = existing.groupBy("type").agg(F.max("number").alias("top"))
    numbered = with_group_carry(new, "type", [F.col("pos")], F.lit(1), "before").join(top, "type", "left")
    return numbered.select("type", "pos", (F.coalesce("top", F.lit(0)) + F.col("before") + 1).cast("bigint").alias("number"))


def type_totals(rows: DataFrame, kind: str) -> DataFrame:
    """Counts by type and, with a null type, of all."""
    return rows.rollup(F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def update_manifest(old: DataFrame, progress: DataFrame) -> DataFrame:
    """``type, next_index`` after a run: a type's new index where it has one, else the one it had."""
    new = progress.select("type", F.col("next_index").alias("now"))
    both = old.join(new, "type", "full_outer")
    return both.select("type", F.coalesce("now", "next_index", F.lit(0)).alias("next_index"))


def manifest(counts: DataFrame, types: list[str]) -> DataFrame:
    """``type, next_index`` for every type; types without rows start at 0."""
    names = counts.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return names.join(counts, "type", "left").select("type", F.coalesce("next_index", F.lit(0)).alias("next_index"))
