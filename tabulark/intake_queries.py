"""Queries of what comes in and goes out: links, images, files, runs that resume, samples at full size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import integrity, urls
from .functions.draws import h, sql_h
from .functions.ordinal import claim, shared_folder
from .functions.permutation import sql_permuted
from .operators import harvest, runs, samples, sampling, text
from .registry import Tables, query
from .sources import files
from .streaming import ingest

# Every form that a reference takes, written out for a page: relative, absolute, with and without host, and none.
_FORMS = ["x?", "./y/../z?", "?p=?", "#t?", "//c.org/?", "/r/../s?", "../../../../d?", "a//b/./?", ";v=?", "", "HTTP://O.org/?", "mailto:?", "../?/..", ".?/g", "g;x=1/../?", "http:?"]


@query(
    urls.sql_join(
        f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') || '/d/e;k/c;p?q#f' AS page,
  replace([{", ".join(repr(f) for f in _FORMS)}][i], '?', CASE WHEN i = 3 THEN '?' || page_id ELSE page_id::VARCHAR END) AS link FROM pages, range(1, {len(_FORMS) + 1}) r(i)""",
        "page_id, pos, link",
    )
)
def link_forms(t: Tables) -> DataFrame:
    """Each page's references in all forms, resolved against a place three folders below it."""
    number = F.col("page_id").cast("string")
    forms = [F.replace(F.lit(f), F.lit("?"), F.concat(F.lit("?"), number) if i == 2 else number) for i, f in enumerate(_FORMS)]
    page = F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), "/+$", ""), F.lit("/d/e;k/c;p?q#f"))
    rows = t.pages.select("page_id", page.alias("page"), F.posexplode(F.array(*forms)).alias("pos", "link"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", urls.join(F.col("page"), F.col("link")).alias("url"))


# What comes before a page's own text: images in figures of five kinds, and ones outside. Each figure image is named
# f, with its place among the page's images.
_FIGURES = [
    '<figure class="x"><p><img alt="a > b" src="f0-?.png"></figure><img src="o1-?.png">',
    '<div class="part-figure"><img src="s.png" data-src="f0-?.png"><img src="logo.png"></div><img src="o2-?.png">',
    '<img src="o0-?.png"><figure><span><img src=f1-?.png></figure></span><img src="o2-?.png">',
    '<!-- <figure> --><img src="o0-?.png"><section class=fig><section><img src="f1-?.png"></section><img src="f2-?.png"/></section><img src="o3-?.png">',
    '<div class="figs"><img src="o0-?.png"></div><IMG src="o1-?.png"><figure><br><IMG SRC=\'f2-?.png\' class="y">',
]


@query(f"""WITH forms AS (SELECT page_id, replace([{", ".join("'" + f.replace("'", "''") + "'" for f in _FIGURES)}][page_id % 5 + 1], '?', page_id::VARCHAR) AS f FROM pages WHERE html IS NOT NULL)
SELECT page_id, CAST(x[2] AS BIGINT) AS pos, x || '.png' AS link FROM (SELECT page_id, unnest(regexp_extract_all(f, 'f[0-9]-[0-9]+')) AS x FROM forms)""")
def figure_images(t: Tables) -> DataFrame:
    """The images of figures in pages that got some."""
    form = F.element_at(F.array(*[F.lit(f) for f in _FIGURES]), (F.col("page_id") % 5 + 1).cast("int"))
    pages = t.pages.select("page_id", "url", F.concat(F.replace(form, F.lit("?"), F.col("page_id").cast("string")), "html").alias("html"))
    return harvest.image_links(pages).select("page_id", "pos", "link")


def _segment(marker: str, data: Column) -> Column:
    """A JPEG segment with its length."""
    size = F.length(data) + 2
    return F.concat(F.unhex(F.lit("FF" + marker)), F.unhex(F.lpad(F.hex(size), 4, "0")), data)


def _chunk(name: str, data: Column) -> Column:
    """A PNG chunk with its length and checksum."""
    body = F.concat(F.encode(F.lit(name), "utf-8"), data)
    return F.concat(F.unhex(F.lpad(F.hex(F.length(data)), 8, "0")), body, F.unhex(F.lpad(F.hex(F.crc32(body)), 8, "0")))


@query(
    """SELECT doc_id, [57 + n, 52 + n, 57 + n, 32 + n, 39 + n, 37 + n, 8 + n, 0][doc_id % 8 + 1] AS length,
  [NULL, 'truncated', 'checksum', 'structure', NULL, 'truncated', 'unknown', 'empty'][doc_id % 8 + 1] AS damage
FROM (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents)"""
)
def image_integrity(t: Tables) -> DataFrame:
    """Image files with a document's text as coded data: whole ones, and such as are cut, changed or something else."""
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    head = F.unhex(F.lit("00000003000000020802000000"))
    signature, end = F.unhex(F.lit(integrity.PNG)), _chunk("IEND", F.encode(F.lit(""), "utf-8"))
    coded = _chunk("IDAT", data)
    changed = F.concat(F.substring(coded, F.lit(1), F.length(coded) - 1), F.unhex(F.hex((F.conv(F.hex(F.substring(coded, F.length(coded), F.lit(1))), 16, 10).cast("int") + 1) % 256)))
    whole = F.concat(signature, _chunk("IHDR", head), coded, end)
    photo = F.concat(F.unhex(F.lit("FFD8")), _segment("C0", F.unhex(F.lit("00" * 15))), _segment("DA", F.unhex(F.lit("00" * 12))), data)
    made = [
        whole,
        F.substring(whole, F.lit(1), F.length(whole) - 5),
        F.concat(signature, _chunk("IHDR", head), F.when(F.length(changed) == F.length(coded), changed), end),
        F.concat(signature, coded, end),
        F.concat(photo, F.unhex(F.lit("FFD9"))),
        photo,
        F.concat(F.encode(F.lit("no image"), "utf-8"), data),
        F.unhex(F.lit("")),
    ]
    content = F.element_at(F.array(*made), (F.col("doc_id") % 8 + 1).cast("int"))
    files_ = t.documents.select("doc_id", content.alias("content"))
    return files_.select("doc_id", F.length("content").cast("bigint").alias("length"), integrity.damage(F.col("content")).alias("damage"))


_ARTICLES = "SELECT source AS type, doc_id AS pos, 'PMC' || doc_id AS article_id, 1 + n_chars % 5 AS images FROM documents"
_RUN = lambda articles, known, aim: f"""SELECT type, pos, images, have, before, have + before + 1 AS first_number FROM (
  SELECT type, pos, images, coalesce(saved, 0) AS have, coalesce(sum(images) OVER (PARTITION BY type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ({articles}) LEFT JOIN ({known}) USING (type) WHERE pos >= coalesce(next_index, 0)) WHERE have + before < {aim}"""  # noqa: E731
_AFTER = lambda run, known: f"""SELECT type, coalesce(now, next_index) AS next_index, coalesce(saved, 0) + coalesce(more, 0) AS saved FROM (
  SELECT type, max(pos) + 1 AS now, sum(images) AS more FROM ({run}) GROUP BY type) FULL JOIN ({known}) USING (type)"""  # noqa: E731


@query(f"""WITH k0 AS (SELECT NULL::VARCHAR AS type, NULL::BIGINT AS next_index, NULL::BIGINT AS saved WHERE false),
r1 AS MATERIALIZED ({_RUN(_ARTICLES, "SELECT * FROM k0", 60)}), k1 AS MATERIALIZED ({_AFTER("SELECT * FROM r1", "SELECT * FROM k0")}),
r2 AS MATERIALIZED ({_RUN(_ARTICLES, "SELECT * FROM k1", 125)}), k2 AS MATERIALIZED ({_AFTER("SELECT * FROM r2", "SELECT * FROM k1")})
SELECT type, next_index, CAST(saved AS BIGINT) AS saved, CAST((SELECT sum(saved) FROM k2) AS BIGINT) AS global_total,
  CAST((SELECT sum(images) FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) r WHERE r.type IS NOT DISTINCT FROM k2.type) AS BIGINT) AS images, CAST((SELECT max(first_number) FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) r WHERE r.type IS NOT DISTINCT FROM k2.type) AS BIGINT) AS last_number FROM k2""")
def manifest_runs(t: Tables) -> DataFrame:
    """The manifest after two runs, the first of which is asked for twice, beside what their images say."""
    folder = claim(f"{shared_folder(t.spark)}/manifest-{uuid.uuid4().hex}")
    articles = t.documents.select(F.col("source").alias("type"), F.col("doc_id").alias("pos"), F.concat(F.lit("PMC"), "doc_id").alias("article_id"), (F.col("n_chars") % 5 + 1).alias("images"))
    manifest, types = runs.Manifest(t.spark, f"{folder}/manifest"), articles.select("type").distinct()
    for run_id, aim in (("first", 60), ("first", 60), ("second", 125)):
        left = runs.harvest_run(articles, manifest, types.withColumn("target", F.lit(aim)), run_id, f"{folder}/images")
    kept = t.spark.read.parquet(f"{folder}/images").groupBy(F.col("type").alias("of")).agg(F.sum("images").alias("images"), F.max("first_number").alias("last_number"))
    return runs.with_total(left).join(kept, F.col("type").eqNullSafe(F.col("of")), "left").drop("of")


_KINDS = ["good", "unreadable", "unknown kind", "incomplete", "incomplete"]


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'good' ELSE 'bad' END AS verdict, nullif([{", ".join(repr(k) for k in _KINDS)}][doc_id % 5 + 1], 'good') AS reason,
  (SELECT count(*) FROM documents) AS observed, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) AS observed_bad FROM documents""")
def label_ingest(t: Tables) -> DataFrame:
    """Labels made of documents, put through the stream: whole ones, cut ones, unknown kinds, missing nested fields."""
    folder = claim(f"{shared_folder(t.spark)}/ingest-{uuid.uuid4().hex}")
    bar = F.struct(F.col("source").alias("label"), F.col("n_chars").cast("double").alias("value"))
    axes = F.struct(F.struct(F.lit("v").alias("label")).alias("y")).alias("axes")
    whole = lambda kind, one: F.to_json(F.struct(F.lit(kind).alias("chart_type"), axes, F.array(one).alias("bars")))
    good = whole("waterfall_plot", bar)
    bodies = [good, F.expr("substring(good, 1, length(good) - 2)"), whole("pie", bar), whole("waterfall_plot", F.struct(F.col("source").alias("label"))), F.replace(good, F.lit('"axes"'), F.lit('"axis"'))]
    body = F.element_at(F.array(*bodies), (F.col("doc_id") % 5 + 1).cast("int"))
    named = t.documents.select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    named.withColumn("good", good).select("doc_id", body.alias("body")).write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema("doc_id bigint, body string").option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
    ingest.start_ingest(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    counts = t.spark.read.parquet(f"{folder}/out/counts").agg(F.sum("rows").alias("observed"), F.sum("bad").alias("observed_bad"))
    found = t.spark.read.parquet(f"{folder}/out/rows").select("doc_id", "verdict", "reason")
    return found.join(F.broadcast(counts))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, 'PMC' || doc_id AS id FROM documents")
def ordered_ids(t: Tables) -> DataFrame:
    """An id list written in order and read again with its positions."""
    path = claim(f"{shared_folder(t.spark)}/ids-{uuid.uuid4().hex}")
    t.documents.select("doc_id").orderBy("doc_id").select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("value")).write.text(path)
    return files.read_ids(t.spark, path)


# Samples at the reference's sizes.
_LINES = "SELECT l_orderkey * 8 + l_linenumber AS line, l_returnflag FROM lineitem"


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_returnflag")


@query("SELECT category, base_name FROM (SELECT l_returnflag AS category, lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 12, '0') AS base_name FROM lineitem) ORDER BY 1, 2 LIMIT 25000")
def first_25000_pairs(t: Tables) -> DataFrame:
    return sampling.first_n(_lines(t).select(F.col("l_returnflag").alias("category"), F.lpad(F.col("line").cast("string"), 12, "0").alias("base_name")), 25_000)


@query(f"SELECT line, row_number() OVER (ORDER BY {sql_h('shuffle', 'line')}, line) AS ordinal FROM ({_LINES}) QUALIFY ordinal <= 100000")
def shuffle_100000(t: Tables) -> DataFrame:
    return sampling.shuffle_cap(_lines(t).select("line"), "line", 100_000, "shuffle")


@query(f"""SELECT line, l_returnflag, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY {sql_h("balance", "line")}, line) AS INTEGER) AS rn FROM ({_LINES})
QUALIFY rn <= 100000 // (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def balanced_100000(t: Tables) -> DataFrame:
    return sampling.balanced(_lines(t), "l_returnflag", "line", 100_000, "balance")


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM documents),
p AS (SELECT doc_id, n, CAST(e AS INTEGER) AS epoch, {sql_permuted("o", "n", "epoch", "e")} AS place FROM d, range(3) r(e))
SELECT doc_id, epoch, place, place // 32 AS batch, place // 32 // 8 AS step FROM p WHERE place // 32 < n // 32""")
def epoch_orders(t: Tables) -> DataFrame:
    return sampling.epochs(t.documents.select("doc_id"), "doc_id", 3, 32, 8, "epoch")


# Files and lists that Spark writes of the tables and reads again.
@query("""SELECT 'nation-' || s_nationkey AS category, s_suppkey, s_nationkey % 2 = 0 AS named, md5(s_name) AS name_md5 FROM supplier""")
def label_scan(t: Tables) -> DataFrame:
    """One file a label in its category's folder, and others in the root, which is skipped."""
    path = claim(f"{shared_folder(t.spark)}/scan-{uuid.uuid4().hex}")
    body = F.to_json(F.struct("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 2 == 0, F.lit("waterfall_plot")).alias("chart_type")))
    label = t.supplier.select(F.coalesce(F.concat(F.lit("nation-"), "s_nationkey"), F.lit("none")).alias("category"), body.alias("body"))
    files.write_labels(label, path)
    files.write_labels(label.withColumn("category", F.lit(None)), path, per_file=50)
    found = files.read_labels(t.spark, path, skip_root=True).withColumn("category", F.expr("nullif(category, 'none')"))
    kind = samples.class_field(F.col("body"))
    own = F.from_json("body", "s_suppkey bigint, s_name string")
    named = F.when(F.col("category").isNotNull(), kind == "waterfall_plot")
    return found.select("category", own["s_suppkey"].alias("s_suppkey"), named.alias("named"), F.md5(own["s_name"]).alias("name_md5"))


_WORDS_OF = r"SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS w FROM documents) WHERE regexp_full_match(w, '\p{L}+') AND length(w) BETWEEN 5 AND 12"


@query(f"SELECT row_number() OVER (ORDER BY {sql_h('42', 'word')}, word) - 1 AS pos, word FROM (SELECT word FROM ({_WORDS_OF}) ORDER BY {sql_h('42', 'word')}, word LIMIT 2000)")
def vocabulary_file(t: Tables) -> DataFrame:
    """The sampled vocabulary written as one JSON array and read again, with a default that is not needed."""
    path = claim(f"{shared_folder(t.spark)}/vocabulary-{uuid.uuid4().hex}")
    sample = text.seeded_sample(text.vocabulary(t.documents))
    placed = sample.withColumn("pos", F.row_number().over(Window.orderBy(h("42", F.col("word")), "word")) - 1)
    files.write_vocabulary(placed.select("pos", "word"), path)
    default = t.spark.createDataFrame([(i, w) for i, w in enumerate(text.DEFAULT_WORDS)], "pos int, word string")
    return files.read_vocabulary(t.spark, path, default).select(F.col("pos").cast("bigint").alias("pos"), "word")


@query(f"{_WORDS_OF} UNION ALL SELECT DISTINCT 'x' || source FROM documents")
def word_list(t: Tables) -> DataFrame:
    """A word list with blank lines and blanks around its words, read as words."""
    path = claim(f"{shared_folder(t.spark)}/words-{uuid.uuid4().hex}")
    padded = text.vocabulary(t.documents).select(F.concat(F.lit("  "), "word", F.lit(" ")).alias("value"))
    blank = t.documents.select("source").distinct().select(F.explode(F.array(F.lit(""), F.lit("   "), F.concat(F.lit("x"), "source"))).alias("value"))
    padded.unionByName(blank).write.text(path)
    return files.read_words(t.spark, path)


@query("""WITH q AS (SELECT doc_id // 100 AS query, doc_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY doc_id // 100) AS n FROM documents)
SELECT query, CASE WHEN query % 3 = 2 THEN '0' ELSE CAST(n AS VARCHAR) END AS total, CAST(pos AS INTEGER) AS pos, 'PMC' || doc_id AS article_id FROM q""")
def search_responses(t: Tables) -> DataFrame:
    """Ids out of stored search responses of up to 100 ids, some of which give no total."""
    rows = t.documents.groupBy(F.expr("doc_id div 100").alias("query")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    listed = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<Id>"), i.cast("string"), F.lit("</Id>"))), "")
    count = F.when(F.col("query") % 3 == 2, F.lit("")).otherwise(F.concat(F.lit("<Count>"), F.size("ids").cast("string"), F.lit("</Count>")))
    body = F.concat(F.lit("<eSearchResult>"), count, F.lit("<IdList>"), listed, F.lit("</IdList></eSearchResult>"))
    return harvest.response_ids(rows.select("query", body.alias("body")), keep=["query"])


_TYPES = [*[f"text/{x}" for x in ("html", "plain")], "image/png", "image/jpeg; q=1", "application/octet-stream"]


@query(f"SELECT page_id, [{', '.join(repr(x) for x in _TYPES)}][page_id % 6 + 1] AS content_type FROM pages WHERE page_id % 6 IN (2, 3)")
def image_responses(t: Tables) -> DataFrame:
    """Responses that say they are images; every sixth says nothing."""
    said = F.get(F.array(*[F.lit(x) for x in _TYPES]), (F.col("page_id") % 6).cast("int"))
    return harvest.image_responses(t.pages.select("page_id", said.alias("content_type")))


_KINDS_OF = ["src0", "src1", "src2", "src19", "none"]


@query(f"SELECT k AS type, (SELECT count(*) FROM documents WHERE source = k) AS n, coalesce((SELECT max(doc_id) + 1 FROM documents WHERE source = k), 0) AS next_index FROM (SELECT unnest([{', '.join(repr(k) for k in _KINDS_OF)}]) AS k)")
def type_inventory(t: Tables) -> DataFrame:
    """Files and next index of each named type, 0 for one without rows."""
    counts = files.inventory(t.documents.select(F.col("source").alias("category")), _KINDS_OF)
    after = t.documents.groupBy(F.col("source").alias("type")).agg((F.max("doc_id") + 1).alias("next_index"))
    return counts.join(harvest.manifest(after, _KINDS_OF), "type")


@query("SELECT 'run' || p_partkey % 3 AS run_id, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY 1")
def appended_runs(t: Tables) -> DataFrame:
    """Id lists appended in three runs, each of them written twice."""
    path = claim(f"{shared_folder(t.spark)}/runs-{uuid.uuid4().hex}")
    for run in (0, 1, 1, 2, 0, 2):
        files.append_ids(t.part.where(F.col("p_partkey") % 3 == run).select("p_partkey"), path, f"run{run}")
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))
