"""Hand-computed cases, file sources, and invariants."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from tabulark.functions import integrity, urls
from tabulark.functions.ordinal import with_global_ordinal
from tabulark.operators import documents, harvest, pairing, samples, sampling, summaries, survival, text
from tabulark.plans import generate
from tabulark.sources import files
from tabulark.streaming import ingest


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_product_limit_with_tie(spark):
    spells = spark.createDataFrame([("a", float(t), e) for t, e in [(1, 1), (2, 1), (2, 0), (3, 1), (4, 0)]], "arm string, t double, e int")
    assert [(r.n, r.d, r.c) for r in survival.event_table(spells).orderBy("t").collect()] == [(5, 1, 0), (4, 1, 1), (2, 1, 0), (1, 0, 1)]
    assert [round(r.s, 9) for r in survival.curve(spells).orderBy("t").collect()] == [1.0, 0.8, 0.6, 0.3, 0.3]
    assert survival.censor_ticks(spells).first().ticks == [2.0, 4.0]
    ticks = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 4.0)], "arm string, tick double")
    assert [r.at_risk for r in survival.at_risk(spells, ticks).orderBy("tick").collect()] == [5, 2, 0]


@pytest.mark.parametrize(("spells", "expected"), [([(1, 1), (2, 1)], [1.0, 0.5, 0.0]), ([(1, 0), (2, 0)], [1.0, 1.0, 1.0]), ([(0, 1), (2, 0)], [0.5, 0.5])])
def test_curve_ends(spark, spells, expected):
    df = spark.createDataFrame([("a", float(t), e) for t, e in spells], "arm string, t double, e int")
    assert [r.s for r in survival.curve(df).orderBy("t").collect()] == expected


def test_censoring_tie_is_event(spark):
    t, e = survival.censored(F.lit(5), F.lit(5))
    assert tuple(spark.range(1).select(t, e).first()) == (5, 1)


def test_pooling_and_bins(spark):
    studies = spark.createDataFrame([(1, 1, "a", 1.0, 0.8, 1.2), (1, 2, "b", 2.0, 1.6, 2.4)], "chart int, study int, study_label string, ratio_value double, ci_lower double, ci_upper double")
    got = summaries.pooled(studies).first()
    assert [round(x, 6) for x in got[1:]] == [1.5, 1.287868, 1.712132]
    bars = spark.createDataFrame([(1, i, v) for i, v in enumerate([20.0, 20.01, -30.0, -30.01, 250.0])], "chart int, id int, value double")
    assert {r.value: r.colour for r in summaries.waterfall(bars).collect()} == {20.0: "blue", 20.01: "red", -30.0: "blue", -30.01: "green", 100.0: "red"}


def test_balanced_counts_empty_categories(spark):
    df = spark.createDataFrame([(i, "x" if i < 8 else "y") for i in range(10)], "id int, c string")
    got = sampling.balanced(df, "c", "id", 10, "s", known=["x", "y", "z"]).groupBy("c").count()
    assert dict(rows(got, "c")) == {"x": 3, "y": 2}
    assert rows(sampling.census(df, "c", 10, ["x", "y", "z"]), "category") == [("x", 8, 3, False), ("y", 2, 3, True), ("z", 0, 3, True)]


@pytest.mark.parametrize("partitions", [1, 16])
def test_ordinal_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000, numPartitions=partitions).withColumn("k", F.col("id") % 7)
    numbered, total = with_global_ordinal(df, [F.col("k"), F.col("id")])
    got = rows(numbered.select("rn", "k", "id"), "rn")
    assert total == 1000 and [r[0] for r in got] == list(range(1, 1001)) and got == sorted(got, key=lambda r: (r[1], r[2]))


def test_exact_fraction_zero_and_quota_overshoot(spark):
    assert sampling.exact_fraction(spark.range(4), "id", 0.2, "s").count() == 0
    articles = spark.createDataFrame([("km", i, str(i), 3) for i in range(3)], "type string, pos int, article_id string, images int")
    manifest = spark.createDataFrame([("km", 0)], "type string, next_index int")
    targets = spark.createDataFrame([("km", 0, 5)], "type string, have int, target int")
    assert [r.article_id for r in harvest.resume_quota(articles, manifest, targets).orderBy("pos").collect()] == ["0", "1"]


def test_next_valid(spark):
    df = spark.createDataFrame(list(enumerate([True, False, False, True, False])), "pos int, ok boolean")
    assert [r.substitute for r in pairing.next_valid(df, "pos", "ok").orderBy("pos").collect()] == [0, 3, 3, 3, 0]
    assert [r.substitute for r in pairing.next_valid(df.withColumn("ok", F.lit(False)), "pos", "ok").collect()] == [None] * 5


def test_class_field(spark):
    bodies = ['{"chart_type":null}', "{}", "nope", "[1]", '{"chart_type":5}', '{"chart_type":"km"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    assert [r[0] for r in df.orderBy("i").select(samples.class_field(F.col("b"))).collect()] == ["None", "unknown", "unknown", "unknown", "5", "km"]


@pytest.mark.parametrize(("length", "unmasked", "pads"), [(5, 2, 0), (10, 4, 3), (2, 0, 0)])
def test_token_arrays(spark, length, unmasked, pads):
    array = lambda *x: F.array(*[F.lit(i) for i in x])
    ids, mask, labels, _ = samples.shaped(array(7, 7, 7), array(8, 8, 8), length)
    got = spark.range(1).select(ids.alias("i"), mask.alias("m"), labels.alias("l")).first()
    assert len(got.i) == len(got.m) == len(got.l) == length
    assert sum(x != -100 for x in got.l) == unmasked and got.m.count(0) == pads


def test_names_and_links(spark):
    names = spark.createDataFrame([("k", n) for n in ["chart_001.png", "chart_003.png", "chart_1200.png", "notes.png", "004.png.tmp"]], "type string, name string")
    assert [r.new_name for r in harvest.dense_reindex(names).orderBy("number").collect()] == [f"chart_{i:03d}_k.png" for i in range(1, 5)]
    assert spark.range(1).select(harvest.chart_name(F.lit(1234), F.lit("k"))).first()[0] == "chart_1234_k.png"
    for link, url in [("x.png", "https://h.org/a/x.png"), ("/x", "https://h.org/x"), ("//c/x", "https://c/x"), ("http://o/x", "http://o/x")]:
        assert spark.range(1).select(urls.join(F.lit("https://h.org/a/b?q#f"), F.lit(link))).first()[0] == url


def test_response_ids(spark):
    df = spark.createDataFrame([("<eSearchResult><Count>2</Count><IdList><Id>1</Id><Id>2</Id></IdList></eSearchResult>",), ("<eSearchResult><IdList/></eSearchResult>",)], "body string")
    assert rows(harvest.response_ids(df), "pos") == [("2", 0, "PMC1"), ("2", 1, "PMC2")]


def test_typo_keeps_most_and_is_repeatable(spark):
    df = spark.range(400).select("id", F.lit("green metal bolt").alias("x"))
    made = df.select("id", text.typo_noise(F.col("x"), F.col("id")).alias("y"))
    assert rows(made, "id") == rows(made.repartition(7), "id")
    assert 60 < made.where("y <> 'green metal bolt'").count() < 160


def test_documents_round_trip_and_validation(spark):
    bars = spark.createDataFrame([(1, 1, 0.5, "Patient 1")], "chart int, rank long, value double, label string")
    made = documents.waterfall_documents(bars)
    assert json.loads(made.first().body)["bars"] == [{"label": "Patient 1", "value": 0.5}]
    bad = spark.createDataFrame([("{}",), ("nope",), ('{"chart_type":"waterfall_plot","bars":"x"}',), ('{"chart_type":"waterfall_plot","bars":[]}',), ('{"chart_type":"waterfall_plot","axes":{},"bars":[]}',)], "body string")
    assert [r.valid for r in documents.validate(bad, "waterfall_plot").collect()] == [False, False, False, False, True]


def test_file_tree(spark, tmp_path):
    for path, body in {"labels/km/a.json": b'{"chart_type":"kaplan_meier"}', "labels/e.json": b"{}", "labels/km/f.json": b'"\xff\xfe"', "labels/km/notes.txt": b"x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    found = files.read_labels(spark, str(tmp_path / "labels"), skip_root=True)
    assert sorted(r.base_name for r in found.collect()) == ["a", "f"]
    assert "�" in found.where("base_name = 'f'").first().body
    (tmp_path / "images/km").mkdir(parents=True)
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    png = bytes.fromhex(integrity.PNG) + chunk(b"IHDR", (3).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes(5)) + chunk(b"IEND", b"")
    (tmp_path / "images/km/a.png").write_bytes(png)
    (tmp_path / "images/km/g.png").write_bytes(bytes.fromhex(integrity.PNG) + b"junk")
    images = files.read_images(spark, str(tmp_path / "images"))
    assert [r.image_path.rsplit("/", 1)[1] for r in files.quarantined(images).collect()] == ["g.png"]
    assert dict(rows(files.inventory(images, ["km", "wf"]), "type")) == {"km": 2, "wf": 0}
    default = spark.createDataFrame([(0, "Control")], "pos int, word string")
    (tmp_path / "v.json").write_text('["a", "b"]')
    assert files.read_vocabulary(spark, str(tmp_path / "v.json"), default).count() == 2
    assert files.read_vocabulary(spark, str(tmp_path / "none.json"), default).count() == 1
    query = ingest.start_ingest(ingest.label_stream(spark, str(tmp_path / "labels")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    # Only a class is not enough: the document's parts are missing too.
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 3 == ingest.quarantine(spark, str(tmp_path / "out")).count()


def test_generated_tables_repeat(spark):
    charts = spark.range(5).withColumnRenamed("id", "k")
    one, two = (rows(generate.survival_rows(charts.repartition(n), "k"), "k", "arm", "subject") for n in (1, 5))
    assert one == two and all(0 <= t for _, _, _, t, _ in one)


def test_plans(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") % 3).cast("string").alias("c"))
    plan = sampling.balanced(df, "c", "id", 9, "s")._jdf.queryExecution().executedPlan().toString()
    # Rows are selected by counts of hash bins before they are numbered: nothing is ordered in one task.
    assert "TakeOrderedAndProject" not in plan and "SinglePartition" not in plan


def test_one_type_is_numbered_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [("km", f"chart_{i:03d}_km.png") for i in range(400, 0, -1)] + [(None, "chart_007_x.png")]
        made = harvest.dense_reindex(spark.createDataFrame(rows, "type string, name string")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    own = [r for r in made if r.type == "km"]
    assert len(made) == 401 and all(r.new_name == r.name for r in own)
    assert len({r.task for r in own}) > 1


def test_documents_of_every_kind_are_valid(spark):
    forest = spark.createDataFrame([(1, 0, "Overall", 1.0, 0.5, 1.5), (1, 2, "a", 1.1, 0.6, 1.6), (1, 1, "b", 0.9, 0.4, 1.4)], "chart int, position bigint, study_label string, ratio_value double, ci_lower double, ci_upper double")
    made = documents.validate(documents.forest_documents(forest), "forest_plot").first()
    assert made.valid and [x.study_label for x in made.doc.studies] == ["a", "b"] and made.doc.overall_effect.study_label == "Overall" and made.doc.axes["x"].label == "Hazard Ratio (95% CI)"
    rows = spark.createDataFrame([("c", "s", "2", 2.0), ("c", "s", "1", 1.0), ("c", "r", "1", 3.0)], "chart string, series string, label string, value double")
    made = documents.validate(documents.series_documents(rows), "multi_line").first()
    assert made.valid and [(x.series_name, [(p.x, p.y) for p in x.data]) for x in made.doc.series] == [("r", [("1", 3.0)]), ("s", [("1", 1.0), ("2", 2.0)])]
    both = spark.createDataFrame([([1.5, 2.5, 3.5], [1, 2])], "x array<double>, y array<int>").select(documents.points(F.col("x"), F.col("y")).alias("p")).first().p
    assert [(p.x, p.y) for p in both] == [("1.5", 1.0), ("2.5", 2.0)]


@pytest.mark.parametrize(
    ("kind", "body", "valid"),
    [
        ("waterfall_plot", '{"chart_type":"waterfall_plot","axes":{"y":{"label":"v"}},"bars":[{"label":"a","value":1}]}', True),
        ("waterfall_plot", '{"chart_type":"waterfall_plot","bars":[{"label":"a","value":1}]}', False),
        ("waterfall_plot", '{"chart_type":"waterfall_plot","axes":{},"bars":[{"label":"a"}]}', False),
        ("forest_plot", '{"chart_type":"forest_plot","axes":{},"studies":[],"overall_effect":{"study_label":"o","ratio_value":1,"ci_lower":0.5}}', False),
        ("forest_plot", '{"chart_type":"forest_plot","axes":{},"studies":[],"overall_effect":{"study_label":"o","ratio_value":1,"ci_lower":0.5,"ci_upper":2}}', True),
        ("kaplan_meier", '{"chart_type":"kaplan_meier","axes":{"x":{"label":"t","max_value":9},"y":{"label":"s"}},"arms":[]}', False),
        ("kaplan_meier", '{"chart_type":"kaplan_meier","axes":{"x":{"label":"t","max_value":9},"y":{"label":"s","max_value":1}},"arms":[{"treatment_label":"a","coordinates":[[0,1],[1]],"censoring_ticks":[]}]}', False),
        ("kaplan_meier", '{"chart_type":"kaplan_meier","axes":{"x":{"label":"t","max_value":9},"y":{"label":"s","max_value":1}},"arms":[{"treatment_label":"a","coordinates":[[0,1],[1,0.5]],"censoring_ticks":[]}]}', True),
        ("scatter", '{"chart_type":"scatter","axes":{},"series":[{"series_name":"s","series_type":"scatter","data":[{"x":"1"}]}]}', False),
        ("scatter", '{"chart_type":"simple_bar","axes":{},"series":[]}', False),
        ("scatter", "no json", False),
    ],
)
def test_nested_fields_are_required(spark, kind, body, valid):
    assert documents.validate(spark.createDataFrame([(body,)], "body string"), kind).first().valid is valid


def test_label_sink(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, "a", 2.0)], "chart string, rank bigint, label string, value double")
    documents.write_documents(documents.waterfall_documents(rows), f"file://{tmp_path}/out")
    back = spark.read.json(f"file://{tmp_path}/out").first()
    assert back.category == "waterfall_plot" and json.loads(back.body)["bars"] == [{"label": "a", "value": 2.0}]


def test_images_of_pages(spark):
    html = '<figure><img src="a.png" data-src="/lazy.png"><IMG class="x" src=\'b.jpg\'><img data-src="" src="c.png"><img src="logo.png"><img alt="none"></figure>'
    pages = spark.createDataFrame([(1, "https://h.org/d/p", html), (2, "https://h.org/", None)], "page_id bigint, url string, html string")
    assert [(r.pos, r.url) for r in harvest.image_links(pages).orderBy("pos").collect()] == [(0, "https://h.org/lazy.png"), (1, "https://h.org/d/b.jpg"), (2, "https://h.org/d/c.png")]
    responses = spark.createDataFrame([(1, "image/png"), (2, "text/html"), (3, None), (4, "image/jpeg; q=1")], "id int, content_type string")
    assert [r.id for r in harvest.image_responses(responses).orderBy("id").collect()] == [1, 4]


def test_id_and_word_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("PMC2\nPMC1 \n\nPMC2\n")
    read = files.read_ids(spark, f"file://{tmp_path}/ids.txt")
    assert [tuple(r) for r in read.orderBy("pos").collect()] == [(0, "PMC2"), (1, "PMC1"), (2, ""), (3, "PMC2")]
    for run in ("r1", "r2", "r2"):
        files.append_ids(read, f"file://{tmp_path}/appended", run)
    assert sorted((r.run_id, r["count"]) for r in spark.read.parquet(f"file://{tmp_path}/appended").groupBy("run_id").count().collect()) == [("r1", 4), ("r2", 4)]
    words = spark.createDataFrame([(1, "b"), (0, "a \"q\"")], "pos int, word string")
    files.write_vocabulary(words, f"file://{tmp_path}/words")
    assert [tuple(r) for r in files.read_vocabulary(spark, f"file://{tmp_path}/words", words.limit(0)).orderBy("pos").collect()] == [(0, 'a "q"'), (1, "b")]
    (tmp_path / "list.txt").write_text(" one \n\ntwo\n")
    assert sorted(r.word for r in files.read_words(spark, f"file://{tmp_path}/list.txt").collect()) == ["one", "two"]


def test_manifest_update(spark):
    old = harvest.manifest(spark.createDataFrame([("km", 5)], "type string, next_index int"), ["km", "wf"])
    new = harvest.update_manifest(old, spark.createDataFrame([("wf", 3), ("forest", 1)], "type string, next_index int"))
    assert sorted(tuple(r) for r in new.collect()) == [("forest", 1), ("km", 5), ("wf", 3)]
