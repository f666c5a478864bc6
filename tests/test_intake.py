"""Links, figures, image files, resumable runs, the label stream, and samples of any size."""

import json
import random
import re
import struct
import zlib
from hashlib import md5
from pathlib import Path
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from tabulark.functions import integrity, urls
from tabulark.functions.ordinal import owned_tables, shared_folder, with_global_ordinal
from tabulark.functions.permutation import permuted
from tabulark.functions.selection import smallest
from tabulark.operators import harvest, runs, samples, sampling, text
from tabulark.queries import ORACLES, QUERIES
from tabulark.sources import files
from tabulark.streaming import ingest

BASES = ["https://h.org/a/b/c?q#f", "http://a/b/c/d;p?q", "https://h.org", "https://h.org/a/b/", "HTTP://U@h.org:8/x//y/z", "mailto:x@y", "a/b/c", "https://h.org/.."]
REFERENCES = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h".split()
REFERENCES += "g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g HTTPS://X/y ? # ?# //x.org//a//b a//b ///p a;b/c;d ..;x ; mailto:z@w 1a:b /a/b/../../c?x=../y //;;a".split()
REFERENCES += ["", " x", "\tx\n/y", " /x ", "x y", "é/ü?ñ", "..//x"]


def test_references_of_all_forms_equal_the_standard_join(spark):
    draw = random.Random(3)
    made = ["".join(draw.choice(["a", ".", "..", "/", "//", ";", "?", "#", ":", "g", "../"]) for _ in range(draw.randint(1, 7))) for _ in range(300)]
    rows = [(b, r) for b in BASES for r in dict.fromkeys(REFERENCES + made)]
    found = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.join(F.col("b"), F.col("r")).alias("u")).collect()
    assert {(x.b, x.r): x.u for x in found} == {(b, r): urljoin(b, r) for b, r in rows}
    assert spark.range(1).select(urls.join(F.lit(None).cast("string"), F.lit("x"))).first()[0] is None


def test_only_images_of_figures(spark):
    cases = [
        ('<img src=o><div class="a  fig b"><p>open <figure><img src=i1></div><img src=o></figure><img src=o>', ["i1"]),
        ("<div><figure><span><img src=i0></div><img src=o>", ["i0"]),
        ('<figure><img src=i0><img src=i1 /><br><div/><img data-src=i2 alt="x > y" src=no>', ["i0", "i1", "i2"]),
        ('<!-- <figure> --><img src=o><script>"<figure>"</script><img src=o><div data-class="fig"><img src=o></div><DIV CLASS=part-figure><img data-x="src=no" src=i3></DIV></figure><img src=o>', ["i3"]),
        ("<section class='fig'><section><img src=i0></section><img src=i1></section><img src=o><div class='figs'><img src=o></div>", ["i0", "i1"]),
        ("<figure", []),
        ("", []),
        (None, []),
    ]
    pages = spark.createDataFrame([(i, "https://h.org/p", html) for i, (html, _) in enumerate(cases)], "page_id bigint, url string, html string")
    found = [(r.page_id, r.link) for r in harvest.image_links(pages).orderBy("page_id", "pos").collect()]
    assert found == [(i, link) for i, (_, links) in enumerate(cases) for link in links]


def _chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(width=3, height=2, cuts=1):
    coded = zlib.compress(b"".join(b"\0" + bytes(range(3 * width)) for _ in range(height)))
    step = max(1, len(coded) // cuts)
    parts = b"".join(_chunk(b"IDAT", coded[i : i + step]) for i in range(0, len(coded), step))
    return bytes.fromhex(integrity.PNG) + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + parts + _chunk(b"IEND", b"")


def _segment(marker, data):
    return bytes([255, marker]) + struct.pack(">H", len(data) + 2) + data


PHOTO = b"\xff\xd8" + _segment(0xE0, b"JFIF\0" + bytes(9)) + _segment(0xC2, bytes(15)) + _segment(0xDA, bytes(10)) + b"\x12\xff\x00\x34\xff\xd0\x99"
PHOTO += _segment(0xC4, bytes(5)) + b"\xff\xff" + _segment(0xDA, bytes(4))[1:] + b"zz\xff\x00"


def test_damaged_images_are_noticed(spark):
    cases = [
        (png(), None),
        (png(60, 60, 2000), None),
        (png() + b"after", None),
        (png()[:-5], "truncated"),
        (png()[:-12], "truncated"),
        (png()[:45] + bytes([png()[45] ^ 1]) + png()[46:], "checksum"),
        (png()[:8] + png()[33:], "structure"),
        (png(0, 2), "structure"),
        (png()[:8], "truncated"),
        (png()[:8] + b"\xff\xff\xff\xff" + png()[12:], "truncated"),
        (PHOTO + b"\xff\xd9", None),
        (PHOTO + b"\xff\xd9after", None),
        (PHOTO, "truncated"),
        (PHOTO[:30], "truncated"),
        (b"\xff\xd8\xff\xd9", "structure"),
        (b"\xff\xd8\xff\xe0\x00\x01zz", "structure"),
        (b"\xff\xd8\xff\xe0\x00\x04zzjunk", "structure"),
        (b"\xff\xd8" + _segment(0xDA, bytes(4)) + b"x\xff\xd9", "structure"),
        (b"GIF89a", "unknown"),
        (b"", "empty"),
        (None, "empty"),
    ]
    rows = spark.createDataFrame([(i, content) for i, (content, _) in enumerate(cases)], "i int, content binary")
    assert [r.d for r in rows.select("i", integrity.damage(F.col("content")).alias("d")).orderBy("i").collect()] == [d for _, d in cases]


def test_image_source_agrees(spark, tmp_path):
    (tmp_path / "whole.png").write_bytes(png(5, 4))
    (tmp_path / "cut.png").write_bytes(png(5, 4)[:40])
    assert [(r.image_path.rsplit("/", 1)[1], r.width, r.height) for r in files.decodable(spark, str(tmp_path)).collect()] == [("whole.png", 5, 4)]
    images = files.read_images(spark, str(tmp_path))
    for _ in range(2):
        files.write_quarantine(images, f"file://{tmp_path}/aside", "r1")
    assert [(r.image_path.rsplit("/", 1)[1], r.reason) for r in spark.read.parquet(f"file://{tmp_path}/aside").collect()] == [("cut.png", "truncated")]


@pytest.fixture
def harvest_tables(spark):
    articles = spark.createDataFrame([("km", i, f"a{i}", 3) for i in range(10)] + [("wf", i, f"b{i}", 2) for i in range(3)], "type string, pos bigint, article_id string, images bigint")
    return articles, lambda aim: spark.createDataFrame([("km", aim), ("wf", aim)], "type string, target bigint")


@pytest.mark.parametrize("fails_in", ["append", "write_version", "swap", "after"])
def test_a_run_repeated_after_a_failure_leaves_the_same_manifest(spark, tmp_path, monkeypatch, harvest_tables, fails_in):
    articles, targets = harvest_tables
    manifest, images = runs.Manifest(spark, f"file://{tmp_path}/m"), f"file://{tmp_path}/i"
    assert manifest.current() is None and manifest.read().count() == 0
    runs.harvest_run(articles, manifest, targets(7), "r1", images)

    def broken(real, before):
        def call(*args):
            if not before:
                real(*args)
            raise RuntimeError("lost")

        return call

    with monkeypatch.context() as patch:
        if fails_in == "append":
            patch.setattr(runs.files, "append_ids", broken(files.append_ids, False))
        elif fails_in in ("write_version", "swap"):
            patch.setattr(manifest, fails_in, broken(getattr(manifest, fails_in), fails_in == "swap"))
        elif fails_in == "after":
            patch.setattr(manifest, "swap", broken(manifest.swap, False))
        if fails_in:
            with pytest.raises(RuntimeError):
                runs.harvest_run(articles, manifest, targets(12), "r2", images)
            assert manifest.current() == ("r2" if fails_in == "after" else "r1")
    for _ in range(2):
        left = runs.harvest_run(articles, manifest, targets(12), "r2", images)
        assert sorted(map(tuple, left.collect())) == [("km", 4, 12), ("wf", 3, 6)]
    kept = spark.read.parquet(images)
    assert sorted((r.type, r.pos, r.first_number) for r in kept.collect()) == [("km", 0, 1), ("km", 1, 4), ("km", 2, 7), ("km", 3, 10), ("wf", 0, 1), ("wf", 1, 3), ("wf", 2, 5)]
    assert {r.global_total for r in runs.with_total(left).collect()} == {18}
    assert json.loads(runs.as_json(left).first().value) == {"km": 4, "wf": 3, "global_total": 18}


LABELS = [
    ('{"chart_type":"waterfall_plot","axes":{"y":{"label":"v"}},"bars":[{"label":"a","value":1}]}', None),
    ('{"chart_type":"forest_plot","axes":{},"studies":[],"overall_effect":{"study_label":"o","ratio_value":1,"ci_lower":0.5}}', "incomplete"),
    ('{"chart_type":"waterfall_plot","bars":[]}', "incomplete"),
    ("[1]", "unreadable"),
    ('{"a":', "unreadable"),
    ('"text"', "unreadable"),
    ('{"chart_type":"pie"}', "unknown kind"),
    ('{"x":1}', "unknown kind"),
    ('{"chart_type":null}', "unknown kind"),
]


def test_stream_puts_bad_labels_aside_and_replays_nothing(spark, tmp_path):
    (tmp_path / "labels/km").mkdir(parents=True)
    for i, (body, _) in enumerate(LABELS):
        (tmp_path / f"labels/km/{i}.json").write_text(body)
    out = f"file://{tmp_path}/out"

    def run():
        ingest.start_ingest(ingest.label_stream(spark, str(tmp_path / "labels"), 4), out, f"file://{tmp_path}/state").awaitTermination()
        counts = spark.read.parquet(f"{out}/counts").agg(F.sum("rows").alias("n"), F.sum("bad").alias("bad")).first()
        return sorted((r.body, r.reason, r.batch) for r in spark.read.parquet(f"{out}/rows").collect()), counts

    rows, counts = run()
    assert {(b, why) for b, why, _ in rows} == set(LABELS) and (counts.n, counts.bad) == (9, 8)
    assert {r.reason for r in ingest.quarantine(spark, out).collect()} == {"unreadable", "unknown kind", "incomplete"}
    # The last batch was written, but its commit is lost: it is done again, under its number.
    last = max((tmp_path / "state/commits").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run()[0] == rows


@pytest.mark.parametrize("small", [2, 1 << 16])
def test_selection_equals_a_sort(spark, small):
    rows = [(None if i % 10 == 9 else "hot" if i % 3 else f"g{i % 4}", i // 2, md5(str(i // 2).encode()).hexdigest()) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, hx string")
    for most in (0, 7, 150, 1000):
        expected = []
        for g in {r[0] for r in rows}:
            expected += sorted([r for r in rows if r[0] == g], key=lambda r: (r[2], r[1]))[:most]
        assert sorted(map(tuple, smallest(df, ["g"], "hx", ["k"], most, small).collect()), key=str) == sorted(expected, key=str)
        assert sorted(map(tuple, smallest(df, [], "hx", ["k"], most, small).select("hx", "k").collect())) == sorted((r[2], r[1]) for r in rows)[:most]
    assert smallest(df.limit(0), ["g"], "hx", ["k"], 3, small).count() == 0 == smallest(df.limit(0), [], "hx", ["k"], 3, small).count()


def test_caps_use_no_one_task_sort(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("category"), F.col("id").cast("string").alias("base_name"))
    for made in (sampling.shuffle_cap(df, "id", 700, "s"), sampling.first_n(df, 700), sampling.balanced(df, "category", "id", 700, "s")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        # Whatever numbers rows does so within a range or a bin.
        assert "TakeOrderedAndProject" not in plan and not re.search(r"row_number\(\) windowspecdefinition\([^,()]* ASC", plan)
    order = sorted(range(2000), key=lambda i: (md5(f"s:{i}".encode()).hexdigest(), i))
    assert [r.id for r in sampling.shuffle_cap(df, "id", 700, "s").orderBy("ordinal").collect()] == order[:700]
    pairs = sorted((str(i % 3), str(i)) for i in range(2000))
    assert sorted((r.category, r.base_name) for r in sampling.first_n(df, 700).collect()) == pairs[:700]
    assert sampling.first_n(df, 5000).count() == 2000 and sampling.first_n(df, 0).count() == 0
    got = sampling.balanced(df, "category", "id", 700, "s").collect()
    for c in range(3):
        assert [r.id for r in sorted((r for r in got if r.category == str(c)), key=lambda r: r.rn)] == [i for i in order if i % 3 == c][:233]


@pytest.mark.parametrize("n", [1, 2, 7, 97, 1000])
def test_permutation_is_one_to_one(spark, n):
    df = spark.range(n).select("id", F.explode(F.array(*[F.lit(e) for e in range(3)])).alias("e"))
    got = df.select("id", "e", permuted(F.col("id"), n, "k", F.col("e")).alias("p")).collect()
    orders = [[r.p for r in sorted((r for r in got if r.e == e), key=lambda r: r.id)] for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 10 or len({tuple(o) for o in orders}) == 3 and all(o != list(range(n)) for o in orders)


def test_epochs_are_batches_of_all_rows(spark):
    made = sampling.epochs(spark.range(100).withColumn("x", F.col("id") * 2), "id", 3, 8, 4, "s")
    for e in range(3):
        rows = made.where(F.col("epoch") == e).collect()
        assert len(rows) == 96 and len({r.id for r in rows}) == 96 and {r.batch for r in rows} == set(range(12)) and {r.step for r in rows} == {0, 1, 2}
        assert all(r.x == 2 * r.id for r in rows)
    assert sampling.epochs(spark.range(0), "id", 2, 8, 4, "s").count() == 0


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    ids = [f"PMC{i}" if i % 7 else "" for i in range(500)]
    (tmp_path / "ids.txt").write_text("\n".join(ids) + "\n")
    found = []
    for size in ("512", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found.append([tuple(r) for r in files.read_ids(spark, f"file://{tmp_path}/ids.txt").orderBy("pos").collect()])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == list(enumerate(ids))


def test_capped_union_counts_repeats(spark):
    one = spark.createDataFrame([(i, "hot" if i % 2 else f"a{i}") for i in range(20)], "pos bigint, article_id string")
    got = harvest.capped_union([one, one.where("pos < 3")], 10).collect()
    assert sorted((r.query, r.pos) for r in got) == [(0, i) for i in range(10)] + [(1, i) for i in range(3)]
    assert sorted(r.occurrence for r in got if r.article_id == "hot") == [1, 2, 3, 4, 5, 6]


def test_owned_tables_go(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    with pytest.raises(RuntimeError, match="lost"), owned_tables(spark):
        with_global_ordinal(spark.range(10), [F.col("id")])
        assert {p.name for p in folder.iterdir()} != before
        raise RuntimeError("lost")
    assert {p.name for p in folder.iterdir()} == before


def test_appended_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "pos int, id string")
    for mode in ("append", "append", "overwrite", "append"):
        files.append_ids(rows, f"file://{tmp_path}/x", "r", mode)
    assert spark.read.parquet(f"file://{tmp_path}/x").count() == 2


def test_many_labels_are_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"scan/c{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"scan/c{i % 3}/{i}.json").write_bytes([b"", b"\xef\xbb\xbf{}", b'"\xff\xfe"', b'{"a": 1}\r\n\n'][i % 4])
    found = files.read_labels(spark, f"file://{tmp_path}/scan")
    assert found.rdd.getNumPartitions() <= 4
    path = F.col("_metadata.file_path")
    whole = spark.read.text(f"file://{tmp_path}/scan", wholetext=True, recursiveFileLookup=True).select(path.alias("label_path"), F.hex(F.col("value").cast("binary")))
    assert sorted(found.select("label_path", F.hex(F.col("body").cast("binary"))).collect()) == sorted(whole.collect())


def test_labels_written_one_a_file(spark, tmp_path):
    rows = [(f"c{i % 3}" if i % 5 else None, f'{{"é": {i}}}') for i in range(300)] + [("none", None)]
    labels = spark.createDataFrame(rows, "category string, body string")
    for per_file in (1, 7):
        files.write_labels(labels, f"file://{tmp_path}/a b/x", per_file)
    lines, sizes = [], []
    for path in (tmp_path / "a b").rglob("*"):
        if path.is_file():
            assert path.suffix == ".json"  # nothing half-written stays
            body = path.read_text()
            lines += [(None if path.parent.name == "x" else path.parent.name, x) for x in body.removesuffix("\n").split("\n")]
            sizes.append(body.count("\n"))
    assert sorted(lines, key=str) == sorted([(c, b or "") for c, b in rows] * 2, key=str)
    assert sizes.count(1) >= 301 and max(sizes) == 7
    got = files.read_labels(spark, f"file://{tmp_path}/a b/x", skip_root=True).where("body <> '\n'")
    assert {r.category for r in got.collect()} == {"c0", "c1", "c2"}


def test_label_scan_on_odd_suppliers(spark, tmp_path):
    rows = [(i, f"S\n\"{i}\"" if i % 4 else None, i % 6 or None) for i in range(60)] + [(None, "x", 2), (7, "S", 3), (7, "S", 3)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    columns = "category, s_suppkey, named, name_md5"
    got = [tuple(r) for r in QUERIES["label_scan"](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(con.sql(f"SELECT {columns} FROM ({ORACLES['label_scan']})").fetchall(), key=str)


def test_arm_labels(spark):
    rows = spark.createDataFrame([(s, i) for s in (*text.ARM_STYLES, "none") for i in range(4)], "s string, i int")
    got = rows.select("s", text.arm_label(F.col("s"), F.col("i")).alias("x")).collect()
    assert [r.x for r in got if r.s == "Treatment"] == [f"Treatment {c}" for c in "ABCD"]
    assert [r.x for r in got if r.s == "Drug"] == [f"Drug {chr(88 + i)}" for i in range(4)]
    assert [r.x for r in got if r.s == "Cohort"] == [f"Cohort {i}" for i in range(1, 5)]
    assert [r.x for r in got if r.s in ("Dose", "none")] == [*text.ARM_DOSES, None, None, None, None]


def test_written_out_prefix(spark):
    mask, labels = samples.expanded_prefix(F.array(F.lit(1), F.lit(0)), F.array(F.lit(7), F.lit(-100)), 3)
    assert tuple(spark.range(1).select(mask, labels).first()) == ([1, 1, 1, 1, 0], [-100, -100, -100, 7, -100])
