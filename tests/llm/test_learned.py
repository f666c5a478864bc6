"""Classifier, collocations and vector codes against plain versions, and on odd inputs."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulark.llm import classifier, collocations, fingerprint, hilbert, neardup, vectorcodes
from tabulark.llm.countautomata import CountAutomaton
from tabulark.llm.queries import QUERIES
from tabulark.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def plain_counts(words, ends, depth):
    made = collections.Counter()
    for i in range(len(words)):
        for d in range(1, depth + 1):
            if i + d > len(words) or any(ends[i : i + d - 1]):
                break
            made[tuple(words[i : i + d])] += 1
    return made


def read(automaton):
    names = automaton.symbols.to_pylist()
    return {tuple(names[i] for i in row): int(n) for d in range(1, automaton.depth + 1) for row, n in zip(automaton.words(d), automaton.weights[d - 1], strict=True) if n}


def test_automata_equal_counts():
    rng, total, several = random.Random(5), collections.Counter(), []
    for size in (0, 1, 2, 60, 300, 300):
        words = [rng.choice([b"a", b"b", b"ab", b"c\x01", b"\xc3\xa9", b"zz"]) for _ in range(size)]
        ends = np.array([rng.random() < 0.2 for _ in words], dtype=bool)
        ends[-1:] = True
        made, plain = CountAutomaton.of_words(pa.array(words, pa.binary()), ends, 3), plain_counts(words, ends, 3)
        assert read(made) == plain == read(CountAutomaton.unpacked(made.packed()))
        cuts = sorted({(rng.choice([b"a", b"aa", b"b", b"zz"]), rng.choice([b"", b"a", b"c"])) for _ in range(4)})
        for number, part in made.cut(made.bounds(cuts)):
            own = {k: n for k, n in plain.items() if bisect.bisect_right(cuts, (k[0], k[1] if len(k) > 1 else b"")) == number}
            assert read(CountAutomaton.unpacked(part.packed())) == own
        several.append(made)
        total += plain
    united = CountAutomaton.union(several)
    frequent = united.at_least(10)
    assert read(united) == total and read(frequent) == {k: n for k, n in total.items() if n >= 10}
    asked = [b" ".join(k) for k in total] + [b"nope", b"a nope", b"a a a a"]
    assert list(frequent.composed(pa.array(asked, pa.binary()))) == [n if (n := total[tuple(p.split(b" "))]) >= 10 else 0 for p in asked]


def test_equal_states_are_shared():
    words = [x for i in range(3000) for x in (b"h%d" % i, b"same", b"rest")]
    one = CountAutomaton.of_words(pa.array(words, pa.binary()), np.arange(len(words)) % 3 == 2, 3)
    other = CountAutomaton.of_words(pa.array([x if i % 3 == 0 else x + b"%d" % (i // 3) for i, x in enumerate(words)], pa.binary()), np.arange(len(words)) % 3 == 2, 3)
    # The size before compression.
    size = lambda a: int.from_bytes(a.packed()[:8], "little")
    assert size(one) * 5 < size(other)


def plain_collocations(rows, most_words, least, cover, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(plain_counts(words, [False] * len(words), most_words))
    made = []
    for lang in f:
        candidates, found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}, []
        for p, a in candidates.items():
            score, k = min((1000000 * a * a // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                found.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        made += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(made)


@pytest.mark.parametrize("most_words", [2, 3, 4])
def test_collocations_on_odd_inputs(spark, most_words, monkeypatch):
    rng = random.Random(2)
    words = ["the"] * 6 + ["New", "york", "city", "É", "a\x01b", "ok", "x"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), t) for t in texts] + [("en", None), ("en", ""), (None, " .,\n "), ("fr", "one"), ("en", "new york city, " * 4000), ("en", "word " * 3000)]
    df = spark.createDataFrame([(i % 3, lang, t, 1, "c") for i, (lang, t) in enumerate(rows)], "doc_id int, lang string, text string, f int, phrase string").repartition(3)
    found = collocations.mine(df, most_words=most_words, least=5, cover=50, top=40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, most_words, 5, 50, 40)


def test_collocations_without_documents(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_scores_pass_64_bits():
    big = 10**12
    a, left, right = (np.array(x, dtype=np.int64) for x in ([big, 7], [big * 3, 8], [big * 2, 9]))
    assert list(collocations.scores(a, left, right)) == [1000000 * big * big // (6 * big * big), 1000000 * 49 // 72]


def test_ranges_follow_the_words(spark):
    words = spark.createDataFrame([("en", "a", 10), ("en", "the", 900), ("en", "z", 90)], "lang string, word string, f bigint")
    cuts = collocations.prefix_ranges(words, 10)
    assert cuts["en"] == sorted(set(cuts["en"])) and len([c for c in cuts["en"] if c[0] == b"the"]) > 1
    assert collocations.prefix_ranges(words.limit(0), 10) == {}


def plain_lloyd(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // parts)
    whole = [([math.floor(256 * float(np.float32(x))) for x in v] + [0] * (parts * width - len(v))) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, [np.float32(x) for x in kept[i][1]]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(whole[i], p) for i in first] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = [[[] for _ in first] for _ in range(parts)]
        for v in whole:
            for p in range(parts):
                members[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members[p], books[p], strict=True)] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(i, lab, [near(v, p) for p in range(parts)]) for (i, _, lab), v in zip(kept, whole, strict=True)]
    by = collections.Counter()
    for _, lab, found in coded:
        by[lab] += sum(d for d, _ in found)
    return sorted([(i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), by[lab], digest) for i, lab, found in coded], key=str)


@pytest.mark.parametrize(("parts", "entries"), [(4, 8), (3, 64), (16, 1)])
def test_vector_codes_on_odd_inputs(spark, parts, entries):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.normal(0, 0.3, (90, 12)).astype(np.float32)]
    hot, far = vectors[3], [float(x) for x in rng.normal(0, 3000, 12).astype(np.float32)]
    rows = [(int(i), v, int(i) % 4) for i, v in enumerate(vectors)] + [(200 + i, hot, None) for i in range(60)]
    rows += [(500, None, 1), (501, [*hot[:11], None], 1), (502, [*hot[:11], float("nan")], 1), (503, [*hot[:11], float("-inf")], 1), (504, far, 1), (505, hot[:5], 2), (506, [], 2), (None, hot, 3), (7, vectors[7], 3), (7, vectors[8], None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id bigint, embedding array<float>, label int, error int, code string").repartition(3)
    found = vectorcodes.lloyd(df, parts=parts, entries=entries, rounds=2)
    assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_lloyd(rows, parts, entries, 2)
    assert vectorcodes.lloyd(df.where("false")).count() == 0 == vectorcodes.lloyd(df.where("vec_id = 500")).count()


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError, match="too large"):
        vectorcodes.whole_numbers(np.array([1e9]))


def test_cover_trees_cover_and_decide_subtrees():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-40, 40, (700, 4)), np.repeat(rng.integers(-40, 40, (1, 4)), 300, axis=0)])
    rng.shuffle(points)
    points = np.concatenate([points, rng.integers(-400, 400, (1000, 4))])
    tree = vectorcodes.CoverTree.build(points, 2)
    for node in range(len(tree.count)):
        below = points[tree.rows[tree.begin[node] : tree.begin[node] + tree.count[node]]]
        away = ((below - tree.center[node]) ** 2).sum(1)
        assert (below.sum(0) == tree.total[node]).all() and away.max() == round(tree.radius[node] ** 2)
        if tree.first[node] >= 0:
            kids = np.arange(tree.first[node], tree.first[node] + tree.children[node])
            assert tree.count[kids].sum() == tree.count[node] and (tree.center[kids[0]] == tree.center[node]).all()
            assert all((tree.radius[kids] ** 2).round() * 4 <= away.max())
            gaps = ((tree.center[kids][:, None] - tree.center[kids][None]) ** 2).sum(2) + np.eye(len(kids)) * 10**9
            assert (gaps * 4 > away.max()).all()
        else:
            assert tree.count[node] <= vectorcodes.LEAF or tree.radius[node] == 0
    books = np.stack([points[:16], points[1000:1016]])
    expected = vectorcodes.squared(points, np.repeat([0, 1], 1000), books).argmin(1)
    decided, codes = [], np.full(2000, -1)
    for _, entry, count, _, begin in tree.walk(books, 2, points):
        codes[tree.rows[vectorcodes._runs(begin, count)]] = np.repeat(entry, count)
        decided += list(count)
    assert (codes == expected).all() and sum(decided) == 2000 and max(decided) >= 300


def plain_features(text):
    kind = lambda c: 0 if c in " \t\n\x0b\x0c\r" else 1 if c.isascii() and c.isalnum() or not c.isascii() else 2
    tokens, last = [], 0
    for c in text or "":
        if kind(c) and kind(c) == last:
            tokens[-1] += c
        elif kind(c):
            tokens.append(c)
        last = kind(c)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in tokens]

    def shape(i):
        t, n = tokens[i], len(re.findall("[A-Z]", tokens[i]))
        own = low[i] if kind(t[0]) == 2 else 3 if re.fullmatch("[0-9]+", t) else 2 if n == len(t.encode()) > 1 else 1 if n else 0
        return own, *[i >= lag and low[i] == low[i - lag] for lag in (1, 2)]

    shapes = [shape(i) for i in range(len(tokens))]
    grams = lambda items, n: [tuple(items[i : i + n]) for i in range(len(items) - n + 1)] if items else []
    made = {"": 1.0}
    for family, found in enumerate((grams(low, 1), grams(low, 2), grams(shapes, min(3, len(shapes) or 1)))):
        made |= {(family, g): math.sqrt(n / len(found)) for g, n in collections.Counter(found).items()}
    return made


def test_classifier_equals_a_plain_one(spark):
    """The plain one has one weight for each n-gram; ours may share some, which moves scores a little."""
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        if abs(z[k]) <= classifier.L1:
            return 0.0
        return -(z[k] - math.copysign(classifier.L1, z[k])) / ((classifier.BETA + math.sqrt(n[k])) / classifier.ALPHA + classifier.L2)

    score = lambda x: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
    for d in sorted((d for d in labels if not held(d) and d in docs), key=lambda d: hashlib.md5(str(d).encode()).hexdigest()):
        x = plain_features(docs[d])
        p = score(x)
        step = {k: (p - labels[d]) * v for k, v in x.items()}
        moved = {k: weight(k) for k in x}
        for k, g in step.items():
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / classifier.ALPHA * moved[k]
            n[k] += g * g
    found = {r.doc_id: r for r in QUERIES["op11_quality_classifier"](spark, SF).collect()}
    assert set(found) == set(docs)
    for d, r in found.items():
        assert r.held_out == held(d) and r.predicted == int(r.score >= 0.7) and abs(r.score - score(plain_features(docs[d]))) < 0.02


def test_classifier_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    found = [(r.predicted, labels[r.doc_id]) for r in QUERIES["op11_quality_classifier"](spark, "/root/testdata/sf0.1").where("held_out").collect() if r.doc_id in labels]
    good, bad = [p for p, q in found if q == 1], [p for p, q in found if q == 0]
    assert len(good) > 700 and len(bad) > 100
    assert sum(good) / len(good) > 0.99 and 1 - sum(bad) / len(bad) > 0.95


def test_classifier_on_odd_inputs(spark):
    rows = [(i, "good words here" if i % 2 else "BAD!! BAD!! ###") for i in range(40)] + [(3, "a second text of this key"), (50, None), (51, ""), (52, " \n "), (None, "good words here"), (53, "good " * 20000)]
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id bigint, text string, score int, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (6, 7), (999, 1), (50, 1)], "doc_id bigint, quality int")
    model = classifier.fit(docs, labels, F.lit(True))
    scored = classifier.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    by = collections.defaultdict(set)
    for (_, text), r in zip(sorted(rows, key=str), sorted(scored, key=lambda r: str((r.doc_id, dict(rows).get(r.doc_id)))), strict=True):
        by[r.doc_id].add(r.score)
    one, two, plain = (next(iter(by[k])) for k in (1, 2, 51))
    assert one > 0.7 > two and by[51] == by[52] and by[None] == by[1] and 0 < plain < 1
    # A bound of two rows is a model of two rows; none at all leaves every score in the middle.
    assert len(classifier.fit(docs, labels, F.lit(True), most=2)[0]) < len(model[0])
    none = classifier.fit(docs, labels, F.lit(False))
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(docs.where("false"), model).count() == 0


def test_fingerprints_against_plain_densification():
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    for bins, size in ((16, 1), (16, 9), (64, 40), (64, 2000)):
        shingles = sorted(random.Random(size).randrange(1 << 64) for _ in range(size))
        filled = {}
        for x in shingles:
            place = (x >> 40) % bins
            filled[place] = min(filled.get(place, mask), mixed(x))
        expected = []
        for at in range(bins):
            source, k = at, 0
            while source not in filled:
                # A hash of the bin and the attempt, until it names a bin that was filled.
                k += 1
                source = mixed(mixed(at + (k << 32))) % bins
            expected.append(filled[source])
        assert fingerprint.signature(np.array(shingles, dtype=np.uint64), bins).tolist() == expected
        digits = "".join(f"{x & 15:x}" for x in expected)
        assert fingerprint.pack(fingerprint.signature(np.array(shingles, dtype=np.uint64), bins)) == digits


def test_hilbert_curve_of_five_bits_is_a_walk(spark):
    cells = spark.range(1 << 15).select(*[F.shiftright("id", 5 * i).bitwiseAND(31).alias(c) for i, c in enumerate("xyz")])
    found = sorted(cells.select("x", "y", "z", hilbert.hilbert_index([F.col(c) for c in "xyz"], 5).alias("at")).collect(), key=lambda r: r.at)
    assert [r.at for r in found] == list(range(1 << 15))
    steps = np.abs(np.diff(np.array([[r.x, r.y, r.z] for r in found]), axis=0)).sum(1)
    assert (steps == 1).all()


def test_a_wide_bucket_is_dealt_in_proportion_to_its_members(spark):
    """Unlike members that share 30 of 50 shingles, and two that share 47."""
    own = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.col("id") * 100 + 1000 + i)
    shared = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: i.cast("bigint"))
    near = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when(i < 3, F.col("id") * 100 + 1000 + i).otherwise(F.lit(1000) + i))
    dealt = []
    for many in (5_000, 20_000):
        members = spark.range(many).select(F.lit(7).cast("bigint").alias("bucket"), "id", F.col("id").alias("component"), F.lit(50).cast("bigint").alias("n"), F.lit(many).cast("bigint").alias("size"))
        sets = spark.range(many).select("id", F.concat(shared, F.when(F.col("id") == many - 1, near).otherwise(own)).alias("shingles"))
        scratch = Scratch(spark, "wide")
        made = neardup._parted(members, lambda ids, name, sets=sets, scratch=scratch: scratch.write(sets.join(ids.distinct(), "id"), name), scratch, 80, wide=100)
        assert {r.band for r in made.select("band").distinct().collect()} == {7}
        assert {r.id for r in made.select("id").distinct().collect()} == {0, many - 1}
        dealt.append(neardup._dealt(neardup._numbered(made)).count())
    # Blocks would deal each of 20000 members to 10 pairs of blocks; here only the two that can be alike are left.
    assert dealt[0] == dealt[1] <= 2 * 11


def test_wide_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(80), rng.choice([1, 2, 5, 9])):
            words[at] = f"x{rng.randrange(6)}-{at}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    sets = {i: {tuple(w[k : k + 4]) for k in range(77)} for i, w in ((i, t.split(" ")) for i, t in rows)}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    monkeypatch.setattr(neardup._parted, "__defaults__", (1,))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4, percent=80)
    assert {r.doc_id: r.component_id for r in found.collect()} == root and 1 < len(set(root.values())) < 60


@pytest.mark.parametrize("hot_rows", [1, 1 << 14])
def test_hot_ids_are_several_ranges(spark, hot_rows):
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randint(1, 30)))) for d in [None] * 40 + [7] * 50 + [8] * 3 + list(range(20))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    place = {r.text: r.h for r in df.select("text", F.shiftright(F.xxhash64("text"), 1).alias("h")).collect()}
    counts = collections.Counter(d for d, _ in rows)
    hot = {d for d in counts if counts[d] > max(hot_rows, len(rows) // 16)} if hot_rows == 1 else set()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), place[r[1]] if r[0] in hot else 0, r[1]))
    expected = collections.Counter()
    for (d, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        expected[d, text[: len(text) - len(text) // 3] + after[: len(text) // 3]] += 1
    made = fingerprint.edited_pairs(df, hot_rows=hot_rows)
    assert collections.Counter((r.doc_id, r.edited_text) for r in made.collect()) == expected
    if hot:
        dealt = fingerprint.in_order(df, "doc_id", "text", hot_rows).where("not _next").groupBy("doc_id").agg(F.count_distinct("_range").alias("n")).collect()
        assert {r.doc_id for r in dealt if r.n > 1} == {None, 7}
