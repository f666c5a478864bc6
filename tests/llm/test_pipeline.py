"""The corpus pipeline, stage by stage and as a whole, against a plain version of every stage."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tabulark.llm.quality import CAPITALS, STOP_WORDS, SYMBOLS
from tabulark.llm.queries import vocabulary
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_documents():
    rng = random.Random(31)
    vocabulary_ = [f"{a}{b}{c}" for a in ("mar", "té", "lon", "sik") for b in ("ba", "re", "ñu") for c in ("n", "ll", "tic", "so")]
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else rng.choice(vocabulary_) + rng.choice(["", str(rng.randrange(40))])
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(150)
    texts = [prose(rng.randrange(12, 300)) for _ in range(14)]
    texts += [prose(30) + "\n" + passage + "\n" + prose(20), passage + " " + prose(40), prose(25) + " " + passage]
    texts += [base, base, base.upper().lower()]
    for changed in (1, 3, 40):
        copy = base.split(" ")
        for i in rng.sample(range(150), changed):
            copy[i] = "other" + str(i)
        texts.append(" ".join(copy))
    texts += [None, "", " \n ", "too few words", "same line of five\n" * 12 + prose(12), "# $ % " * 8 + prose(12), prose(30).upper(), prose(3000)]
    texts.append(" ".join(f"w{i}" for i in range(60)))
    return [(3 * i + 1, t, "xx", "made", len(t or "")) for i, t in enumerate(texts)]


def good(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    n, chars = len(w), sum(map(len, w))
    symbols, capitals = (sum(text.count(c) for c in s) for s in (SYMBOLS, CAPITALS))
    stops = sum(x in STOP_WORDS for x in w)
    return (
        n >= 10 and 100 * len(again) <= 20 * n and 3 * n <= chars <= 10 * n and 100 * symbols <= 10 * n
        and 100 * stops >= 5 * n - 200 and 100 * (len(lines) - len(set(lines))) <= 30 * len(lines) and 100 * capitals <= 30 * chars
    )


def firsts(docs):
    """The documents that are the smallest of their component."""
    sets = {}
    for d, text in docs.items():
        w = WORD.findall("".join(c.lower() if c in CAPITALS else c for c in text))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in docs}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d: t for d, t in docs.items() if root[d] == d}


def without_repeats(docs, width=100):
    seen, out = set(), {}
    for d in sorted(docs):
        body, gone = docs[d].encode(), set()
        for i in range(len(body) - width + 1):
            if body[i : i + width] in seen:
                gone.update(range(i, i + width))
            seen.add(body[i : i + width])
        kept, at = [], 0
        for char in docs[d]:
            end = at + len(char.encode())
            if not all(i in gone for i in range(at, end)):
                kept.append(char)
            at = end
        out[d] = "".join(kept)
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("made"))
    rows = made_documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def check_packed(rows, docs):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for d, own in pieces.items():
        ids, at = [*tokenizer.encode(docs[d], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_brute_force(spark, made):
    folder, rows = made
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    expected = {r[0]: r[1] for r in rows if good(r[1])}
    assert 15 < len(expected) < len(rows) - 5
    names = docs.columns
    for name, plain in (("quality_rules", dict), ("near_dedup", firsts), ("suffix_dedup", without_repeats)):
        before, expected = expected, plain(expected)
        assert name == "quality_rules" or before != expected  # the stage has something to do
        docs = stages[name](spark, docs, folder)
        assert docs.columns == names
        found = docs.collect()
        assert {r.doc_id: r.text for r in found} == expected and len(found) == len(expected)
        assert all(r.n_chars == len(r.text) for r in found)
    check_packed(corpus_pipeline.run(spark, folder).collect(), expected)


def test_pipeline_empty(spark, made, tmp_path):
    spark.read.parquet(f"{made[0]}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, made):
    """Repeated and null ids, and columns of names that the stages use themselves."""
    folder, rows = made
    extra = [(rows[0][0], rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (rows[2][0], rows[3][1])]
    every = [(*r, "clash", i) for i, r in enumerate([*rows, *[(d, t, "xx", "made", len(t)) for d, t in extra]])]
    docs = spark.createDataFrame(every, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, n_words int")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "near_dedup", "suffix_dedup"):
        before, docs = docs, stages[name](spark, docs, folder)
        assert docs.columns == before.columns
        found = docs.collect()
        docs = spark.createDataFrame(found, docs.schema)
        by = {d: [r for r in found if r.doc_id == d] for d in (None, rows[0][0], rows[2][0])}
        # Rows without an id are compared with nothing; rows of one id stay or go together.
        assert len(by[None]) == 2 and all(r.text == rows[1][1] for r in by[None]) and len(by[rows[0][0]]) == 2
        assert all(r.ids == "clash" and r.n_chars == len(r.text) for r in found)
    packed = stages["packing"](spark, docs, folder).collect()
    assert sum(r.length for r in packed if r.doc_id is None) == 2 * next(r.doc_tokens for r in packed if r.doc_id is None)
