"""The query functions without SQL over whole small tables, against libraries and plain versions; and odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulark.llm import fingerprint, hilbert, idcoder, idfiles, packing, phrases, pieces, suffixes, warc
from tabulark.llm.anchors import merged, of_slice, word_keys
from tabulark.llm.components import components
from tabulark.llm.queries import QUERIES, vocabulary
from tabulark.llm.scratch import Scratch
from tabulark.llm.textarrays import sliding_argmin, utf8
from tabulark.llm.tokenize import Encoder, Table
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    read = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pylist()
    return {r["doc_id"]: r for r in read}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def library_ids(name, docs, end):
    tokenizer = Tokenizer.from_file(vocabulary(name))
    return {d: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, end] for d, r in docs.items()}


def test_op1_against_the_library(spark, docs):
    ids, at, sequences = library_ids("byte_bpe_50k.json", docs, 1), {}, {}
    for r in sorted(QUERIES["op1_packing"](spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        at[r.doc_id] = r.start + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {d: len(x) for d, x in ids.items()}
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist() and sum(spans[-1]) <= 2048
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_placement_closes_most_windows():
    rng, packer = np.random.default_rng(1), packing.SumOfSquares(2048)
    sizes = np.clip(rng.lognormal(6.2, 1.0, 8000).astype(int), 1, 40000)
    for d, n in enumerate(sizes.tolist()):
        packer.add(d, bytes(4 * n))
    packer.top_up(last=True)
    by = packer.closed_by
    assert by["placed"] > 3 * by["topped"]
    assert sum(len(i) // 4 for w in packer.closed for _, _, _, i in w) == sizes.sum() and len(packer.closed) == -(-sizes.sum() // 2048)
    short = packing.SumOfSquares(2048, most_open=20)
    for d, n in enumerate(sizes[:500].tolist()):
        short.add(d, bytes(4 * n))
        assert sum(len(w) for w in short.levels) == short.open <= 20
    short.top_up(last=True)
    assert len(short.closed) == -(-sizes[:500].sum() // 2048)


def test_op6_against_the_library(spark, docs):
    ids, start = library_ids("word_bpe_49k.json", docs, 2), 0
    got = sorted(QUERIES["op6_token_files"](spark, SF).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted(ids)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        start += r.n_tokens


def test_coder_beats_zlib_and_bounds_headers(docs):
    every = np.array([i for x in library_ids("word_bpe_49k.json", docs, 2).values() for i in x], dtype="<u4")
    blocks = [every[i : i + idcoder.BLOCK_IDS] for i in range(0, 4 * idcoder.BLOCK_IDS, idcoder.BLOCK_IDS)]
    coded = idcoder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, idcoder.decode(coded), strict=True))
    assert sum(map(len, coded)) < 0.98 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 6)) for b in blocks)
    small = idcoder.encode([blocks[0][:50]])[0]
    for at in range(16):  # every byte of the header
        for bit in (0x01, 0x80):
            damaged = bytearray(small)
            damaged[at] ^= bit
            with pytest.raises(idcoder.CorruptBlock):
                idcoder.decode([bytes(damaged)])
    with pytest.raises(ValueError):
        idcoder.encode([np.zeros(idcoder.BLOCK_IDS + 1)])


def test_missing_frames_are_noticed(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    path = f"file://{tmp_path}/ids"
    idfiles.write_ids(rows, path, vocabulary("word_bpe_49k.json"), 2)
    assert idfiles.read_ids(spark, path).count() == 40
    next((tmp_path / "ids").glob("part-*.parquet")).unlink()
    with pytest.raises(Exception, match="missing"):
        idfiles.read_ids(spark, path).collect()


def plain_viterbi(text, known, penalty):
    """Best score over any pieces, a character without a piece at the penalty."""
    longest = max(map(len, known))
    best = [0.0] + [None] * len(text)
    for at in range(len(text)):
        for end in range(at + 1, min(len(text), at + longest) + 1):
            step = known.get(text[at:end], penalty if end == at + 1 else None)
            if step is not None and (best[end] is None or best[at] + step > best[end]):
                best[end] = best[at] + step
    return best[-1]


def test_op3_against_a_plain_viterbi(spark, docs):
    table = pieces.read_model(vocabulary("piece_bpe_32k.model"))
    known = {p: s for p, s, kind in table if kind == pieces.NORMAL}
    penalty = min(known.values()) - pieces.UNKNOWN_PENALTY
    unigram, got = pieces.Unigram(table), {r.doc_id: r for r in QUERIES["op3_sentencepiece"](spark, SF).collect()}
    assert sorted(got) == sorted(docs)
    for d, r in got.items():
        text = docs[d]["text"] or ""
        assert r.decoded_sha256 == hashlib.sha256(text.replace(pieces.MARK, " ").encode()).hexdigest() and r.round_trip
        ids = np.frombuffer(unigram.encode(text), "<u4").tolist()
        assert (r.n_tokens, r.ids_crc32) == (len(ids), crc(ids))
        if 0 < len(text) < 1500:
            score = sum(known.get(table[i][0], 0.0) for i in ids)
            raw = b"".join(bytes([int(table[i][0][3:5], 16)]) for i in ids if table[i][2] == pieces.BYTE)
            unknown = sum(1 for b in raw if b & 0xC0 != 0x80)
            assert abs(score + unknown * penalty - plain_viterbi(pieces.MARK + text.replace(" ", pieces.MARK), known, penalty)) < 1e-6 * len(text)


def test_models_that_change_texts_are_refused(tmp_path):
    def model(rules):
        (tmp_path / "m").write_bytes(b"\x1a" + bytes([len(rules)]) + rules)
        return str(tmp_path / "m")

    pieces.check_rules(model(b"\x20\x00"))
    for rules in (b"", b"\x20\x01", b"\x20\x00\x12\x01x", b"\x20\x00\x18\x00"):
        with pytest.raises(ValueError):
            pieces.check_rules(model(rules))
    unigram = pieces.Unigram([("<unk>", 0.0, pieces.UNKNOWN), ("▁", -1.0, pieces.NORMAL), ("a", -2.0, pieces.NORMAL), ("b", -2.0, pieces.NORMAL), ("ab", -2.9, pieces.NORMAL), ("bab", -99.0, pieces.USER_DEFINED)])
    assert np.frombuffer(unigram.encode("abab"), "<u4").tolist() == [1, 2, 5]


def test_op8_recomputed(spark, docs):
    got = QUERIES["op8_hilbert_shards"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        body = (docs[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.curve, r.doc_id) for r in order] == sorted((r.curve, r.doc_id) for r in got)
    assert [r.shard for r in order] == [i * 24 // len(got) for i in range(len(got))]


def test_op8_prunes(spark):
    """A filter on language and source finds its rows in fewer shards than if they lay by chance."""
    sf = SF.replace("0.001", "0.01")
    placed = QUERIES["op8_hilbert_shards"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source"), "doc_id")
    groups = placed.groupBy("lang", "source").agg(F.count_distinct("shard").alias("shards"), F.count(F.lit(1)).alias("n")).collect()
    by_chance = sum(24 * (1 - (23 / 24) ** r.n) for r in groups)
    print(sum(r.shards for r in groups), by_chance)
    assert sum(r.shards for r in groups) < 0.6 * by_chance


def test_shards_keep_clashing_columns(spark):
    rows = spark.createDataFrame([(i, i, 0, "x", 7) for i in range(9)], "curve int, k0 int, shard int, _range string, `a.b` int")
    placed = hilbert.shard_by_curve(rows, {"k": F.col("k0")}, 4, 3, ["k0", "a.b"])
    assert placed.columns == ["curve", "k0", "shard", "_range", "a.b", "curve_", "shard_", "slot"]
    assert sorted((r.k0, r.shard_, r.slot) for r in placed.collect()) == [(i, i // 3, i % 3) for i in range(9)]


def test_op9_against_exact_similarity(spark, docs):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def jaccard(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, SF).collect()}
    errors = []
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        text, other, r = docs[d]["text"] or "", docs[after]["text"] or "", got[d]
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [abs(r.near_edited - jaccard(text, edited)), abs(r.near_next - jaccard(text, other))]
    assert max(errors) < 0.12 and sum(errors) / len(errors) < 0.02
    by_text = {}
    for d in docs:
        assert by_text.setdefault(docs[d]["text"] or "", got[d].fingerprint) == got[d].fingerprint
    assert fingerprint.likeness("", "") == 1.0 and fingerprint.likeness("", got[order[0]].fingerprint) == 0.0


def test_long_and_wide_phrases(spark, monkeypatch):
    """Stretches longer than the bound, and an owner with more different words than its shard's patterns."""
    monkeypatch.setattr(phrases, "STRETCH_WINDOWS", 50)
    monkeypatch.setattr(phrases, "SHARD_PATTERNS", 40)
    base = [f"w{i}" for i in range(400)]
    texts = {1: base, 2: ["x", *base[:300], "y"], 3: [*base[250:], *base[:20]], 4: [f"v{i}" for i in range(30)]}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrases.remove_repeated(rows).collect()}
    assert got == {1: (400, 0), 2: (302, 300), 3: (170, 170), 4: (30, 0)}


def test_rows_of_one_id_with_other_texts_keep_theirs(spark):
    passage = "the same long passage of words that two documents share and that is removed from the later of them both " * 2
    rows = spark.createDataFrame([(1, passage), (2, passage + "a tail"), (2, "zzz " * 80)], "doc_id bigint, text string")
    bytes_ = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.remove_repeated(rows).collect()}
    assert bytes_[(2, 320)] == 0 and bytes_[(2, len(passage) + 6)] >= len(passage) - 1
    words = {(r.doc_id, r.n_words): r.n_removed for r in phrases.remove_repeated(rows).collect()}
    assert words[(2, 80)] == 0 and words[(2, len(passage.split()) + 2)] >= len(passage.split())


def test_warc_export(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "x" * 9000)], "page_id bigint, url string, html string")
    archives = Scratch(spark, "export").write(warc.write_archives(pages, segment_bytes=4096), "archives")
    written = {r.archive: r.bytes for r in warc.export(archives, f"file://{tmp_path}/warc").collect()}
    records = [x for name, size in written.items() for x in warc.parse((tmp_path / "warc" / name).read_bytes())]
    assert {name: (tmp_path / "warc" / name).stat().st_size for name in written} == written
    ids = {h["X-Page-ID"]: h["WARC-Record-ID"] for h, _ in records if h["WARC-Type"] == "response"}
    again = [h for h, _ in records if h["WARC-Type"] == "revisit"]
    assert [(h["X-Page-ID"], h["WARC-Refers-To"], h["X-Payload-Length"]) for h in again] == [("1", ids["2"], "4")]
    assert sum(h["WARC-Type"] == "continuation" for h, _ in records) == 2


def test_components_and_arrays(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (60, 60), (52, 51), (50, 51)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(links, Scratch(spark, "components"), "t").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((50, 51, 52), 50)}
    keys = np.random.default_rng(2).integers(0, 9, 200).astype(np.uint64)
    assert sliding_argmin(keys, 7).tolist() == [i + int(np.argmin(keys[i : i + 7])) for i in range(194)]
    assert [x.tolist() for x in merged(np.array([5, 1, 3, 9]), np.array([7, 3, 4, 9]))] == [[1, 5, 9], [4, 7, 9]]
    import pyarrow as pa

    data, offsets = utf8(pa.array(["a b c d e f g", None, "a b c d e f g h"]))
    keys, firsts = word_keys(data, offsets, 2)
    text, _, place, low, high = of_slice(keys, np.asarray(firsts), 2, 4)
    covered = sorted((t, s) for t, a, b in zip(text.tolist(), low.tolist(), high.tolist(), strict=True) for s in range(a, b + 1))
    assert covered == [(0, s) for s in range(4)] + [(2, s) for s in range(5)] and (place >= low).all() and (place <= low + 3).all()


def test_table_survives_collisions_and_generations(monkeypatch):
    table, rng = Table(64), np.random.default_rng(3)
    low, high = rng.integers(0, 1 << 60, 40).astype(np.uint64), np.zeros(40, dtype=np.uint64)
    for at in (0, 20):
        part = slice(at, at + 20)
        table.add(low[part], high[part], [np.array([i], dtype="<u4").tobytes() for i in range(at, at + 20)])
    found = table.find(low, high)
    assert table.ids[table.begin[found]].tolist() == list(range(40)) and (table.find(low + np.uint64(1), high) < 0).all()
    from tabulark.llm import tokenize

    monkeypatch.setattr(tokenize, "TABLE_SLOTS", 1 << 12)
    monkeypatch.setattr(tokenize, "UNITS_AT_ONCE", 256)
    monkeypatch.setattr(Table.__init__, "__defaults__", (1 << 12,))
    encode, library = Encoder(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    text = " ".join(f"wörd{i % 3000} x{i}'s" for i in range(6000))
    import pyarrow as pa

    assert np.frombuffer(next(encode.batch(pa.array([text]))), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
