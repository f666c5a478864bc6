"""Phrase collocations from exact counts held in weighted acyclic automata.

1. Every task turns runs of text into the automaton of their phrases' counts, cuts it at prefix ranges and packs
   the parts; ranges come from the exact counts of single words, and a word with more than a range's share is
   cut again by the second word.
2. Each range unites its automata, summing weights, a few at a time, and keeps what reaches the least count.
3. The parts of a range's candidates are asked of the ranges that hold them, each part once a range: the asked
   phrases and the counts are walked together. A question says how frequent the most frequent of the candidates is
   that hold the part, which decides whether the part is dropped.
4. Answers come back to the candidates' ranges, where cuts are scored in whole numbers of any size.

Defined results: a null text is empty, a null language is ``und``; documents are taken one by one, so that rows
that repeat count again and ids are not read; a very long text is one run of words, at some 40 bytes a byte;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import with_group_carry
from .countautomata import CountAutomaton
from .scratch import Scratch, parts
from .textarrays import lowered, slices, utf8, word_bounds

CHUNK_WORDS = 1 << 20
MERGE_ARCS = 1 << 20
SLICES = 32

_END = np.zeros(256, dtype=bool)
_END[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_APART = _END.copy()
_APART[[0x20, 9]] = True


def split_words(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Runs of words (binary, A-Z lowered), and for each whether it is the last of its piece."""
    data, offsets = utf8(texts)
    for _, _, part, bounds in slices(data, offsets):
        starts, ends, firsts = word_bounds(part, bounds, _APART)
        if not len(starts):
            continue
        marks = np.r_[0, np.cumsum(_END[part])]
        last = np.ones(len(starts), dtype=bool)
        last[:-1] = marks[starts[1:]] > marks[ends[:-1]]
        last[firsts[1:][firsts[1:] > 0] - 1] = True
        flat = lowered(part)[~_APART[part]]
        at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
        yield pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)]), last


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Words of one language at a time, some CHUNK_WORDS of them where there are so many."""
    held: dict[str, list] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)

    def flush(lang: str) -> tuple[str, pa.Array, np.ndarray]:
        words, ends = zip(*held.pop(lang), strict=True)
        size.pop(lang)
        return lang, pa.concat_arrays(words), np.concatenate(ends)

    for batch in batches:
        langs = batch.column(0)
        for lang in langs.unique().to_pylist():
            texts = batch.column(1).filter(pc.equal(langs, lang))
            for words, ends in split_words(texts):
                held[lang].append((words, ends))
                size[lang] += len(words)
                if size[lang] >= CHUNK_WORDS:
                    yield flush(lang)
        while sum(size.values()) >= 2 * CHUNK_WORDS:
            yield flush(max(size, key=size.get))
    for lang in list(held):
        yield flush(lang)


def _single_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words, _ in _chunks(batches):
        found = words.value_counts()
        name = pa.array([lang] * len(found), pa.string())
        yield pa.RecordBatch.from_pydict({"lang": name, "word": found.field("values").cast(pa.string()), "f": found.field("counts").cast(pa.int64())})


Cuts = dict[str, list[tuple[bytes, bytes]]]


def _shards(batches: Iterator[pa.RecordBatch], cuts: Cuts, depth: int) -> Iterator[pa.RecordBatch]:
    """Packed parts of automata; ``task`` counts the ranges of all languages through, so that tasks get equal shares."""
    begin, at = {}, 0
    for lang in sorted(cuts):
        begin[lang] = at
        at += len(cuts[lang]) + 1
    for lang, words, ends in _chunks(batches):
        made = CountAutomaton.of_words(words, ends, depth)
        for number, part in made.cut(made.bounds(cuts.get(lang, []))):
            task = (begin.get(lang, zlib.crc32(lang.encode())) + number) & 0x7FFFFFFF
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "part": pa.array([number], pa.int32()), "blob": pa.array([part.packed()], pa.binary()), "task": pa.array([task], pa.int32())})


def _united(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One automaton a range; the rows of a range follow one another. What waits is united when it outgrows the sum."""
    key, total, waiting, size = None, None, [], 0

    def unite() -> CountAutomaton:
        return CountAutomaton.union(([total] if total else []) + waiting)

    def done() -> pa.RecordBatch:
        kept = unite().at_least(least)
        return pa.RecordBatch.from_pydict({"lang": pa.array([key[0]]), "part": pa.array([key[1]], pa.int32()), "blob": pa.array([kept.packed()], pa.binary())})

    for batch in batches:
        for lang, number, blob in zip(*(batch.column(c) for c in ("lang", "part", "blob")), strict=True):
            own = (lang.as_py(), number.as_py())
            if own != key:
                if key:
                    yield done()
                key, total, waiting, size = own, None, [], 0
            waiting.append(CountAutomaton.unpacked(blob.as_py()))
            size += waiting[-1].arcs
            if size > max(MERGE_ARCS, total.arcs if total else 0):
                total, waiting, size = unite(), [], 0
    if key:
        yield done()


def prefix_ranges(words: DataFrame, ranges: int) -> Cuts:
    """For each language the sorted first and second words at which its ranges begin, from ``lang, word, f``.

    A range is about one ``ranges``-th of all words. The driver gets the words over which a range ends: at most
    one row a range."""
    total = words.agg(F.sum("f")).first()[0] or 0
    share = max(total // ranges, 1)
    placed = with_group_carry(words, "lang", [F.col("word")], F.col("f"), "before")
    over = placed.where(F.expr(f"before div {share} < (before + f) div {share}")).select("lang", "word", "before", "f").collect()
    by_lang: dict[str, list] = defaultdict(list)
    for row in sorted(over, key=lambda r: (r.lang, r.before)):
        by_lang[row.lang].append((row.word.encode(), row.before, row.f))
    cuts: Cuts = {}
    for lang, rows in by_lang.items():
        # The same words serve as quantiles of the second word, where one first word fills several ranges.
        stops, names, made = [b + f for _, b, f in rows], [w for w, _, _ in rows], []
        for word, before, f in rows:
            for at in range(before // share + 1, (before + f) // share + 1):
                within = (at * share - before) * stops[-1] // f
                # The first cut of a word may lie before it as a whole: its second word is then the empty one.
                second = b"" if at == before // share + 1 and f < 2 * share else names[min(bisect_right(stops, within), len(names) - 1)]
                made.append((word, second))
        cuts[lang] = sorted(set(made))
    return cuts


def _pieces(d: int) -> list[tuple[int, int]]:
    """The proper runs of a phrase of d words that are asked for: its beginnings, its ends, and inner ones of two words or more."""
    return [(i, j) for i in range(d) for j in range(i + 1, d + 1) if j - i < d and (i == 0 or j == d or j - i > 1)]


def _asked(batches: Iterator[pa.RecordBatch], cuts: Cuts, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, number, blob in zip(*(batch.column(c) for c in ("lang", "part", "blob")), strict=True):
            own = CountAutomaton.unpacked(blob.as_py())
            bounds = own.bounds(cuts.get(lang.as_py(), []))
            by_size: dict[int, list] = defaultdict(list)
            for d in range(2, own.depth + 1):
                held = own.weights[d - 1] >= least
                words, count = own.words(d)[held], own.weights[d - 1][held]
                for i, j in _pieces(d):
                    by_size[j - i].append((words[:, i:j], count))
            for size, found in sorted(by_size.items()):
                words, count = np.concatenate([w for w, _ in found]), np.concatenate([c for _, c in found])
                if not len(words):
                    continue
                order = np.lexsort(words.T[::-1])
                words, count = words[order], count[order]
                opens = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(1)])
                top = np.maximum.reduceat(count, opens) if size > 1 else np.zeros(len(opens), dtype=np.int64)
                words = words[opens]
                second = words[:, 1] + 1 if size > 1 else 0
                home = np.searchsorted(bounds, (words[:, 0] << 32) + second, side="right")
                n = len(words)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang.as_py()] * n), "part": pa.array(home, pa.int32()), "phrase": own.phrases(words).cast(pa.string()), "asker": pa.array([number.as_py()] * n, pa.int32()), "top": pa.array(top, pa.int64())})


def _answered(counts: pa.Table, asked: pa.Table) -> pa.Table:
    """``lang, part, phrase, f, top``: to each asker the count of its part; to the home range the largest ``top``."""
    phrases = asked.column("phrase").combine_chunks()
    blobs = counts.column("blob")
    distinct = phrases.unique()
    own = CountAutomaton.unpacked(blobs[0].as_py()).composed(distinct.cast(pa.binary())) if len(blobs) else np.zeros(len(distinct), dtype=np.int64)
    at = pc.index_in(phrases, value_set=distinct).to_numpy(zero_copy_only=False)
    most = np.zeros(len(distinct), dtype=np.int64)
    np.maximum.at(most, at, asked.column("top").to_numpy())
    told = np.flatnonzero(most)
    lang, home = asked.column("lang")[0], asked.column("part")[0]
    n = len(told)
    columns = {
        "lang": pa.chunked_array([pa.array([lang.as_py()] * (len(phrases) + n), pa.string())]),
        "part": pa.concat_arrays([asked.column("asker").combine_chunks(), pa.array([home.as_py()] * n, pa.int32())]),
        "phrase": pa.concat_arrays([phrases, distinct.take(pa.array(told))]),
        "f": np.r_[own[at], np.zeros(n, dtype=np.int64)],
        "top": np.r_[np.zeros(len(phrases), dtype=np.int64), most[told]],
    }
    return pa.table(columns)


def scores(a: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    """``floor(1000000 * a * a / (l * r))``, exact: in 64 bits where products fit, else in whole numbers of any size."""
    top = lambda x: int(x.max(initial=0))
    if 1_000_000 * top(a) ** 2 < 1 << 62 and top(l) * top(r) < 1 << 62:
        return 1_000_000 * a * a // (l * r)
    a, l, r = (x.astype(object) for x in (a, l, r))  # noqa: E741
    return (1_000_000 * a * a // (l * r)).astype(np.int64)


def _scored(counts: pa.Table, answers: pa.Table, least: int, cover: int, schema: pa.Schema) -> pa.Table:
    found = []
    if len(counts) and len(answers):
        own = CountAutomaton.unpacked(counts.column("blob")[0].as_py())
        f, top = answers.column("f").to_numpy(), answers.column("top").to_numpy()
        phrase = answers.column("phrase").combine_chunks().cast(pa.binary())
        counted, told = np.flatnonzero(f), np.flatnonzero(top)
        names, inside = phrase.take(pa.array(counted)), phrase.take(pa.array(told))
        for d in range(2, own.depth + 1):
            held = own.weights[d - 1] >= least
            words, a = own.words(d)[held], own.weights[d - 1][held]
            if not len(a):
                continue
            of = lambda w: f[counted[pc.index_in(own.phrases(w), value_set=names).to_numpy(zero_copy_only=False)]]
            left = np.stack([of(words[:, :k]) for k in range(1, d)])
            right = np.stack([of(words[:, k:]) for k in range(1, d)])
            score = np.stack([scores(a, x, y) for x, y in zip(left, right, strict=True)])
            best, each = score.argmin(0), np.arange(len(a))
            name = own.phrases(words)
            at = pc.index_in(name, value_set=inside).fill_null(-1).to_numpy(zero_copy_only=False)
            longer = np.where(at >= 0, np.r_[top[told], 0][at], 0)
            keep = 100 * longer < cover * a
            lang = pa.array([answers.column("lang")[0].as_py()] * int(keep.sum()), pa.string())
            found.append(pa.table([lang, name.filter(pa.array(keep)).cast(pa.string()), *(pa.array(x[keep]) for x in (a, left[best, each], right[best, each], score[best, each]))], schema=schema))
    return pa.concat_tables(found) if found else schema.empty_table()


def mine(docs: DataFrame, text: str = "text", lang: str | Column = "lang", most_words: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``most_words`` words.

    ``a`` is at least ``least``; a phrase is dropped if it lies in a longer candidate with ``cover`` percent of its
    count or more."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "collocations")
    own = F.col(lang) if isinstance(lang, str) else lang
    texts = docs.select(F.coalesce(own.cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    words = texts.mapInArrow(_single_words, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = scratch.write(words, "words")
    sizes = scratch.write(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    cuts = prefix_ranges(words, parts(spark))
    kind = "lang string, part int, blob binary"
    shards = texts.mapInArrow(lambda it: _shards(it, cuts, most_words), f"{kind}, task int")
    dealt = shards.repartitionById(parts(spark), F.col("task")).drop("task").sortWithinPartitions("lang", "part")
    counts = scratch.write(dealt.mapInArrow(lambda it: _united(it, least), kind), "counts", drop=("words",))
    asked = scratch.write(counts.mapInArrow(lambda it: _asked(it, cuts, least), "lang string, part int, phrase string, asker int, top bigint"), "asked")
    by = lambda df: df.groupBy("lang", "part")
    answers = by(counts).cogroup(by(asked)).applyInArrow(lambda c, a: _answered(c, a) if len(a) else _NO_ANSWERS.empty_table(), "lang string, part int, phrase string, f bigint, top bigint")
    answers = scratch.write(answers, "answers", drop=("asked",))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *((c, pa.int64()) for c in ("a", "l", "r", "score"))])
    scored = by(counts).cogroup(by(answers)).applyInArrow(lambda c, a: _scored(c, a, least, cover, schema), "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")
    # First in slices of each language, so that the last ranking sees at most SLICES times ``top`` rows of it.
    order, first = (F.desc("score"), F.desc("a"), "phrase"), scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    for by_columns in (["lang", "slice"], ["lang"]):
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*by_columns).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_NO_ANSWERS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("top", pa.int64())])
