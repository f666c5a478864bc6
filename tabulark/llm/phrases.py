"""Substring deduplication by repeated-phrase automata.

1. Word windows that may recur are found through their anchors (:mod:`anchors`); the stretches of text
   that hold them are written once. Whole copies of a smaller document are found by their texts' hashes
   and set aside.
2. Passages are confirmed: a window that starts in several documents belongs to the smallest one, and there
   to its first stretch.
3. Confirmed windows are compiled into Aho-Corasick automata, one per shard of owning stretches; every
   stretch that may hold one of a shard's windows is streamed through the shard's automaton, which
   locates each occurrence, word for word. A shard that many stretches visit is served by several tasks.
4. Words covered by a window that belongs to a smaller document are removed.

Defined results: a null or empty text has no words and loses none; a null doc_id is compared with
nothing and keeps its words; rows that share a doc_id are one document for the search, with the
smallest of their texts, and those with another text keep theirs; a very long text is hashed whole, at some 40 bytes
a byte, and scanned in stretches of at most ``STRETCH_WINDOWS`` windows; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import by_document, keyed_documents, merged, numbers, search, whole_spans, with_spans, word_keys
from .scratch import Scratch
from .textarrays import gram_hashes, list_array, slices, utf8, word_hashes

GRAM = 5
SHARD_PATTERNS = 20_000
SHARD_STRETCHES = 2_000
# A stretch has at most so many windows; a longer one is cut in several that overlap.
STRETCH_WINDOWS = 8_192

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _stretches(docs: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """``doc_id, start`` (word), ``words`` (joined by spaces) of every run of windows that may recur."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (_, _, lo, hi) = numbers(batch.column(2))
            ids, starts, texts = [], [], []
            for row, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words = _WORD.findall(text.as_py())
                a, b = merged(lo[bounds[row] : bounds[row + 1]], hi[bounds[row] : bounds[row + 1]] + 1)
                for x, y in ((z, min(z + STRETCH_WINDOWS, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True) for z in range(x, y, STRETCH_WINDOWS)):
                    ids.append(key)
                    starts.append(x)
                    texts.append(" ".join(words[x : y + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "start", "words"])

    return docs.join(hits, "doc_id").select("doc_id", "text", "a").mapInArrow(tasks, "doc_id bigint, start int, words string")


def _windows(stretches: DataFrame, width: int) -> DataFrame:
    """``doc_id, start, windows`` (the hash of every window) of each stretch."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for first, end, part, bounds in slices(data, offsets):
                words, firsts = word_hashes(part, bounds)
                grams = gram_hashes(words, width)
                inside = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(firsts[:-1], firsts[1:], strict=True)])
                counts = np.maximum(np.diff(firsts) - width + 1, 0)
                lists = list_array(pa.array(grams[inside].view(np.int64)), counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), lists], names=["doc_id", "start", "windows"])

    return stretches.mapInArrow(tasks, "doc_id bigint, start int, windows array<bigint>")


class Automaton:
    """Patterns of words as strings of one character per word; words of no pattern share one character."""

    def __init__(self, width: int):
        self.width, self.codes = width, {}
        self.automaton = ahocorasick.Automaton()

    def add(self, words: list[str], chosen: np.ndarray, owner: int) -> None:
        codes = self.codes
        begins, ends = merged(chosen, chosen + self.width)
        for w in [w for x, y in zip(begins.tolist(), ends.tolist(), strict=True) for w in words[x:y]]:
            if w not in codes:
                code = 2 + len(codes)
                codes[w] = chr(code if code < 0xD800 else code + 0x800)  # characters that are no surrogates
        text = "".join([codes.get(w, "\x01") for w in words])
        for at in chosen.tolist():
            self.automaton.add_word(text[at : at + self.width], owner)

    def occurrences(self, words: list[str], document: int) -> list[int]:
        """Where windows of smaller documents start."""
        text = "".join([self.codes.get(w, "\x01") for w in words])
        return [end - self.width + 1 for end, owner in self.automaton.iter(text) if owner < document]


def _scan(width: int):
    def scan(key: tuple, table: pa.Table) -> pa.Table:
        ids, starts, owned = (table.column(c).to_pylist() for c in ("doc_id", "start", "owned"))
        texts = table.column("words").to_pylist()
        found = Automaton(width)
        patterns = 0
        for i, hashes in enumerate(owned):
            if hashes:
                words = texts[i].split(" ")
                data = np.frombuffer(texts[i].encode(), dtype=np.uint8)
                grams = gram_hashes(word_hashes(data, np.array([0, len(data)]))[0], width).view(np.int64)
                chosen = np.flatnonzero(np.isin(grams, np.array(hashes, dtype=np.int64)))
                found.add(words, chosen, ids[i])
                patterns += len(chosen)
        out: list[tuple] = []
        if patterns:
            found.automaton.make_automaton()
            for i, hashes in enumerate(owned):
                if not hashes:
                    at = np.array(found.occurrences(texts[i].split(" "), ids[i]), dtype=np.int64)
                    a, b = merged(at + starts[i], at + starts[i] + width)
                    out.extend((ids[i], x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "a": pa.array(columns[1], pa.int32()), "b": pa.array(columns[2], pa.int32())})

    return scan


def repeated_spans(df: DataFrame, width: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, spans, t``: the word intervals ``[a, b)`` that windows of smaller documents cover; see
    ``keyed_documents`` for ``t``."""
    scratch = Scratch(df.sparkSession, "phrases")
    docs, shared = keyed_documents(df, text, doc_id)
    hits, copied = search(docs, word_keys, GRAM, width, True, scratch)
    stretches = scratch.write(_stretches(docs, hits, width), "stretches", drop=("hits",))

    windows = _windows(stretches, width).select("doc_id", "start", F.explode("windows").alias("w"))
    owners = windows.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("o"), F.max("doc_id").alias("last")).where("o.doc_id < last")
    owners = scratch.write(owners.select("w", F.col("o.doc_id").alias("owner"), F.col("o.start").alias("owner_start")), "owners")
    # A stretch and an owning one: the owner's own windows to compile, or a visit of another document.
    mine = F.when(F.col("doc_id") == F.col("owner"), F.col("w"))
    met = windows.join(owners, "w").where("doc_id <> owner or start = owner_start")
    visits = met.groupBy("doc_id", "start", "owner", "owner_start").agg(F.collect_set(mine).alias("owned"))
    visits = scratch.write(visits, "visits", drop=("owners",))

    patterns = visits.agg(F.sum(F.size("owned"))).first()[0] or 0
    shards = max(1, math.ceil(patterns / SHARD_PATTERNS))
    sharded = visits.withColumn("shard", F.pmod(F.xxhash64("owner", "owner_start"), F.lit(shards))).groupBy("shard", "doc_id", "start", (F.size("owned") > 0).alias("is_owner"))
    sharded = sharded.agg(F.array_distinct(F.flatten(F.collect_list("owned"))).alias("owned"))
    load = sharded.where("not is_owner").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_STRETCHES).cast("int").alias("tasks"))
    both = sharded.join(load, "shard")
    one = F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("tasks")).cast("int"))
    dealt = both.withColumn("task", F.explode(F.when(F.col("is_owner"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(one)))
    with_text = dealt.join(stretches, ["doc_id", "start"]).select("shard", "task", "doc_id", "start", "owned", "words")
    located = with_text.groupBy("shard", "task").applyInArrow(_scan(width), "doc_id bigint, a int, b int")
    located = located.unionByName(whole_spans(copied))
    return scratch.write(by_document(located, shared), "spans", drop=("visits", "stretches"))


def remove_repeated(df: DataFrame, width: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` (the words kept, joined by one space) of every row."""

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for value, a, b in zip(texts, begins, ends, strict=True):
            words = _WORD.findall(value or "")
            total = len(words)
            if a is not None and len(a):
                keep = np.ones(total, dtype=bool)
                for x, y in zip(*merged(np.asarray(a), np.asarray(b)), strict=True):
                    keep[x:y] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            rows.append((total, total - len(words), " ".join(words)))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    read = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    joined, spans = with_spans(read, repeated_spans(df, width, text, doc_id), "doc_id", "text")
    return joined.select("doc_id", cut("text", F.col(f"{spans}.a"), F.col(f"{spans}.b")).alias("x")).select("doc_id", "x.*")
