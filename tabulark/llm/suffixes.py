"""Suffix-array deduplication by bucket-pointer refinement, sharded over contexts of recurring anchors.

1. Every ``width``-byte string has an anchor (:mod:`anchors`); strings whose anchor occurs once are unique.
   An anchor's context is the stretch of bytes that holds all the strings it anchors there. Whole copies of
   a smaller document are found by their texts' hashes and set aside.
2. Contexts are sharded by anchor. The bytes of equal contexts are held once, with the places that have them.
   In a shard the suffixes are put in buckets by q-gram, and buckets that hold several are refined by sorting on
   the bucket identifiers of later offsets: 2q bytes from the buckets q further on, 4q from those of 2q, and at
   last ``width`` from two overlapping buckets. Each step reuses the identifiers of the one before; a suffix alone
   in its bucket keeps its own. Suffixes in one bucket then agree in ``width`` bytes; every place of a bucket but
   its earliest is a repeat.
3. Where an anchor's places are more than a shard may hold, equal contexts' places are dealt in slices, each with
   the bytes and the earliest place, and refined there.
4. An anchor with more different contexts than a shard may hold gets several shards: its strings are parted by
   where in them the anchor lies, and each part goes on, from step 2, by the bytes around the anchor that all
   its strings hold. At every turn the parts halve, so that an anchor is at last known by whole strings.

Defined results: a null or empty text has no bytes and loses none; a null doc_id is compared with
nothing and keeps its bytes; rows that share a doc_id are one document for the search, with the
smallest of their texts, and those with another text keep theirs; a very long text is hashed whole, at some 40
bytes a byte, and refined by its contexts; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import by_document, byte_keys, keyed_documents, merged, numbers, search, whole_spans, with_spans
from .countautomata import runs
from .scratch import Scratch, fresh
from .textarrays import mix, prefix_hash

GRAM = 32
SHARD_CONTEXTS = 8_000
# So many shards to that number of contexts: most hold an eighth of it, one with a frequent anchor little over it.
SHARDS_PER_BOUND = 8
#: Places beside the first that equal contexts of one anchor may have within its shard; also a slice's size.
SHARD_PLACES = 8_192

_CONTEXT = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("p", pa.int32()), ("context", pa.binary())])


def _contexts(docs: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """``h, doc_id, lo, p, context``: the bytes from the first string (at ``lo``) of a recurring anchor (at ``p``)
    to the end of its last."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (h, p, lo, hi) = numbers(batch.column(2))
            ids = batch.column(0).to_pylist()
            for first in range(0, len(ids), 64):
                end = min(first + 64, len(ids))
                pieces, counts = [], []
                for row in range(first, end):
                    body = batch.column(1)[row].as_py().encode()
                    x, y = lo[bounds[row] : bounds[row + 1]].tolist(), hi[bounds[row] : bounds[row + 1]].tolist()
                    pieces += [body[a : b + width] for a, b in zip(x, y, strict=True)]
                    counts.append(len(x))
                part = slice(bounds[first], bounds[end])
                columns = [pa.array(h[part], pa.int64()), pa.array(np.repeat(np.array(ids[first:end], dtype=np.int64), counts)), pa.array(lo[part], pa.int32()), pa.array(p[part], pa.int32()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_CONTEXT)

    return docs.join(hits, "doc_id").select("doc_id", "text", "a").mapInArrow(tasks, "h bigint, doc_id bigint, lo int, p int, context binary")


def _dense(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers: the rank of each key, in 32 bits, as a shard's positions are far fewer."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.zeros(len(keys), dtype=np.int32)
    rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1], dtype=np.int32)
    return rank


def refined_buckets(data: np.ndarray, offsets: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``width`` bytes of one text start, and their buckets: equal if the bytes are.

    ``data`` is the texts' bytes and ``offsets`` their n + 1 bounds."""
    reach = gram
    if len(data) < gram:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    # How far each position's text goes on.
    room = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets)) - np.arange(len(data), dtype=np.int32)
    bucket = np.full(len(data), -1, dtype=np.int32)
    at = np.flatnonzero(room >= gram)
    sums, inverse = prefix_hash(data)
    grams = mix((sums[at + gram] - sums[at]) * inverse[at])
    del sums, inverse
    bucket[at] = _dense(grams)
    del grams
    used = int(bucket.max()) + 1
    while reach < width:
        step = min(reach, width - reach)
        at = np.flatnonzero(room >= reach + step)
        own = bucket[at]
        # Only the buckets that hold several suffixes are refined; the others are known by one already.
        several = np.bincount(own, minlength=used)[own] > 1
        later = at[several]
        ranks = used + _dense(own[several].astype(np.int64) * used + bucket[later + step]) if len(later) else later
        bucket[room < reach + step] = -1
        bucket[later] = ranks
        used = int(ranks.max()) + 1 if len(later) else used
        reach += step
    at = np.flatnonzero(room >= width)
    return at, bucket[at]


def _refine(width: int):
    """Spans of repeats among contexts: rows with bytes, and places (no bytes) of the context with the same keys."""

    def refine(table: pa.Table) -> pa.Table:
        # In the order of their places: a document's contexts hold different strings, so their suffixes are in order too.
        table = table.sort_by([("doc_id", "ascending"), ("lo", "ascending")])
        texts, keys = table.column("context"), [table.column(k).to_numpy() for k in ("h", "k1", "k2")]
        doc_id, lo = table.column("doc_id").to_numpy(), table.column("lo").to_numpy().astype(np.int64)
        held = np.flatnonzero(texts.is_valid().to_numpy())
        contexts = texts.take(pa.array(held)).to_pylist()
        data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        at, bucket = refined_buckets(data, offsets, width)
        # Every place of a context has its suffixes, in the buckets of its bytes.
        _, group = np.unique(np.stack(keys, axis=1), axis=0, return_inverse=True)
        own = np.empty(int(group.max()) + 1, dtype=np.int64)
        own[group[held]] = np.arange(len(held))
        first, last = np.searchsorted(at, offsets[:-1]), np.searchsorted(at, offsets[1:])
        of = own[group]
        size = last[of] - first[of]
        suffix = runs(first[of], size)
        bucket = bucket[suffix]
        # All but the earliest suffix of a bucket repeat; of several assignments to one entry the last stays.
        places = np.arange(len(bucket))
        earliest = np.empty(int(bucket.max(initial=-1)) + 1, dtype=np.int64)
        earliest[bucket[::-1]] = places[::-1]
        again = np.flatnonzero(earliest[bucket] != places)
        row = np.repeat(np.arange(len(size)), size)[again]
        doc, start = doc_id[row], (lo - offsets[of])[row] + at[suffix[again]]
        opens = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.zeros(0, dtype=bool)
        closes = np.concatenate([opens[1:], [True]]) if len(doc) else opens
        return pa.table({"doc_id": pa.array(doc[opens], pa.int64()), "a": pa.array(start[opens].astype(np.int32)), "b": pa.array((start[closes] + width).astype(np.int32))})

    return refine


def _parted(contexts: DataFrame, width: int, turn: int) -> DataFrame:
    """Contexts ``h, doc_id, lo, p, context`` cut by where in their strings the anchor lies, in ``2**turn`` parts; the
    new ``h`` stands for the old one, the part, and the bytes around the anchor that all the part's strings hold."""
    places, count = width - GRAM + 1, 1 << turn
    ranges = [(-(-k * places // count), -(-(k + 1) * places // count) - 1) for k in range(count)]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, doc_id, lo, p, context in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                last = lo + len(context) - width
                for k, (near, far) in enumerate(ranges):
                    a, b = max(lo, p - far), min(last, p - near)
                    if near <= far and a <= b:
                        rows.append((h, k, context[p - near - lo : p - far + width - lo], doc_id, a, p, context[a - lo : b - lo + width]))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "part", "core", "doc_id", "lo", "p", "context"])

    rows = contexts.select("h", "doc_id", "lo", "p", "context").mapInArrow(tasks, "h bigint, part int, core binary, doc_id bigint, lo int, p int, context binary")
    return rows.select(F.xxhash64("h", F.lit(turn), "part", "core").alias("h"), "doc_id", "lo", "p", "context")


def repeated_spans(df: DataFrame, width: int = 100, text: str = "text", doc_id: str = "doc_id", shard_contexts: int = SHARD_CONTEXTS, shard_places: int = SHARD_PLACES) -> DataFrame:
    """``doc_id, spans, t``: the byte intervals ``[a, b)`` covered by strings that also start earlier; see
    ``keyed_documents`` for ``t``."""
    scratch = Scratch(df.sparkSession, "suffixes")
    docs, shared = keyed_documents(df, text, doc_id)
    hits, copied = search(docs, byte_keys, GRAM, width, False, scratch)
    keys = [F.xxhash64("context").alias("k1"), F.xxhash64(F.lit(1), "context").alias("k2")]
    place = F.struct("doc_id", "lo", "p")
    spans, turn, used = whole_spans(copied), 0, ["hits"]
    contexts = _contexts(docs, hits, width)
    while True:
        name = f"contexts-{turn}"
        contexts = scratch.write(contexts.select("h", "doc_id", "lo", "p", "context", *keys), name, drop=tuple(used) if not turn else ())
        firsts = contexts.groupBy("h", "k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("context", place).alias("context"))
        firsts = scratch.write(firsts, f"firsts-{turn}")
        several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("places")).where("places > 1")
        several = scratch.write(several, f"several-{turn}")
        left = firsts.join(several, "h").select("h", "k1", "k2", "first", "n", "context", "different", "places")
        left = scratch.write(left, f"left-{turn}", drop=(f"firsts-{turn}", f"several-{turn}"))
        # The other places of equal contexts, without bytes.
        met = contexts.join(left.where("n > 1").select("h", "k1", "k2", "first", "n", "different", "places"), ["h", "k1", "k2"]).where(place != F.col("first"))
        others = scratch.write(met.select("h", "k1", "k2", "doc_id", "lo", "n", "different", "places"), f"others-{turn}", drop=(name,))

        narrow, near = F.col("different") <= shard_contexts, F.col("places") - F.col("different") <= shard_places
        shards = max(1, math.ceil(SHARDS_PER_BOUND * left.count() / shard_contexts), math.ceil(SHARDS_PER_BOUND * others.count() / shard_places))
        shard, whole = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("bigint"), F.lit(0)
        held = left.select("h", "k1", "k2", F.col("first.doc_id").alias("doc_id"), F.col("first.lo").alias("lo"), "context", "n", "different", "places")
        # Slices of the places that an anchor's shard cannot hold: each gets the bytes and the first place.
        slices = F.floor(F.col("n") / shard_places).cast("int")
        far = ~(narrow & near)
        apart, none = F.xxhash64("h", "k1", "k2"), F.lit(None).cast("binary")
        fields = ("h", "k1", "k2", "doc_id", "lo")
        rows = held.where(narrow & (near | (F.col("different") > 1))).select(shard.alias("shard"), F.lit(-1).alias("slice"), *fields, "context")
        rows = rows.unionByName(others.where(narrow & near).select(shard.alias("shard"), F.lit(-1).alias("slice"), *fields, none.alias("context")))
        rows = rows.unionByName(held.where(far & (F.col("n") > 1)).select(apart.alias("shard"), F.explode(F.sequence(whole, slices)).alias("slice"), *fields, "context"))
        rows = rows.unionByName(others.where(far).select(apart.alias("shard"), F.pmod(F.xxhash64("doc_id", "lo"), slices + 1).cast("int").alias("slice"), *fields, none.alias("context")))
        refined = rows.groupBy("shard", "slice").applyInArrow(_refine(width), "doc_id bigint, a int, b int")
        spans = spans.unionByName(refined)
        used = [*used, f"others-{turn}", f"left-{turn}"]
        hot = left.where(~narrow).select("h", "first.doc_id", "first.lo", "first.p", "context")
        if hot.isEmpty():
            break
        turn += 1
        contexts = _parted(hot, width, turn)
    return scratch.write(by_document(spans, shared), "spans", drop=("copies", *used[1:]))


def _whole_characters(body: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of an interval that holds whole characters."""
    while a < b and body[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeated(df: DataFrame, width: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) of every row."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for value, a, b in zip(texts, begins, ends, strict=True):
            body = (value or "").encode()
            if a is None or not len(a):
                rows.append((len(body), 0, 0, body))
                continue
            a, b = merged(np.asarray(a), np.minimum(np.asarray(b), len(body)))
            kept = b"".join(body[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(body)], strict=True))
            rows.append((len(body), len(body) - len(kept), len(a), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    read = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    joined, spans = with_spans(read, repeated_spans(df, width, text, doc_id), "doc_id", "text")
    return joined.select("doc_id", cut("text", F.col(f"{spans}.a"), F.col(f"{spans}.b")).alias("x")).select("doc_id", "x.*")


def without_repeated(df: DataFrame, width: int = 100, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with repeated passages cut from its texts (a character goes only if all its bytes do) and, where
    there is such a column, their new lengths. A null text stays null; a text may become empty."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        kept = []
        for value, a, b in zip(texts, begins, ends, strict=True):
            if value is not None and a is not None and len(a):
                body = value.encode()
                spans = [_whole_characters(body, x, y) for x, y in zip(*(m.tolist() for m in merged(np.asarray(a), np.minimum(np.asarray(b), len(body)))), strict=True)]
                value = b"".join(body[x:y] for x, y in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(body)], strict=True)).decode()
            kept.append(value)
        return pd.Series(kept, dtype=object)

    joined, spans = with_spans(df, repeated_spans(df, width, text, doc_id), doc_id, text)
    name = fresh(joined, "_cut")
    made = joined.withColumn(name, cut(F.col(f"`{text}`"), F.col(f"{spans}.a"), F.col(f"{spans}.b")))
    out = {text: F.col(name)} | ({n_chars: F.length(name).cast(df.schema[n_chars].dataType)} if n_chars in df.columns else {})
    return made.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
