"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into tokens, runs of letters and digits or of other visible characters. Hashed into one table of
weights are its single tokens and pairs (A-Z lowered), and runs of three token shapes: how a word is written, which
signs a run of signs is, and whether a token repeats one of the two before it. Each family's values are square
roots of shares, so each has length 1 whatever the length of the text, and a score is a sparse dot product.

Training takes labelled rows that ``usable`` admits: the ``most`` smallest by a hash of their key, a documented
bound; they are hashed where they lie, and one task takes them in that order, one at a time, with a step and a
penalty for each weight. The model (its weights that are not 0, at most ``2**BITS``) goes to all tasks, and every
row is scored.

Defined results: a null or empty text has only the intercept; a very long text is hashed whole, at some 40 bytes a
byte; repeated rows score alike; labelled rows without a document, with a null label or a null key are not used, and
of documents that share a key the smallest text is; without usable rows every score is 0.5; a null key is not
held out; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textarrays import gram_hashes, list_array, lowered, mix, prefix_hash, slices, utf8

BITS = 20
#: Labelled rows that train, at most.
SAMPLE = 10_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.1

_U = np.uint64
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_UPPER, _DIGIT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash and a shape of every token, and the first token of every text (n + 1 entries)."""
    kind = _KIND[data]
    edge = np.ones(len(data), dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    opens = np.flatnonzero(edge)
    stops = np.r_[opens[1:], len(data)]
    solid = kind[opens] > 0
    opens, stops = opens[solid], stops[solid]
    sums, inverse = prefix_hash(lowered(data))
    size = (stops - opens).astype(_U)
    word = mix((sums[stops] - sums[opens]) * inverse[opens] + size)
    share = lambda mask: np.r_[0, np.cumsum(mask[data])]
    upper, digit = share(_UPPER), share(_DIGIT)
    capitals, digits = upper[stops] - upper[opens], digit[stops] - digit[opens]
    written = np.where(digits == stops - opens, 3, np.where((capitals == stops - opens) & (capitals > 1), 2, np.where(capitals > 0, 1, 0))).astype(_U)
    shape = np.where(kind[opens] == 2, word, mix(written + _U(1)))
    return word, shape, np.searchsorted(opens, offsets)


def _values(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(buckets, return_counts=True)
    return index, np.sqrt(count / len(buckets)).astype(np.float32)


def _bucket(grams: np.ndarray, family: int) -> np.ndarray:
    """Entries of the table of weights; entry 0 is the intercept's."""
    return (1 + mix(grams + _U(family)) % _U((1 << BITS) - 1)).astype(np.int64)


def vectors(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the entries and values of its sparse vector."""
    data, offsets = utf8(texts)
    for first, end, part, bounds in slices(data, offsets):
        words, shapes, firsts = _tokens(part, bounds)
        again = np.zeros(len(words), dtype=_U)
        for lag in (1, 2):
            again[lag:] |= (words[lag:] == words[:-lag]).astype(_U) << _U(lag - 1)
        shapes = mix(shapes + again)
        for row in range(end - first):
            a, b = firsts[row], firsts[row + 1]
            families = (words[a:b], gram_hashes(words[a:b], 2), gram_hashes(shapes[a:b], min(3, int(b - a))) if b > a else words[:0])
            made = [(np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.float32))]
            made += [_values(_bucket(g, k)) for k, g in enumerate(families) if len(g)]
            yield np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with squared and absolute penalties."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> float:
        """One step; returns the probability from before it. Entries of ``at`` may repeat."""
        if len(np.unique(at)) < len(at):
            at, place = np.unique(at, return_inverse=True)
            value = np.bincount(place, value)
        w = self.weights(at)
        p = sigmoid(float(w @ value))
        g = (p - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


Model = tuple[np.ndarray, np.ndarray]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            made = list(vectors(piece.column("text")))
            size = np.array([len(i) for i, _ in made])
            entries = pa.array(np.concatenate([i for i, _ in made]).astype(np.int32))
            values = pa.array(np.concatenate([v for _, v in made]))
            yield pa.RecordBatch.from_arrays([piece.column("place"), piece.column("label"), list_array(entries, size), list_array(values, size)], ["place", "label", "entries", "values"])


def _trained(batches: Iterator[pa.RecordBatch], settings: dict[str, float]) -> Iterator[pa.RecordBatch]:
    model, rows = Ftrl(1 << BITS, **settings), 0
    for batch in batches:
        entries, values = batch.column("entries"), batch.column("values")
        for row, label in enumerate(batch.column("label").to_pylist()):
            model.learn(entries[row].values.to_numpy().astype(np.int64), values[row].values.to_numpy().astype(np.float64), float(label))
            rows += 1
    weights = model.weights().astype(np.float32)
    used = np.flatnonzero(weights)
    if rows:
        yield pa.RecordBatch.from_pydict({"entries": pa.array([used.astype("<i4").tobytes()], pa.binary()), "weights": pa.array([weights[used].astype("<f4").tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE, **settings: float) -> Model:
    """Entries and weights of a model from the rows of ``labels`` (``key``, ``label`` 0 or 1) that are ``usable``."""
    scratch = Scratch(docs.sparkSession, "classifier")
    named = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & usable)
    place = F.md5(F.col(key).cast("string"))
    sample = scratch.write(named.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), place.alias("place")).orderBy("place", "label").limit(most), "sample")
    # The sample has at most ``most`` rows.
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample.select("key").distinct()), "key")
    texts = found.groupBy("key").agg(F.min("text").alias("text")).join(F.broadcast(sample), "key")
    made = texts.select("place", "label", "text").mapInArrow(_hashed, "place string, label int, entries array<int>, values array<float>")
    ready = scratch.write(made, "vectors").repartition(1).sortWithinPartitions("place", "label")
    row = ready.mapInArrow(lambda it: _trained(it, settings), "entries binary, weights binary").first()
    if row is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.frombuffer(row.entries, "<i4").astype(np.int64), np.frombuffer(row.weights, "<f4").astype(np.float64)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    weights = np.zeros(1 << BITS)
    weights[model[0]] = model[1]
    for batch in batches:
        found = np.array([weights[entries] @ values for entries, values in vectors(batch.column(1))], dtype=np.float64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(found))], ["key", "score"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row: the probability of label 1."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _scores(it, model), f"key {kind}, score double").withColumnRenamed("key", key)
