"""Vector code compression: product codes whose codebooks come from cover-tree Lloyd rounds.

A vector becomes whole numbers and is cut into equal parts; each part position has a codebook. Every task
builds a cover tree over the parts of a chunk of vectors, for all positions at once, and writes it with the
chunk. A node knows its centre, a radius that covers everything below it, and the count and sum of what lies
below. A Lloyd round walks the trees from their roots: where the nearest codebook entry is nearer than the
second nearest by more than twice the radius, the triangle inequality gives the whole subtree to it, and its
count and sum are added in one step; only ambiguous nodes are descended, down to exact comparisons of single
parts. Equal parts gather below a node of radius 0, which is always decided as a whole.

What moves is one count and sum for each codebook entry and task; codebooks are bounded by their parameters.

Defined results: a row whose vector is null or holds a null, NaN or infinite component is left out; a vector
shorter than the longest one, or than a multiple of the number of parts, counts as filled up with zeros; with
fewer kept rows than entries the codebook is shorter; a null id orders last when codebooks begin, rows that share
an id order by their vectors, and repeated rows are coded each; ties go to the smaller index; an empty table gives
an empty table; other columns are not read. Components whose number has more than 28 bits are an error, because
sums of them would no longer be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import Scratch

SCALE = 256
CHUNK = 4096
LEAF = 8
MOST = 1 << 28

_BLOBS = ("center", "radius", "count", "total", "first", "children", "begin", "rows", "points")


def kept(rows: DataFrame, vector: str) -> Column:
    """Whether the vector is there and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & fine


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """``floor(256 * x)``, exact in double precision."""
    made = np.floor(flat.astype(np.float64) * SCALE)
    if len(made) and np.abs(made).max() >= MOST:
        raise ValueError(f"a component of {np.abs(made).max() / SCALE} is too large for exact sums")
    return made.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of whole numbers, filled up with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = whole_numbers(column.flatten().to_numpy(zero_copy_only=False))
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    made = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    made[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return made


class CoverTree:
    """Nested covers of many points in several independent groups (one root each).

    A level halves the covering radius: a node keeps its centre as its own first child, and points of it that no
    child covers yet become centres of further children, so that siblings' centres are farther apart than the
    radius that they cover. A node of at most ``LEAF`` points, or of equal ones, is not cut further. Nodes of all
    groups are cut side by side. ``first`` is the place of a node's first child (-1: none), ``children`` their
    number; ``rows`` lists the points so that those below a node are ``count`` entries from ``begin`` on."""

    def __init__(self, center, radius, count, total, first, children, rows, begin):
        self.center, self.radius, self.count, self.total = center, radius, count, total
        self.first, self.children, self.rows, self.begin = first, children, rows, begin

    @classmethod
    def build(cls, points: np.ndarray, groups: int) -> CoverTree:
        """A tree over ``points``, whose groups are equal consecutive runs."""
        n = len(points) // groups
        rows = np.arange(groups * n)
        begin, size = np.arange(groups) * n, np.full(groups, n)
        seed = points[begin]
        levels = []
        while len(begin):
            # The points of the level's nodes lie in runs; what a node covers is known from its farthest point.
            node = np.repeat(np.arange(len(begin)), size)
            own = rows[_runs(begin, size)]
            gap = points[own] - seed[node]
            d2 = (gap * gap).sum(1)
            edge = np.cumsum(size) - size
            far = np.maximum.reduceat(d2, edge)
            total = np.add.reduceat(points[own], edge, axis=0)
            cut = (size > LEAF) & (far > 0)
            levels.append([seed, far, size, total, begin, cut, None])
            if not cut.any():
                break
            take = cut[node]
            own, node, d2 = own[take], node[take], d2[take]
            limit = far / 4.0
            child = np.full(len(own), -1)
            near = d2 <= limit[node]
            owner = np.flatnonzero(cut)
            number = np.full(len(begin), -1)
            number[owner] = np.arange(len(owner))
            child[near] = number[node[near]]
            seeds, parents = [seed[owner]], [owner]
            left, made = np.flatnonzero(~near), len(owner)
            while len(left):
                # The first point that a node's children leave uncovered becomes a child, in all nodes at once.
                opens = np.r_[True, node[left][1:] != node[left][:-1]]
                at, who = own[left[opens]], node[left[opens]]
                number[who] = made + np.arange(len(who))
                gap = points[own[left]] - points[at][np.cumsum(opens) - 1]
                inside = (gap * gap).sum(1) <= limit[node[left]]
                child[left[inside]] = number[node[left[inside]]]
                seeds.append(points[at])
                parents.append(who)
                made, left = made + len(who), left[~inside]
            parent = np.concatenate(parents)
            order = np.argsort(parent, kind="stable")
            place = np.empty(made, dtype=np.int64)
            place[order] = np.arange(made)
            child = place[child]
            # Points of a node move within its run, so that each child's lie together.
            turned = np.argsort(child, kind="stable")
            spots = _runs(begin[cut], size[cut])
            rows[spots] = own[turned]
            seed, parent = np.concatenate(seeds)[order], parent[order]
            count = np.bincount(child, minlength=made)
            levels[-1][6] = np.bincount(parent, minlength=len(begin))
            offset = np.cumsum(count) - count
            lead = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            within = offset - np.repeat(offset[lead], np.diff(np.r_[lead, made]))
            begin, size = begin[parent] + within, count
        parts = [[] for _ in range(7)]
        base = 0
        for seed, far, size, total, begin, cut, fan in levels:
            base += len(seed)
            fan = np.zeros(len(seed), dtype=np.int64) if fan is None else fan
            first = np.where(cut, base + np.cumsum(fan) - fan, -1)
            for held, x in zip(parts, (seed, np.sqrt(far.astype(np.float64)), size, total, first, fan, begin), strict=True):
                held.append(x)
        return cls(*(np.concatenate(x) for x in parts[:6]), rows, np.concatenate(parts[6]))

    def walk(self, books: np.ndarray, groups: int, points: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """``group, entry, count, total, begin`` of everything decided, by levels: whole subtrees first, then, for
        nodes without children, single points (with ``points``, the parts themselves, in the order of the input).

        ``books`` is groups x entries x width. Distances are exact; roots and the margin only decide how deep to go."""
        group = np.arange(groups)
        nodes = np.arange(groups)
        while len(nodes):
            d2 = squared(self.center[nodes], group, books)
            entry = d2.argmin(1)
            each = np.arange(len(nodes))
            one = np.sqrt(d2[each, entry].astype(np.float64))
            d2[each, entry] = np.iinfo(np.int64).max
            two = np.sqrt(d2.min(1).astype(np.float64)) if books.shape[1] > 1 else np.full(len(nodes), np.inf)
            radius = self.radius[nodes]
            sure = (radius == 0) | (two - one > 2 * radius * (1 + 1e-9) + 1e-6)
            yield group[sure], entry[sure], self.count[nodes[sure]], self.total[nodes[sure]], self.begin[nodes[sure]]
            nodes, group = nodes[~sure], group[~sure]
            leaf = self.first[nodes] < 0
            ends, theirs = nodes[leaf], group[leaf]
            if len(ends):
                spots = _runs(self.begin[ends], self.count[ends])
                theirs = np.repeat(theirs, self.count[ends])
                parts = points[self.rows[spots]]
                yield theirs, squared(parts, theirs, books).argmin(1), np.ones(len(spots), dtype=np.int64), parts, spots
            nodes, group = nodes[~leaf], group[~leaf]
            group = np.repeat(group, self.children[nodes])
            nodes = _runs(self.first[nodes], self.children[nodes])


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All the places of runs, one run after another."""
    stops = np.cumsum(size)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin - stops + size, size)


def squared(points: np.ndarray, group: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to all entries of its group's codebook."""
    made = np.empty((len(points), books.shape[1]), dtype=np.int64)
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(books).max(initial=0)))
    # Doubles hold whole numbers of 53 bits; beyond them, the same sums in 64-bit integers.
    kind = np.float64 if points.shape[1] * (2 * most) ** 2 < 1 << 52 else np.int64
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(len(books) + 1))
    for g in range(len(books)):
        mine = order[bounds[g] : bounds[g + 1]]
        if len(mine):
            x, c = points[mine].astype(kind), books[g].astype(kind)
            made[mine] = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return made


def _chunk_tree(matrix: np.ndarray, parts: int) -> tuple[CoverTree, np.ndarray]:
    n, width = len(matrix), matrix.shape[1] // parts
    points = matrix.reshape(n, parts, width).transpose(1, 0, 2).reshape(parts * n, width)
    return CoverTree.build(points, parts), points


def _packed(tree: CoverTree, points: np.ndarray) -> dict[str, bytes]:
    fields = {"center": (tree.center, "<i4"), "radius": (tree.radius, "<f8"), "count": (tree.count, "<i4"), "total": (tree.total, "<i8"), "first": (tree.first, "<i4"), "children": (tree.children, "<i4"), "begin": (tree.begin, "<i4"), "rows": (tree.rows, "<i4"), "points": (points, "<i4")}
    return {name: np.ascontiguousarray(x, dtype=kind).tobytes() for name, (x, kind) in fields.items()}


def _unpacked(row: dict, width: int) -> tuple[CoverTree, np.ndarray]:
    read = lambda name, kind: np.frombuffer(row[name], dtype=kind).astype(np.float64 if kind == "<f8" else np.int64)
    wide = lambda name, kind: read(name, kind).reshape(-1, width)
    tree = CoverTree(wide("center", "<i4"), read("radius", "<f8"), read("count", "<i4"), wide("total", "<i8"), read("first", "<i4"), read("children", "<i4"), read("rows", "<i4"), read("begin", "<i4"))
    return tree, wide("points", "<i4")


def _grow(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            tree, points = _chunk_tree(_matrix(pa.concat_arrays([piece.column(1)]), width), parts)
            made = {k: pa.array([v], pa.binary()) for k, v in _packed(tree, points).items()}
            own = {name: _one_list(piece.column(i)) for i, name in ((0, "ids"), (2, "labels"))}
            yield pa.RecordBatch.from_pydict(own | made)


def _one_list(column: pa.Array) -> pa.Array:
    column = pa.concat_arrays([column])
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    groups, entries, width = books.shape
    count = np.zeros(groups * entries, dtype=np.int64)
    total = np.zeros((groups * entries, width), dtype=np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            tree, points = _unpacked(row, width)
            for group, entry, n, s, _ in tree.walk(books, groups, points):
                at = group * entries + entry
                np.add.at(count, at, n)
                np.add.at(total, at, s)
    used = np.flatnonzero(count)
    if len(used):
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int64()), "count": pa.array(count[used]), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    groups, _, width = books.shape
    digits = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), dtype="S2")
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in _BLOBS}
            tree, points = _unpacked(row, width)
            n = len(points) // groups
            ids, labels = (batch.column(name)[at].values for name in ("ids", "labels"))
            codes = np.empty(groups * n, dtype=np.int64)
            for _, entry, many, _, begin in tree.walk(books, groups, points):
                codes[tree.rows[_runs(begin, many)]] = np.repeat(entry, many)
            gap = points - books[np.repeat(np.arange(groups), n), codes]
            error = (gap * gap).sum(1).reshape(groups, n).sum(0)
            text = np.ascontiguousarray(digits[codes.reshape(groups, n).T]).view(f"S{2 * groups}").ravel()
            made = [ids, labels, pa.array(text.astype(str), pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema, strict=True)], schema=schema)


def lloyd(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``, one row a kept vector.

    ``code`` has two hexadecimal digits a part, so there are at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("two hexadecimal digits hold 256 entries")
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "vectorcodes")
    source = rows.where(kept(rows, vector)).select(F.col(id_).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    longest = source.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-max(longest, 1) // parts)
    # A codebook is at most 256 vectors: its rows are all that the driver sees of the table.
    begin = source.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    named = {f.name: f.dataType.simpleString() for f in source.schema}
    if not begin:
        return spark.createDataFrame([], f"vec_id {named['vec_id']}, label {named['label']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    first = _matrix(pa.array([r[0] for r in begin], pa.list_(pa.float64())), width * parts)
    books = first.reshape(len(begin), parts, width).transpose(1, 0, 2).copy()

    grown = f"ids array<{named['vec_id']}>, labels array<{named['label']}>, " + ", ".join(f"{b} binary" for b in _BLOBS)
    trees = scratch.write(source.mapInArrow(lambda it: _grow(it, width * parts, parts), grown), "trees")
    for _ in range(rounds):
        at = books
        part = trees.select(*_BLOBS).mapInArrow(lambda it, at=at: _sums(it, at), "slot bigint, count bigint, total array<bigint>")
        sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
        books = books.copy()
        for row in part.groupBy("slot").agg(F.sum("count").alias("n"), *sums).collect():
            books[row.slot // len(begin), row.slot % len(begin)] = [row[f"s{i}"] // row.n for i in range(width)]

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    schema = f"vec_id {named['vec_id']}, label {named['label']}, code string, error bigint"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    coded = scratch.write(trees.mapInArrow(lambda it: _codes(it, books, arrow), schema), "codes", drop=("trees",))
    by_label = scratch.write(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "_of")
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("_of")))
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
