"""MinHash near-duplicate detection with odd sketches.

Phase 1 reads every text once: its distinct word shingles give an exact set fingerprint, MinHash values
(``BANDS`` bands of ``ROWS``; a pair at similarity 0.8 misses all bands with probability below 1e-6) and
an odd sketch: parity bits into which each MinHash value of a larger sample is folded. The share of odd
bits in the XOR of two sketches gives the size of the samples' difference, precisely at high similarity.
Texts with equal sets form one class from here on, so that copies cost nothing further.

Phase 2 links classes. In each band bucket every member is paired with the bucket's smallest member
(pairs grow with the members, not their square); pairs whose sketches are too far apart are dropped,
the others are confirmed on their full sets, and components are formed. Buckets that still hold
several components are compared in blocks with numpy, across components only, twice: first by sketch
alone, which leaves the members that have a near sketch in another component, and then those members by
their full sets. A block returns each of its members once, or at most one link per two components that it
joins, never its pairs. Blocks against blocks grow with the square of a bucket: one of more than ``WIDE`` members is
parted first by the shingles that its members hold, the rarest of each, so many that two sets at the threshold
must share one of them. What is dealt then grows with the members.

Defined results: a text without words, or a null one, has an empty set and links with nothing; a null
doc_id links with nothing, gets a null component and is kept; rows repeated with one doc_id are one
document if their sets are equal, and otherwise share a component through their id; a very long text is hashed whole,
at some 60 bytes a byte, and is a block of its own where sets are compared; an empty table
gives an empty table; other columns are not read by ``near_duplicates`` and are carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, fresh, parts
from .textarrays import list_array, mix, shingle_sets

ROWS, BANDS = 4, 28
SKETCH_BITS, SKETCH_SAMPLES = 2048, 512
# A block has at most so many members, and, where sets are compared, at most so many shingles besides its last
# member's: a task holds two blocks, at some 90 bytes a shingle.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Where a bucket has more members, each costs fewer rows by its rarest shingles than by blocks.
WIDE = 64 * BLOCK

_SET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
_rng = np.random.default_rng(20100617)
_FACTORS = _rng.integers(0, 1 << 62, ROWS * BANDS, dtype=np.int64).astype(np.uint32) | np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.int64).astype(np.uint32)
_SEED = np.uint64(0xD6E8FEB86659FD93)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """MinHash values: the least of each multiply-and-add of the shingles' upper halves."""
    high = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(best, (high[at : at + 1024, None] * _FACTORS + _OFFSETS).min(axis=0), out=best)
    return best


def _sketch(shingles: np.ndarray) -> bytes:
    """The odd sketch of the set's one-permutation sample: the least shingle of each of SKETCH_SAMPLES bins."""
    values = mix(shingles ^ _SEED)
    bins = (values % np.uint64(SKETCH_SAMPLES)).astype(np.int64)
    best = np.full(SKETCH_SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(best, bins, values)
    present = best[best != np.iinfo(np.uint64).max]
    places = (mix(present) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def describe(df: DataFrame, width: int, text: str, doc_id: str, lower: bool = True) -> DataFrame:
    """``doc_id, n, f1, f2, bands, sketch`` of every row."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, bands, sketches = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width, lower):
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(mix(s ^ _SEED).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                if len(s):
                    rows = _minima(s).astype(np.uint64).reshape(BANDS, ROWS)
                    key = rows[:, 0]
                    for r in range(1, ROWS):
                        key = mix(key) + rows[:, r]
                    bands.append(mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                    sketches.append(_sketch(s))
                else:
                    bands.append(np.zeros(0, dtype=np.int64))
                    sketches.append(b"")
            flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), list_array(pa.array(flat), np.array([len(b) for b in bands], dtype=np.int64)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SET)

    read = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return read.mapInArrow(tasks, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, sketch binary")


def _sets(df: DataFrame, width: int, text: str, doc_id: str, lower: bool = True) -> DataFrame:
    """``id, shingles`` (distinct) of every row."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, len(ids), 256):
                found = list(shingle_sets(batch.column(1).slice(at, 256), width, lower))
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), list_array(pa.array(flat), np.array([len(x) for x in found]))], names=["id", "shingles"])

    return df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(tasks, "id bigint, shingles array<bigint>")


def odd_bits_limit(threshold: float) -> int:
    """Odd bits that a pair at ``threshold`` exceeds with a chance of less than about 1e-7.

    Of the filled bins a share of ``1 - threshold`` differs, give or take; each adds two elements at most to
    the samples' difference, and the XOR of the sketches has no more odd bits than the difference elements."""
    spread = 5.3 * np.sqrt(SKETCH_SAMPLES * threshold * (1 - threshold))
    return int(2 * min(SKETCH_SAMPLES, SKETCH_SAMPLES * (1 - threshold) + spread))


def estimate(sketch_a: bytes, sketch_b: bytes, filled: int = SKETCH_SAMPLES) -> float:
    """The similarity that two odd sketches of samples over ``filled`` bins suggest."""
    unlike = np.frombuffer(sketch_a, np.uint8) ^ np.frombuffer(sketch_b, np.uint8)
    share = min(int(np.bitwise_count(unlike).sum()) / (SKETCH_BITS / 2), 1 - 1e-9)
    return max(0.0, 1 - SKETCH_BITS / 2 * -np.log(1 - share) / (2 * filled))


def _sketched(pairs: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches are near enough."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_a, of_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64) for i in (2, 3))
            near = pa.array(np.bitwise_count(of_a ^ of_b).sum(axis=1) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    own = classes.select("id", "sketch")
    both = pairs.join(own.toDF("b", "of_b"), "b").join(own.toDF("a", "of_a"), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(tasks, "a bigint, b bigint").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold; a hot member is split by the join, not gathered."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("of_a", "of_b")).cast("bigint")
    union = F.size("of_a").cast("bigint") + F.size("of_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def _first_shared(bands: np.ndarray, i: int, others: np.ndarray, bucket: int) -> np.ndarray:
    """Those of ``others`` that share no earlier band with i than the one of this bucket."""
    if not len(others):
        return others
    return others[bands[i][np.argmax(bands[others] == bands[i], axis=1)] == bucket]


def _within(sizes: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` whose sets are large and small enough to be like that of i."""
    return others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(table), -1)


def _near(placed: DataFrame, classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """``bucket, id`` of members with a member of another component whose sketch is near; each pair is looked
    at in the first bucket that it shares. Only bands and sketches are dealt to the blocks."""
    dealt = _dealt(placed).join(classes.select("id", "bands", "sketch"), "id")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        bucket, x, y = (k.as_py() for k in key)
        band = table.column("band")[0].as_py()
        ids, root, block, sizes = (table.column(c).to_numpy() for c in ("id", "component", "block", "n"))
        sketches, bands = _sketches(table), np.array(table.column("bands").to_pylist(), dtype=np.int64)
        near = np.zeros(len(ids), dtype=bool)
        right = np.flatnonzero(block == y)
        for i in np.flatnonzero(block == x).tolist():
            other = right if x != y else right[ids[right] > ids[i]]
            other = _within(sizes, i, other[root[other] != root[i]], percent)
            other = other[np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1) <= limit]
            other = _first_shared(bands, i, other, band)
            near[other] = True
            near[i] |= len(other) > 0
        return pa.table({"bucket": pa.array(np.full(int(near.sum()), bucket, dtype=np.int64)), "id": pa.array(ids[near])})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(compare, "bucket bigint, id bigint").distinct()


def _across(placed: DataFrame, described: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links ``a, b`` between different components, confirmed on full sets, enough to join what they join.

    ``placed`` comes from ``_numbered``; ``described`` has ``id, bands, sketch, shingles``. A bucket is cut in
    blocks; a block meets itself and each later one."""
    dealt = _dealt(placed).join(described, "id")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, x, y = (k.as_py() for k in key)
        table = table.combine_chunks()
        band = table.column("band")[0].as_py()
        ids, root, block = (table.column(c).to_numpy().copy() for c in ("id", "component", "block"))
        sketches, bands = _sketches(table), np.array(table.column("bands").to_pylist(), dtype=np.int64)
        lists = table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        places, member = np.unique(values, return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.zeros(len(places), dtype=np.int64)
        links: list[tuple[int, int]] = []
        right = np.flatnonzero(block == y)
        for i in np.flatnonzero(block == x).tolist():
            other = right if x != y else right[ids[right] > ids[i]]
            other = _within(sizes, i, other[root[other] != root[i]], percent)
            other = other[np.bitwise_count(sketches[other] ^ sketches[i]).sum(axis=1) <= limit]
            other = _first_shared(bands, i, other, band)
            if not len(other):
                continue
            own_part = member[begins[i] : begins[i + 1]]
            inside[own_part] = 1
            flat = np.concatenate([member[begins[j] : begins[j + 1]] for j in other.tolist()])
            common = np.add.reduceat(inside[flat], np.concatenate([[0], np.cumsum(sizes[other])[:-1]]))
            inside[own_part] = 0
            for j in other[100 * common >= percent * (sizes[i] + sizes[other] - common)].tolist():
                if root[j] != root[i]:
                    links.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", lower: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id reachable over links of at least ``percent`` percent similarity."""
    spark = df.sparkSession
    scratch, limit = Scratch(spark, "neardup"), odd_bits_limit(percent / 100)
    docs = scratch.write(describe(df, width, text, doc_id, lower), "docs")

    known = docs.where("doc_id is not null and n > 0")
    classes = known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s"))
    classes = scratch.write(classes.select("n", "f1", "f2", "id", "s.bands", "s.sketch"), "classes")

    nodes = classes.select("id", "n", F.explode("bands").alias("bucket"))
    hubs = nodes.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.min_by("n", "id").alias("hub_n")).where("hub <> top")
    hubs = scratch.write(hubs, "hubs")
    alike = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    starred = nodes.join(hubs, "bucket").where("id <> hub").where(alike)
    pairs = _sketched(starred.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, limit)
    pairs = scratch.write(pairs, "pairs", drop=("hubs",))

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        # The ids grow with the texts: a join that is planned to shuffle both from the start, without sorting texts.
        wanted = ids.select(F.col(ids.columns[0]).alias("wanted")).distinct().hint("shuffle_hash")
        texts = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
        return scratch.write(_sets(texts.join(wanted, texts["id"] == wanted["wanted"], "left_semi"), width, "text", "id", lower), name)

    sets = sets_of(pairs.select("a").union(pairs.select("b")), "star-sets")
    links = scratch.write(_confirm(pairs, sets, percent), "star-links", drop=("star-sets", "pairs"))
    labels = components(links, scratch, "first")
    labelled = classes.join(labels, "id", "left").select("id", "n", "bands", F.coalesce("component", "id").alias("component"))
    spread = labelled.select("id", "n", "component", F.explode("bands").alias("bucket"))
    members = _parted(_open(spread, scratch, "members"), sets_of, scratch, percent)
    near = scratch.write(_near(_numbered(members, by_shingles=False), classes, limit, percent), "near")
    members = _open(members.drop("size").join(near, ["bucket", "id"]), scratch, "near-members", drop=("members",))
    shingles = sets_of(near.select("id"), "across-sets")
    described = classes.select("id", "bands", "sketch").join(shingles, "id")
    across = scratch.write(_across(_numbered(members), described, limit, percent), "across-links", drop=("near", "near-members", "across-sets"))
    links = links.unionByName(across)

    # Rows of one doc_id are one document: their classes' representatives are joined by their ids.
    rows = docs.where("doc_id is not null and n > 0").select("doc_id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "id"), ["n", "f1", "f2"])
    same = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    labels = components(links.unionByName(same), scratch, "last")
    final = classes.select("n", "f1", "f2", "id").join(labels, "id", "left").select("n", "f1", "f2", F.coalesce("component", "id").alias("component"))
    result = docs.select("doc_id", "n", "f1", "f2").join(final, ["n", "f1", "f2"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _open(members: DataFrame, scratch: Scratch, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The members of buckets that hold several components, with the bucket's ``size``, as a written table. The buckets
    are written first, so that both sides of the join are plain shuffles, which Spark cuts at a hot bucket."""
    of = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    several = scratch.write(of.where("low <> high").select("bucket", "size"), f"{name}-buckets")
    return scratch.write(members.join(several, "bucket"), name, drop=(f"{name}-buckets", *drop))


def _parted(members: DataFrame, sets_of, scratch: Scratch, percent: int, wide: int = WIDE) -> DataFrame:  # noqa: ANN001
    """Members with ``band``, their bucket, and where that has more than ``wide`` members, with a ``bucket`` (and its
    ``size``) for each of the rarest shingles of theirs that members of other components hold too.

    Of n shingles, in an order that all sets share, the first n - ceil(n * percent / 100) + 1 are enough: sets that reach
    the threshold have one of them in common."""
    large = members.where(F.col("size") > wide)
    same = members.withColumn("band", F.col("bucket"))
    if large.isEmpty():
        return same
    rows = sets_of(large.select("id"), "wide-sets").select("id", F.explode("shingles").alias("shingle"))
    # Written first, so that a shingle that very many sets have is a plain shuffle's hot key, which Spark cuts.
    counts = scratch.write(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")), "wide-counts")
    order = F.array_sort(F.collect_list(F.struct("f", "shingle")))
    n = F.size("o")
    first = F.slice("o", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    rarest = rows.join(counts, "shingle").groupBy("id").agg(order.alias("o")).select("id", F.explode(first["shingle"]).alias("shingle"))
    rarest = scratch.write(rarest, "wide-rarest", drop=("wide-sets", "wide-counts"))
    parted = large.drop("size").join(rarest, "id").select(F.xxhash64("bucket", "shingle").alias("bucket"), F.col("bucket").alias("band"), "id", "component", "n")
    return same.where(F.col("size") <= wide).unionByName(_open(scratch.write(parted, "wide-parted", drop=("wide-rarest",)), scratch, "wide-members", drop=("wide-parted",)))


def _dealt(placed: DataFrame) -> DataFrame:
    """Every member once for each pair ``x, y`` of blocks of its bucket of which ``block`` (its own) is one. Members
    without a ``band`` are in the bucket's own."""
    band = F.col("band" if "band" in placed.columns else "bucket").alias("band")
    own, last = (F.floor(F.col(c) / BLOCK_SHINGLES) for c in ("place", "last"))
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y")))
    return placed.select("bucket", band, "id", "component", "n", own.alias("block"), F.inline(meets))


def _numbered(members: DataFrame, by_shingles: bool = True) -> DataFrame:
    """Members (``bucket, id, component, size, n``) with ``place``, the weight of those before them in the bucket,
    and ``last``, the place of the bucket's last one. A member weighs its shingles, but at least a BLOCK-th of
    BLOCK_SHINGLES (where sets are not compared, just that) and at most all of it. Places are given in slices of a
    bucket, dealt by a hash of the id, so that no task has to sort a bucket that holds a large part of all rows."""
    from pyspark.sql import Window

    slices = F.greatest(F.floor(F.col("size") / BLOCK), F.lit(0)) + 1
    least, most = BLOCK_SHINGLES // BLOCK, BLOCK_SHINGLES if by_shingles else BLOCK_SHINGLES // BLOCK
    weight = F.least(F.greatest(F.col("n"), F.lit(least)), F.lit(most)).cast("bigint")
    cut = members.withColumn("slice", F.pmod(F.xxhash64("id"), slices)).withColumn("weight", weight)
    sums = cut.groupBy("bucket", "slice").agg(F.sum("weight").alias("c"), F.max_by("weight", "id").alias("final"))
    by_slice = Window.partitionBy("bucket").orderBy("slice")
    before = F.coalesce(F.sum("c").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = sums.select("bucket", "slice", before.alias("before"), (F.sum("c").over(whole) - F.last("final").over(whole)).alias("last"))
    local = F.sum("weight").over(Window.partitionBy("bucket", "slice").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    return cut.withColumn("local", local).join(begins, ["bucket", "slice"]).withColumn("place", (F.col("before") + F.col("local")).cast("bigint"))


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that their component keeps, with all their columns."""
    found = near_duplicates(df, width, percent, text, doc_id)
    key = fresh(df, "_kept_id")
    gone = found.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return df.join(gone, F.col(f"`{doc_id}`").cast("bigint") == F.col(key), "left_anti")
