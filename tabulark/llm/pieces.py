"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

The model file gives pieces and log scores. A text's spaces become markers, one more is put before it,
and the segmentation with the highest sum of scores is taken: at each position the trie yields every
piece that starts there, a character without a piece costs the unknown score and is written as its
bytes, and of equal sums the one whose last piece starts first wins. As no piece runs from another
character into a marker, the best segmentation of a text is that of its marker-opened stretches one
after another. Many stretches are segmented side by side with numpy, and a worker remembers those of up to 15
bytes that it has met, within bounds.

Decoding concatenates pieces and bytes, turns markers into spaces, and drops the one put before.

The model's own rules: a user-defined piece competes with a score just below its length times the best score, as in the
library's unigram mode, whatever score the file gives it; a model that normalises text, takes out white space, or puts no
marker before a text is refused.

Defined results: a null or empty text has no ids, and no ids decode to an empty text; repeated rows have equal
ids; a very long text is encoded stretch by stretch; an empty table gives an empty table; the input's columns
stay, and where one has the output's name, that gets underscores appended. A marker in a text decodes as a space.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh
from .textarrays import slices, utf8
from .tokenize import LONGEST_KEY, TABLE_SLOTS, Table, keys

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Stretches of more bytes are segmented one by one; the others side by side, so many bytes at a time.
LONG_STRETCH, BYTES_AT_ONCE, IDS_AT_ONCE = 512, 1 << 18, 1 << 18

# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> list[tuple[str, float, int]]:
    """Piece, log score and kind by id."""
    with open(path, "rb") as file:
        pieces = [dict(_fields(x)) for f, x in _fields(file.read()) if f == 1]
    return [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)) for p in pieces]


def check_rules(path: str) -> None:
    """Raises for a model whose texts are not taken as they are, with one marker put before."""
    with open(path, "rb") as file:
        rules = next((dict(_fields(x)) for f, x in _fields(file.read()) if f == 3), {})
    # The section's fields for a character map, the marker before, dropped white space, markers at all.
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError("the model normalises its texts")


class DoubleArray:
    """A trie over bytes: the child of state s by byte b is t = base[s] + b + 1 if check[t] == s."""

    def __init__(self, base: array, check: array, value: array):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: list[tuple[bytes, int]]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys:
            node = 0
            for byte in key:
                step = children[node].get(byte)
                if step is None:
                    step = children[node][byte] = len(children)
                    children.append({})
                    values.append(-1)
                node = step
            values[node] = value
        size = 2 * len(children) + 1024
        open_ = np.ones(size, dtype=bool)
        open_[0] = False
        start_of: dict[int, int] = {}
        free = 1
        for node in sorted((n for n in range(len(children)) if children[n]), key=lambda n: -len(children[n])):
            # The hardest families go first; each takes the first place where all its states are open.
            bytes_ = sorted(children[node])
            while not open_[free]:
                free += 1
            start, span = max(0, free - bytes_[0] - 1), 512
            while True:
                if start + span + 257 > len(open_):
                    open_ = np.concatenate([open_, np.ones(size + span, dtype=bool)])
                fits = open_[start + bytes_[0] + 1 : start + bytes_[0] + 1 + span].copy()
                for b in bytes_[1:]:
                    fits &= open_[start + b + 1 : start + b + 1 + span]
                found = int(fits.argmax())
                if fits[found]:
                    break
                start, span = start + span, 2 * span
            start += found
            open_[np.array(bytes_) + start + 1] = False
            start_of[node] = start
        size = len(open_)
        base, check, out = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        check[0], state = -2, {0: 0}
        order = [0]
        for node in order:
            for b, child in children[node].items():
                place = start_of[node] + b + 1
                state[child] = place
                check[place] = state[node]
                order.append(child)  # the walk goes on over what it appends
            out[state[node]] = values[node]
            base[state[node]] = start_of.get(node, 0)
        last = int(np.flatnonzero(~open_)[-1]) + 258
        return cls(base[:last], check[:last], out[:last])

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """End and value of every key that ``text`` has at ``start``."""
        base, check, value, state = self.base, self.check, self.value, 0
        for at in range(start, len(text)):
            step = base[state] + text[at] + 1
            if check[step] != state:
                return
            state = step
            if value[state] >= 0:
                yield at + 1, value[state]


class Unigram:
    """Encodes and decodes with a model's pieces; small enough (a vocabulary) to send to every task.

    Inside, a marker is the byte of a space, which no text has otherwise.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        whole = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and " " not in p]
        if any(MARK in p.lstrip(MARK) for p, _ in whole):
            raise ValueError("a piece runs from another character into a marker")
        self.trie = DoubleArray.build([(p.replace(MARK, " ").encode(), i) for p, i in whole])
        self.base, self.check, self.value = (np.array(x, dtype=np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        most = max((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        self.scores = [len(p) * most - 0.1 if kind == USER_DEFINED else s for p, s, kind in pieces]
        self.unknown_score = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        # An unknown character is piece -1, the last entry.
        self.weights = np.array([*self.scores, self.unknown_score])
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = np.array([byte_ids.get(b, self.unknown_id) for b in range(256)], dtype="<u4") if byte_ids else None
        # What an id stands for in a decoded text.
        surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.surface_size = np.array([len(x) for x in surface], dtype=np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.table: Table | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every match in ``data``, each within the stretch that ends at its ``stop``,
        and of every character that has no piece of its own (piece -1)."""
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(chars, len(data)))
        start, state, at = chars, np.zeros(len(chars), dtype=np.int32), chars
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(data), dtype=bool)
        while len(start):
            step = self.base[state] + data[at] + 1
            alive = np.flatnonzero(self.check[step] == state)
            start, state, at = start[alive], step[alive], at[alive] + 1
            piece = self.value[state]
            ends = np.flatnonzero(piece >= 0)
            found.append((start[ends], at[ends], piece[ends]))
            open_ = np.flatnonzero(at < stop[start])
            start, state, at = start[open_], state[open_], at[open_]
        from_, to, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        next_char = np.zeros(len(data), dtype=np.int64)
        next_char[chars] = chars + width
        single[from_[to == next_char[from_]]] = True
        unknown = chars[~single[chars]]
        return np.concatenate([from_, unknown]), np.concatenate([to, next_char[unknown]]), np.concatenate([piece, np.full(len(unknown), -1, dtype=np.int32)])

    def segment(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best segmentation of every stretch, and how many each has. The stretches, none empty,
        lie one after another; step r settles, in all of them, what leads on from their r-th byte."""
        n, own = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        stop = np.cumsum(sizes)
        begin = stop - sizes
        from_, to, piece = self._edges(data, np.repeat(stop, sizes))
        # A stretch of k bytes has k + 1 nodes.
        rank = from_ - begin[own[from_]]
        order = np.argsort(rank, kind="stable")
        from_, to, piece, rank = from_[order], to[order], piece[order], rank[order]
        source, target = from_ + own[from_], to + own[from_]
        weight = self.weights[piece]
        score, back = np.full(len(data) + n, -np.inf), np.zeros(len(data) + n, dtype=np.int64)
        first = begin + np.arange(n)
        score[first] = 0.0
        bounds = np.searchsorted(rank, np.arange(int(sizes.max()) + 1)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            # Two edges of one stretch and start have two ends, so no end is written twice in a step.
            end, total = target[a:b], score[source[a:b]] + weight[a:b]
            better = np.flatnonzero(total > score[end])
            end = end[better]
            score[end] = total[better]
            back[end] = better + a
        # Back from every stretch's end, the last edges first.
        node, alive = stop + np.arange(n), np.arange(n)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            edge = back[node]
            taken.append((alive, edge))
            node = source[edge]
            left = np.flatnonzero(node > first[alive])
            node, alive = node[left], alive[left]
        count = np.bincount(np.concatenate([a for a, _ in taken]), minlength=n)
        last, edges = np.cumsum(count) - 1, np.zeros(int(count.sum()), dtype=np.int64)
        for step, (a, edge) in enumerate(taken):
            edges[last[a] - step] = edge
        ids = piece[edges]
        unknown = ids < 0
        if not unknown.any():
            return ids.astype("<u4"), count
        if self.byte_ids is None:
            return np.where(unknown, self.unknown_id, ids).astype("<u4"), count
        at, mark = from_[edges], np.frombuffer(MARK.encode(), dtype=np.uint8)
        marker = unknown & (data[at] == 32)
        width = np.where(unknown, to[edges] - at, 1)
        width[marker] = len(mark)
        place = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        made, unknown, marker, at = (np.repeat(x, width) for x in (ids, unknown, marker, at))
        raw = np.where(marker, mark[place % len(mark)], data[np.minimum(at + place, len(data) - 1)])
        return np.where(unknown, self.byte_ids[raw], made).astype("<u4"), np.bincount(np.repeat(np.arange(n), count), width, n).astype(np.int64)

    def _segment_long(self, data: np.ndarray) -> np.ndarray:
        """One long stretch, by the same rules, node after node."""
        text, n = data.tobytes(), len(data)
        score, back = [-np.inf] * (n + 1), [(0, 0)] * (n + 1)
        score[0], at = 0.0, 0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        while at < n:
            lead = text[at]
            width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            own, single, state = score[at], False, 0
            for end in range(at, n):
                step = base[state] + text[end] + 1
                if check[step] != state:
                    break
                state, piece = step, value[step]
                if piece >= 0:
                    end += 1
                    single = single or end == at + width
                    total = own + scores[piece]
                    if total > score[end]:
                        score[end], back[end] = total, (at, piece)
            if not single and own + self.unknown_score > score[at + width]:
                score[at + width], back[at + width] = own + self.unknown_score, (at, -1)
            at += width
        ids: list[int] = []
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids is None:
                ids.append(self.unknown_id)
            else:
                ids.extend(int(self.byte_ids[b]) for b in reversed(text[start:at].replace(b" ", MARK.encode())))
            at = start
        return np.array(ids[::-1], dtype="<u4")

    def _segments(self, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`segment` of stretches anywhere in ``data``, some bytes at a time, long ones apart."""
        ids, counts, a = [np.zeros(0, dtype="<u4")], np.zeros(len(at), dtype=np.int64), 0
        ends, long = np.cumsum(sizes), np.append(np.flatnonzero(sizes > LONG_STRETCH), len(at))
        while a < len(at):
            if sizes[a] > LONG_STRETCH:
                ids.append(self._segment_long(data[at[a] : at[a] + sizes[a]]))
                counts[a] = len(ids[-1])
                a += 1
                continue
            b = int(np.searchsorted(ends, ends[a] - sizes[a] + BYTES_AT_ONCE, side="right"))
            b = min(max(b, a + 1), int(long[np.searchsorted(long, a)]))
            some, counts[a:b] = self.segment(data[_spread(at[a:b], sizes[a:b])], sizes[a:b])
            ids.append(some)
            a = b
        return np.concatenate(ids), counts

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text (null or empty: none)."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
        data, offsets = utf8(pc.binary_join_element_wise(lead, texts, pa.scalar("", pa.large_string())))
        made: list[bytes] = []
        for _, _, part, bounds in slices(data, offsets):
            made += self._slice(part, bounds)
        return made

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        n = len(data)
        if not n:
            return [b""] * (len(bounds) - 1)
        # Every marker that does not follow another one opens a stretch, and so does a text.
        opens = data == 32
        opens[1:] &= data[:-1] != 32
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(opens)
        sizes = np.diff(np.append(at, n))
        if self.table is None or self.table.entries > TABLE_SLOTS // 2:
            self.table = Table()
        padded = np.zeros((n // 8 + 4) * 8, dtype=np.uint8)
        padded[:n] = data
        low, high = keys(padded.view("<u8"), at, sizes)
        high |= np.minimum(sizes, LONGEST_KEY).astype(np.uint64) << np.uint64(56)  # a size tells zeros from padding
        keyed = sizes < LONGEST_KEY
        entry = self.table.find(low, high)
        new = np.flatnonzero(keyed & (entry < 0))
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            one = order[np.append(True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0))]
            ids, counts = self._segments(data, at[one], sizes[one])
            raw, ends = ids.tobytes(), np.cumsum(counts)
            self.table.add(low[one], high[one], [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)])
            entry[new] = self.table.find(low[new], high[new])
        apart = np.flatnonzero(~keyed)
        entry[apart] = 0
        count = self.table.count[entry]
        ids, count[apart] = self._segments(data, at[apart], sizes[apart])
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]), dtype="<u4")
        place, kept = ends - count, np.flatnonzero(keyed)
        out[_spread(place[kept], count[kept])] = self.table.ids[_spread(self.table.begin[entry[kept]], count[kept])]
        out[_spread(place[apart], count[apart])] = ids
        before, raw = np.append(0, ends)[np.searchsorted(at, bounds)].tolist(), out.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(before[:-1], before[1:], strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.large_string()))[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; some ids at a time, and bytes that are no UTF-8 become U+FFFD."""
        whole, made = np.frombuffer(ids, dtype="<u4"), []
        for a in range(0, len(whole), IDS_AT_ONCE):
            some = whole[a : a + IDS_AT_ONCE]
            made.append(self.surface[_spread(self.surface_at[some], self.surface_size[some])].tobytes())
        return b"".join(made).removeprefix(b" ").decode("utf-8", errors="replace")


def _spread(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ``sizes[k]`` entries from ``at[k]`` on, for all k in order."""
    ends = np.cumsum(sizes)
    return np.repeat(at - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


_unigrams: dict[str, Unigram] = {}


class _Shared:
    """A broadcast model and this worker's copy of it, which outlives tasks with its memo."""

    def __init__(self, spark: SparkSession, path: str):
        check_rules(path)
        self.key, self.sent = path, spark.sparkContext.broadcast(Unigram(read_model(path)))

    def get(self) -> Unigram:
        if self.key not in _unigrams:
            _unigrams[self.key] = self.sent.value
        return _unigrams[self.key]


def encode(df: DataFrame, model: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` and a binary column of little-endian unsigned 32-bit ids (empty for a null or empty text)."""
    shared = _Shared(df.sparkSession, model)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(shared.get().encode_all(texts), pa.binary())

    return df.withColumn(fresh(df, name), ids(F.col(f"`{text}`")))


def decode(df: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` and a string column with the text of each id sequence (null: empty)."""
    shared = _Shared(df.sparkSession, model)

    @F.arrow_udf("string")
    def texts(values: pa.Array) -> pa.Array:
        unigram = shared.get()
        return pa.array([unigram.decode(v.as_py() or b"") for v in values], pa.string())

    return df.withColumn(fresh(df, name), texts(F.col(f"`{ids}`")))
