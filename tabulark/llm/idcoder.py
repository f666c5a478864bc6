"""Token ids in checksummed blocks, by an adaptive context-mixing range coder.

Four predictions share the code space of the next id: the id that followed the last two ids before (order 2),
the two ids that followed the last one most lately (order 1), and counts of single ids (order 0). How much each
gets adapts, for every combination of what the contexts know, to how often it came true in the block. Order 0
counts the block's ids so far, anew at fixed places; an id that it has not counted has its part of a rank prior, as
vocabularies number frequent ids first. A range coder codes each id by its interval. Every block starts from a
reset model and carries a CRC-32 of its header and ids, so any block can be read, and checked, alone.

A block is cut in STREAMS stretches of equal length, padded with id 0, that share one model: step t codes the t-th id
of every stretch, each in a code of its own, and then the model takes all of them in. A decoder takes the steps of
many blocks side by side, with numpy. An encoder knows all ids beforehand: what the contexts know at each of them
comes from sorts over the block, and only the range coder goes step by step. All of the model is integer
arithmetic, the same on every little-endian machine; the one division in floating point is exact at its size.

A block: header ``magic, ids, words, crc32`` as four little-endian unsigned 32-bit integers, then ``words`` of
them: the number of words of every stretch's code, as 16-bit integers, and these codes. No ids, no words.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

MAGIC = 0x33424354
BLOCK_IDS = 16384
#: Blocks that are coded side by side at most.
LANES = 512
STREAMS, _STREAM_BITS = 8, 3

_U = np.uint64
_TOTAL_BITS, _CLASS_BITS = 28, 16
_SCALE = _TOTAL_BITS - _CLASS_BITS
_LOW = _U(0xFFFFFFFF)
_SHIFT = _U(32)
_POSITION_BITS = 14
# What a slot holds is an id, a check of the context and, in two bits, the confidence in the id: id << 9 | check << 2 | confidence.
_SLOTS2_BITS, _SLOTS1_BITS = 14, 13
_CHECK, _ID = 0x1FC, 9
_CONFIDENT = 3
# No context has this check.
_EMPTY = 127 << 2
# Steps at which ids are counted anew, and at which the classes' shares are.
_COUNTED = (16, 48, 128, 384, 1024)
_SHARED = 128
# Combinations of confidences (order 2: 5, order 1: 6, its second: 3), each with five classes: a hit of order 2, of the first
# and second of order 1, an id that is counted, one that is not.
_STATES, _CLASSES = 90, 5


def _combinations() -> np.ndarray:
    """The combination by confidence in order 2 and order 1, whether they and the second of order 1 know the context, whether
    the first two agree, the second's confidence and whether it differs from order 2."""
    raw = np.arange(512)
    two, one, is2, is1, same, sure, other = (raw >> shift & most for shift, most in ((0, 3), (2, 3), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1)))
    return np.where(is2, two, 4) * 18 + np.where(is1, np.where(same, 4, one), 5) * 3 + other * (1 + sure)


_COMBINATIONS = _combinations()
# The class by whether order 2, the first and the second of order 1 and the counts have the id.
_KINDS = np.array([4 if not k else (k & -k).bit_length() - 1 for k in range(16)])
_STRENGTH = 24
_LEAST_COUNTED = 16


class CorruptBlock(ValueError):
    """A block whose header, length or checksum does not hold."""


@lru_cache(maxsize=4)
def _prior(largest: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of the rank prior, where each id's part of it begins, and the id of every place."""
    if largest >= 1 << 21:
        raise ValueError("ids are too large")
    size = largest + 1
    bits = max(18, size.bit_length() + 1)
    sums = np.cumsum(1 + (1 << 16) // (np.arange(size) + 512))
    cum = np.zeros(size + 1, dtype=np.int64)
    # Every id has a place of its own besides its share of the others.
    cum[1:] = (sums * ((1 << bits) - size)) // int(sums[-1]) + np.arange(1, size + 1)
    return bits, cum, np.repeat(np.arange(size, dtype=np.int32), np.diff(cum))


def _first_shares() -> np.ndarray:
    """Of every combination, the shares of the first three classes before anything is known, in 65536ths."""
    two, one, other = [0.3, 0.6, 0.8, 0.92, 0], [0.15, 0.25, 0.4, 0.5, 0, 0], [0, 0.08, 0.12]
    made = np.zeros((_STATES, 3), dtype=np.int64)
    for state in range(_STATES):
        a, b, c = two[state // 18], one[state // 3 % 6], other[state % 3]
        made[state] = [int(65536 * x) for x in (a, (1 - a) * b, (1 - a) * (1 - b) * c)]
    return made


_FIRST_SHARES = _first_shares()


class _Shares:
    """The classes' ends of every block and combination. A place is class * width + block * _STATES + combination."""

    def __init__(self, blocks: int, bits: int):
        self.least = max(64, 1 << bits - _SCALE)
        self.escape = max(512, 2 * self.least)
        self.width = blocks * _STATES
        self.seen = np.zeros((_CLASSES, self.width), dtype=np.int64)
        self.lately = np.zeros((2, blocks), dtype=np.int64)
        self.first = np.tile(_FIRST_SHARES.T, (1, blocks))

    def learn(self, places: np.ndarray) -> None:
        """Takes in the places of new ids."""
        new = np.bincount(places, minlength=self.seen.size).reshape(self.seen.shape)
        self.seen += new
        self.lately >>= 1
        self.lately += new[3:].reshape(2, -1, _STATES).sum(axis=2)

    def ends(self, counted: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the first four classes end, 16 bits each, of 65536; and start and size, 32 bits each, of every place."""
        seen = self.seen
        total = seen[0] + seen[1] + seen[2] + seen[3] + seen[4] + _STRENGTH
        ends = np.zeros((_CLASSES + 1, self.width), dtype=np.int64)
        for k in range(3):
            share = ((seen[k] << 16) + self.first[k] * _STRENGTH) // total
            ends[k + 1] = ends[k] + (1 + (share * (65536 - 4 - self.escape) >> 16)) * (self.first[k] > 0)
        ends[5] = 1 << _CLASS_BITS
        rest = escape = ends[5] - ends[3]
        if counted:
            counts, others = self.lately
            new = np.repeat(((others << 16) + 65536) // (counts + others + 2), _STATES)
            rest = np.minimum(np.maximum(escape * new >> 16, self.least), escape - _LEAST_COUNTED)
        ends[4] = ends[5] - rest
        packed = ends[1] | ends[2] << 16 | ends[3] << 32
        parts = ends[:-1] << 32 + _SCALE | (ends[1:] - ends[:-1]) << _SCALE
        return packed.astype(_U) | ends[4].astype(_U) << _U(48), parts.ravel()


def _renewals(step: int) -> tuple[bool, bool]:
    """Whether shares, and whether counts, are renewed before a step."""
    return step in (8, 16, 32) or (step > 0 and step % _SHARED == 0), step in _COUNTED


def _contexts(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slot and check of order 2 and of order 1; ids are 32 bits wide, and so is the arithmetic."""
    one = last.view(np.uint32) * np.uint32(0x9E3779B1)
    two = (one + before.view(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0x2545F491)
    checks = [np.minimum(x >> 7 & 127, 126).view(np.int32) << 2 for x in (two, one)]
    return two >> 32 - _SLOTS2_BITS, checks[0], one >> 32 - _SLOTS1_BITS, checks[1]


def _mask(is_: np.ndarray, kind: type = np.int32) -> np.ndarray:
    """-1 where true, else 0."""
    return -is_.astype(kind)


def _known(two: np.ndarray, one: np.ndarray, other: np.ndarray, check2: np.ndarray, check1: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ids that the contexts hold out (below 0: none), whether order 1 knows its context, and the combination."""
    is2, is1 = (two & _CHECK) == check2, (one & _CHECK) == check1
    isother = is1 & ((other & _CHECK) == check1)
    none2, none1, noother = (_mask(~x) for x in (is2, is1, isother))
    id2, id1, idother = two >> _ID | none2, one >> _ID | none1, other >> _ID | noother
    raw = (two & _CONFIDENT) | (one & _CONFIDENT) << 2
    for shift, is_ in ((4, is2), (5, is1), (6, id1 == id2), (7, (other & _CONFIDENT) > 0), (8, isother & (idother != id2))):
        raw |= is_.astype(np.int32) << shift
    return id2, id1, idother, is1, _COMBINATIONS.take(raw.astype(np.intp))


def _narrow(low: np.ndarray, span: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Narrows the lanes' ranges in place to an interval of _TOTAL_BITS; the lanes whose highest word is settled."""
    unit = span >> _U(_TOTAL_BITS)
    low += unit * start
    np.multiply(unit, size, out=span)
    out = np.flatnonzero(span < _U(1 << 32))
    span[out] = np.minimum(span[out], _U(1 << 32) - (low[out] & _LOW)) << _SHIFT
    return out


def _crc(head: np.ndarray, ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes(), zlib.crc32(head[:3].tobytes()))


def _order(lengths: list[int]) -> tuple[list[int], np.ndarray]:
    """Blocks by descending length, and the number of blocks that have each step."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    steps = np.array([-(-lengths[i] // STREAMS) for i in order])
    return order, np.array([np.count_nonzero(steps > t) for t in range(int(steps[0]) if len(steps) else 0)], dtype=np.int64)


def _before(slot: np.ndarray, check: np.ndarray, ids: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """What the slot of every id (in order of steps) holds before its step, and what it held before that.

    Of the ids of one step, the last one stays in a slot."""
    n = len(ids)
    # Slot, place (step and stretch), id, check.
    key = slot.astype(np.int64) << 42 | np.arange(n) << 28 | ids.astype(np.int64) << 7 | check >> 2
    key.sort()
    place = key >> 28 & (1 << _POSITION_BITS) - 1
    step = key >> 28 + _STREAM_BITS
    last = np.flatnonzero(np.append(step[1:] != step[:-1], True))
    stays = key.take(last)
    held = (stays & (1 << 28) - 1).astype(np.int32)
    where = (stays >> 42).astype(np.int32)
    ahead = where[1:] == where[:-1]
    same = np.append(False, ahead & (held[1:] == held[:-1]))
    twice = same[2:] & same[1:-1]
    confidence = same.astype(np.int32)
    confidence[2:] += twice
    confidence[3:] += twice[1:] & same[1:-2]
    held = held << 2 | confidence
    # The state before a group of one slot and step is the one after the group ahead of it, if that has the same slot.
    groups = np.diff(last, prepend=-1)
    shut = _mask(~ahead)

    def spread(after: np.ndarray) -> np.ndarray:
        state = np.empty(len(held), dtype=np.int32)
        state[0], state[1:] = _EMPTY, (after[:-1] & ~shut) | (_EMPTY & shut)
        made = np.empty(n, dtype=np.int32)
        made[place] = np.repeat(state, groups)
        return made

    if not second:
        return spread(held), None
    # Where a run of one id in a slot begins, what ended there is the second from then on, if its context is the same.
    begins = np.flatnonzero(~same)
    ended = held[begins - 1]
    fits = ((ended ^ held[begins]) & _CHECK == 0) & (where[begins - 1] == where[begins]) & (begins > 0)
    found = np.where(fits, ended, np.int32(_EMPTY))
    return spread(held), spread(np.repeat(found, np.diff(begins, append=len(held))))


def _counted(ids: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> None:
    """Sets the part of every id among the ids counted before it: from ``low`` to ``high``, scaled to so many bits."""
    n = len(ids)
    key = ids.astype(np.int64) << _POSITION_BITS | np.arange(n)
    key.sort()
    id_ = key >> _POSITION_BITS
    opens = np.flatnonzero(np.append(True, id_[1:] != id_[:-1]))
    group = np.empty(n, dtype=np.intp)
    group[key & (1 << _POSITION_BITS) - 1] = np.repeat(np.arange(len(opens)), np.diff(opens, append=n))
    renewed = [0, *[t * STREAMS for t in _COUNTED if t * STREAMS < n], n]
    sums, counts = np.zeros(len(opens) + 1, dtype=np.int64), np.zeros(len(opens), dtype=np.int64)
    for before, begin, end in zip(renewed, renewed[1:], renewed[2:], strict=False):
        counts += np.bincount(group[before:begin], minlength=len(opens))
        np.cumsum(counts, out=sums[1:])
        scaled = (sums << bits) // begin
        of = group[begin:end]
        low[begin:end], high[begin:end] = scaled.take(of), scaled[1:].take(of)


class _Lanes:
    """What an encoder knows beforehand of every step (row) and stretch of blocks: combination and class, and the part."""

    def __init__(self, steps: int, lanes: int):
        self.width = lanes // STREAMS * _STATES
        self.place = np.zeros((steps, lanes), dtype=np.int32)
        self.low, self.high = np.zeros((steps, lanes), dtype=np.uint32), np.zeros((steps, lanes), dtype=np.uint32)

    def put(self, block: int, ids: np.ndarray, bits: int, cum: np.ndarray) -> None:
        steps = -(-len(ids) // STREAMS)
        own = np.zeros(steps * STREAMS, dtype=np.int32)
        own[: len(ids)] = ids
        own = np.ascontiguousarray(own.reshape(STREAMS, steps).T)
        last, before = np.zeros_like(own), np.zeros_like(own)
        last[1:], before[2:] = own[:-1], own[:-2]
        now = own.ravel()
        slot2, check2, slot1, check1 = _contexts(last.ravel(), before.ravel())
        two, _ = _before(slot2, check2, now, False)
        one, other = _before(slot1, check1, now, True)
        id2, id1, idother, _, state = _known(two, one, other, check2, check1)
        low, high = np.zeros(len(now), dtype=np.uint32), np.zeros(len(now), dtype=np.uint32)
        _counted(now, low, high, bits)
        has = [x.view(np.uint8) << k for k, x in enumerate((now == id2, now == id1, now == idother, high > low))]
        kind = _KINDS.take((has[0] | has[1] | has[2] | has[3]).astype(np.intp))
        new, hit = np.flatnonzero(kind == 4), np.flatnonzero(kind < 3)
        ids = now[new]
        low[new], high[new] = cum[ids], cum[ids + 1]
        low[hit], high[hit] = 0, 1 << bits
        columns = slice(block * STREAMS, (block + 1) * STREAMS)
        self.place[:steps, columns] = (state + block * _STATES + kind * self.width).reshape(steps, STREAMS)
        self.low[:steps, columns], self.high[:steps, columns] = low.reshape(steps, STREAMS), high.reshape(steps, STREAMS)


def _groups(n: int) -> list[tuple[int, int]]:
    """Even runs of at most LANES blocks."""
    runs = -(-n // LANES)
    return [(n * k // runs, n * (k + 1) // runs) for k in range(runs)]


def encode(blocks: list[np.ndarray], largest: int = 65535) -> list[bytes]:
    """The blocks' bytes. A block is an array of at most BLOCK_IDS ids of 0 to ``largest`` (below 2**21)."""
    if any(len(b) > BLOCK_IDS for b in blocks):
        raise ValueError("a block has too many ids")
    bits, cum, _ = _prior(largest)
    made: list[bytes] = []
    for from_, to in _groups(len(blocks)):
        group = [np.asarray(b) for b in blocks[from_:to]]
        if any(len(b) and (int(b.min()) < 0 or int(b.max()) > largest) for b in group):
            raise ValueError("an id is too large")
        made += _encode(group, bits, cum)
    return made


def _encode(group: list[np.ndarray], bits: int, cum: np.ndarray) -> list[bytes]:
    order, active = _order([len(b) for b in group])
    n, steps = len(group), len(active)
    known = _Lanes(steps, n * STREAMS)
    for lane, i in enumerate(order):
        if len(group[i]):
            known.put(lane, group[i], bits, cum)
    shares = _Shares(n, bits)
    low, span = np.zeros(n * STREAMS, dtype=_U), np.full(n * STREAMS, 0xFFFFFFFFFFFFFFFF, dtype=_U)
    words, used = np.zeros((n * STREAMS, steps + 1), dtype="<u4"), np.zeros(n * STREAMS, dtype=np.int64)
    begin, count = 0, 0
    renewed = [t for t in range(1, steps) if any(_renewals(t))]
    for end in [*renewed, steps] if steps else []:
        _, parts = shares.ends(count > 0)
        for t in range(begin, end):
            k = int(active[t]) * STREAMS
            start, size = _within(parts.take(known.place[t, :k].astype(np.intp)), known.low[t, :k].astype(np.int64), known.high[t, :k].astype(np.int64), bits)
            out = _narrow(low[:k], span[:k], start, size)
            words[out, used[out]] = low[out] >> _SHIFT
            used[out] += 1
            low[out] <<= _SHIFT
        if end < steps:
            m = int(active[end])
            shares.learn(known.place[begin:end, : m * STREAMS].ravel())
            count = end * STREAMS if _renewals(end)[1] else count
        begin = end
    # One word more names a number inside the range; what follows it reads as zeros.
    last = np.arange(n * STREAMS)
    words[last, used] = (low + _LOW) >> _SHIFT
    used += 1
    made = [b""] * n
    for lane, i in enumerate(order):
        ids, own = group[i], range(lane * STREAMS, (lane + 1) * STREAMS)
        code = used[own.start : own.stop].astype("<u2").tobytes() + b"".join(words[k, : used[k]].tobytes() for k in own) if len(ids) else b""
        head = np.array([MAGIC, len(ids), len(code) // 4, 0], dtype="<u4")
        head[3] = _crc(head, ids.astype("<u4"))
        made[i] = head.tobytes() + code
    return made


def _within(parts: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of what lies from ``low`` to ``high`` in packed parts of the whole, as unsigned 64-bit integers."""
    size = parts & 0xFFFFFFFF
    first = size * low >> bits
    return ((parts >> 32) + first).view(_U), ((size * high >> bits) - first).view(_U)


def decode(blocks: list[bytes], largest: int = 65535) -> list[np.ndarray]:
    """The ids of every block, as little-endian unsigned 32-bit arrays; CorruptBlock where one fails its checks."""
    made: list[np.ndarray] = []
    for from_, to in _groups(len(blocks)):
        made += _decode(blocks[from_:to], largest)
    return made


class _Codes:
    """The words of all stretches, each behind the other with zeros between."""

    def __init__(self, group: list[bytes], order: list[int]):
        parts, at, begins = [], 0, []
        zeros = bytes(8)
        for i in order:
            body = memoryview(group[i])[16:]
            sizes = np.frombuffer(body[: 2 * STREAMS], dtype="<u2").tolist() if len(body) else [0] * STREAMS
            if len(body) and 4 * sum(sizes) + 2 * STREAMS != len(body):
                raise CorruptBlock("length")
            from_ = 2 * STREAMS
            for n in sizes:
                parts += [body[from_ : from_ + 4 * n], zeros]
                begins.append(at)
                from_, at = from_ + 4 * n, at + n + 2
        self.words = np.frombuffer(b"".join(parts), dtype="<u4").astype(np.uint32)
        self.at = np.array(begins, dtype=np.int64)
        self.last = len(self.words) - 1

    def next(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] = at + 1
        return self.words[np.minimum(at, self.last)].astype(_U)


def _tables(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Of every place among the counted ids (steps by lanes) of a block: the id there, and where its part begins and ends."""
    rows = np.sort(ids.reshape(len(ids), blocks, STREAMS).transpose(1, 0, 2).reshape(blocks, -1), axis=1)
    n = rows.shape[1]
    opens = np.ones(rows.shape, dtype=bool)
    np.not_equal(rows[:, 1:], rows[:, :-1], out=opens[:, 1:])
    begins = np.flatnonzero(opens)
    sizes = np.diff(begins, append=rows.size)
    low = begins % n
    return np.repeat(rows.ravel()[begins].astype(np.int64) << 32 | low << 16 | low + sizes, sizes)


def _decode(group: list[bytes], largest: int) -> list[np.ndarray]:
    heads = []
    for block in group:
        head = np.frombuffer(block[:16], dtype="<u4")
        if len(head) < 4 or head[0] != MAGIC or int(head[1]) > BLOCK_IDS or len(block) != 16 + 4 * int(head[2]) or (head[1] > 0) != (head[2] > 0):
            raise CorruptBlock("header or length")
        heads.append(head)
    order, active = _order([int(h[1]) for h in heads])
    n, steps = len(group), len(active)
    bits, cum, places = _prior(largest)
    codes, shares = _Codes(group, order), _Shares(n, bits)
    lanes = np.arange(n * STREAMS)
    low, span = np.zeros(len(lanes), dtype=_U), np.full(len(lanes), 0xFFFFFFFFFFFFFFFF, dtype=_U)
    code = (codes.next(lanes) << _SHIFT) | codes.next(lanes)
    block = lanes >> _STREAM_BITS
    row2, row1, first = block << _SLOTS2_BITS, block << _SLOTS1_BITS, block * _STATES
    slots2 = np.full(n << _SLOTS2_BITS, _EMPTY, dtype=np.int32)
    slots1 = np.full(n << _SLOTS1_BITS, _EMPTY << 32 | _EMPTY, dtype=np.int64)
    ids, seen = np.zeros((steps + 2, len(lanes)), dtype=np.int32), np.zeros((_SHARED, len(lanes)), dtype=np.int32)
    (ends, parts), count, begin = shares.ends(False), 0, 0
    table, whole = np.zeros(0, dtype=np.int64), 1 << bits
    for t in range(steps):
        k = int(active[t]) * STREAMS
        share, counted = _renewals(t)
        if counted:
            count = t * STREAMS
            table = _tables(ids[2 : t + 2, :k], k // STREAMS).ravel()
            rows = block[:k] * count
        if share or counted:
            shares.learn(seen[: t - begin, :k].ravel())
            (ends, parts), begin = shares.ends(count > 0), t
        slot2, check2, slot1, check1 = _contexts(ids[t + 1, :k], ids[t, :k])
        at2, at1 = row2[:k] + slot2, row1[:k] + slot1
        two, both = slots2.take(at2), slots1.take(at1).view(np.int32)
        one, other = np.ascontiguousarray(both[::2]), np.ascontiguousarray(both[1::2])
        id2, id1, idother, is1, state = _known(two, one, other, check2, check1)
        state += first[:k]
        value = np.minimum((code[:k] - low[:k]) // (span[:k] >> _U(_TOTAL_BITS)), _U((1 << _TOTAL_BITS) - 1)).view(np.int64)
        end = ends.take(state).view(np.uint16)
        part = (value >> _SCALE).astype(np.uint16)
        past = [part >= end[c::4] for c in range(4)]
        kind = past[0].view(np.uint8) + past[1].view(np.uint8) + past[2].view(np.uint8) + past[3].view(np.uint8)
        place = kind * np.int64(shares.width)
        place += state
        seen[t - begin, :k] = place
        own = parts.take(place)
        now = id2 + (id1 - id2 & _mask(past[0])) + (idother - id1 & _mask(past[1]))
        from_, to = np.zeros(k, dtype=np.int64), np.full(k, whole)
        # The last place whose scaled begin is not above the value: a quotient below 2**23 of numbers below 2**52, by
        # one below 2**29, so that a rounded one is never the next integer.
        inside = (((value - (own >> 32) + 1 << bits) - 1) / (own & 0xFFFFFFFF)).astype(np.int64)
        if count:
            entry = table.take(rows[:k] + ((inside + 1) * count - 1 >> bits))
            old = past[2] & ~past[3]
            narrow, wide = _mask(old), _mask(old, np.int64)
            now += (entry >> 32).astype(np.int32) - now & narrow
            from_ = ((entry >> 16 & 0xFFFF) << bits) // count & wide
            to += ((entry & 0xFFFF) << bits) // count - whole & wide
        new = np.flatnonzero(past[3])
        found = places[inside[new]]
        now[new], from_[new], to[new] = found, cum[found], cum[found + 1]
        ids[t + 2, :k] = now
        settled = _narrow(low[:k], span[:k], *_within(own, from_, to, bits))
        low[settled] <<= _SHIFT
        code[settled] = code[settled] << _SHIFT | codes.next(settled)
        fresh = now << _ID
        slots2[at2] = (np.minimum((two & _CONFIDENT) + 1, _CONFIDENT) & _mask(now == id2)) + fresh + check2
        hit = _mask(now == id1)
        later = (np.minimum((one & _CONFIDENT) + 1, _CONFIDENT) & hit) + fresh + check1
        known = _mask(is1) & ~hit
        earlier = (other & hit) | (one & known) | (_EMPTY & ~(hit | known))
        slots1[at1] = earlier.astype(np.int64) << 32 | later
    made = [np.zeros(0, dtype="<u4")] * n
    for lane, i in enumerate(order):
        length = int(heads[i][1])
        own = ids[2 : 2 + -(-length // STREAMS), lane * STREAMS : (lane + 1) * STREAMS]
        found = np.ascontiguousarray(own.T).ravel()[:length].astype("<u4")
        if _crc(heads[i], found) != int(heads[i][3]):
            raise CorruptBlock("checksum")
        made[i] = found
    return made
