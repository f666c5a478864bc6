"""Words and rolling hashes of many texts at once, as numpy arrays over Arrow buffers.

A text is treated as its UTF-8 bytes. White space is the six ASCII characters 0x20 and 0x09-0x0D, so
splitting bytes and splitting code points give the same words. Hashes are 64-bit: a polynomial over a
random value per byte, modulo 2**64, finished with a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, dtype=_U), np.ones(1, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, kept up to one slice."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, SLICE_BYTES + 1)
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if size <= 4 * SLICE_BYTES:
        _powers = (made[0], made[1])
    return made[0][:n], made[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about SLICE_BYTES: first row, end row, bytes, offsets from 0."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte value times power, and the inverse powers, both of length n + 1."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE_VALUE[data] * power[:-1], out=sums[1:])
    return sums, inverse


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (n + 1 entries).

    ``apart`` tells for each byte value whether it lies between words (white space)."""
    solid = ~apart[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = solid[inner]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = solid[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the first word of every text (n + 1 entries)."""
    if lower:
        data = _LOWER[data]
    starts, ends, firsts = word_bounds(data, offsets)
    sums, inverse = prefix_hash(data)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U)), firsts


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive entries (runs over text ends are not told apart)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = words[:n].copy()
    for j in range(1, width):
        total += words[j : j + n] * _U(pow(_BASE, j, 1 << 64))
    return mix(total)


def shingle_sets(column: pa.Array, width: int, lower: bool) -> Iterator[np.ndarray]:
    """For each text its sorted distinct word shingles. A text of fewer than ``width`` words has its
    whole word sequence as the only shingle; a text without words has none."""
    data, offsets = utf8(column)
    for first, end, part, bounds in slices(data, offsets):
        words, firsts = word_hashes(part, bounds, lower)
        grams = gram_hashes(words, width)
        for row in range(end - first):
            a, b = firsts[row], firsts[row + 1]
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield gram_hashes(words[a:b], int(b - a)) ^ _U(b - a)
            else:
                yield words[:0]


def sliding_argmin(keys: np.ndarray, window: int) -> np.ndarray:
    """For every window of consecutive entries the index of its leftmost smallest entry."""
    n = len(keys) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    best, where, span = keys, np.arange(len(keys), dtype=np.int32), 1
    while span < window:
        step = min(span, window - span)
        left, right = best[: len(best) - step], best[step:]
        later = right < left
        best = np.where(later, right, left)
        where = np.where(later, where[step:], where[: len(where) - step])
        span += step
    return where


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    bounds = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), values)
