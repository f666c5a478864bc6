"""Weighted acyclic automata that map phrases of up to ``depth`` words to counts.

In memory an automaton is unrolled into levels of arcs, sorted by parent and label: arc ``i`` of level d stands
for one phrase of d words, ``labels[d-1][i]`` is its last word, ``parents[d-1][i]`` the arc of its first d - 1 words,
``weights[d-1][i]`` its count (0: no phrase of this automaton, only a way to one). Words are numbers into the
sorted ``symbols``, so that levels are in the order of the phrases' words.

Packed, states that accept the same rest with the same counts are one state: from the longest phrases back,
a state is registered by its arcs and every later equal one points to the registered one.

Nothing here knows Spark; an automaton of no phrases is fine everywhere, and counts are exact below 2**63.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textarrays import mix

_U = np.uint64


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All the places of runs, one run after another."""
    stops = np.cumsum(size)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin - stops + size, size)


def _keys(parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return (parents << 32) | labels


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each input went, and exact sums of the weights."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    opens = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, dtype=bool)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(opens) - 1
    return ordered[opens], place, np.add.reduceat(weights[order], np.flatnonzero(opens)) if len(keys) else weights


@dataclass
class CountAutomaton:
    symbols: pa.Array
    labels: list[np.ndarray]
    parents: list[np.ndarray]
    weights: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.labels)

    @property
    def arcs(self) -> int:
        return sum(map(len, self.labels))

    @classmethod
    def of_words(cls, words: pa.Array, ends: np.ndarray, depth: int) -> CountAutomaton:
        """All runs of up to ``depth`` words that do not go over an end (``ends``: the word is the last of its piece; the last of all is)."""
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ids = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
        counts = np.bincount(ids, minlength=len(order))
        labels, parents, weights = [np.arange(len(order))], [np.zeros(len(order), dtype=np.int64)], [counts]
        arc, start = ids, np.arange(len(ids))
        for step in range(1, depth):
            goes = ~ends[start + step - 1]
            arc, start = arc[goes], start[goes]
            keys, arc, sums = _summed(_keys(arc, ids[start + step]), np.ones(len(start), dtype=np.int64))
            labels.append(keys & 0xFFFFFFFF)
            parents.append(keys >> 32)
            weights.append(sums)
        return cls(coded.dictionary.take(order), labels, parents, weights)

    @classmethod
    def union(cls, several: list[CountAutomaton]) -> CountAutomaton:
        """The automaton of all phrases, with the sums of their counts."""
        if len(several) == 1:
            return several[0]
        every = pa.concat_arrays([a.symbols for a in several]).unique()
        symbols = every.take(pc.sort_indices(every))
        number = [pc.index_in(a.symbols, value_set=symbols).to_numpy(zero_copy_only=False).astype(np.int64) for a in several]
        above = [np.zeros(1, dtype=np.int64)] * len(several)
        made = cls(symbols, [], [], [])
        for d in range(several[0].depth):
            keys = np.concatenate([_keys(up[a.parents[d]], to[a.labels[d]]) for a, up, to in zip(several, above, number, strict=True)])
            keys, place, sums = _summed(keys, np.concatenate([a.weights[d] for a in several]))
            made.labels.append(keys & 0xFFFFFFFF)
            made.parents.append(keys >> 32)
            made.weights.append(sums)
            cuts = np.cumsum([len(a.labels[d]) for a in several])[:-1]
            above = np.split(place, cuts)
        return made

    def bounds(self, cuts: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Where a sorted list of first and second words lies among this automaton's pairs of symbols."""
        names, made = self.symbols.to_pylist(), []
        for one, two in cuts:
            at = bisect_left(names, one)
            same = at < len(names) and names[at] == one
            # A phrase of one word lies before all that go on from it.
            made.append(at << 32 | (bisect_left(names, two) + 1 if same and two else 0))
        return np.array(made, dtype=np.int64)

    def cut(self, bounds: np.ndarray) -> list[tuple[int, CountAutomaton]]:
        """The automata of the prefix ranges between ``bounds``; a phrase lies where its first two words do."""
        single = np.searchsorted(bounds, self.labels[0] << 32, side="right")
        pair = np.searchsorted(bounds, (self.labels[0][self.parents[1]] << 32) + self.labels[1] + 1, side="right")
        made = []
        for r in np.union1d(single, pair):
            i, j = np.searchsorted(pair, [r, r + 1])
            own = np.flatnonzero(single == r)
            low = min([*own[:1], *self.parents[1][i : i + 1]])
            high = max([*own[-1:], *(self.parents[1][j - 1 : j] if j > i else [])]) + 1
            labels, parents = [self.labels[0][low:high]], [np.zeros(high - low, dtype=np.int64)]
            weights = [np.where(single[low:high] == r, self.weights[0][low:high], 0)]
            first = low
            for d in range(1, self.depth):
                if d > 1:
                    i, j = np.searchsorted(self.parents[d], [i, j])
                labels.append(self.labels[d][i:j])
                parents.append(self.parents[d][i:j] - first)
                weights.append(self.weights[d][i:j])
                first = i
            made.append((int(r), CountAutomaton(self.symbols, labels, parents, weights)._compact()))
        return made

    def _compact(self) -> CountAutomaton:
        """Without symbols that no arc has."""
        used = np.unique(np.concatenate(self.labels))
        labels = [np.searchsorted(used, x) for x in self.labels]
        return CountAutomaton(self.symbols.take(pa.array(used)), labels, self.parents, self.weights)

    def at_least(self, least: int) -> CountAutomaton:
        """Only the phrases with such a count, and the ways to them."""
        keep = [w >= least for w in self.weights]
        for d in range(self.depth - 1, 0, -1):
            keep[d - 1][self.parents[d][keep[d]]] = True
        labels, parents, weights = [], [], []
        place = np.zeros(1, dtype=np.int64)
        for d in range(self.depth):
            k = keep[d]
            labels.append(self.labels[d][k])
            parents.append(place[self.parents[d][k]])
            weights.append(np.where(self.weights[d][k] >= least, self.weights[d][k], 0))
            place = np.cumsum(k) - 1
        return CountAutomaton(self.symbols, labels, parents, weights)._compact()

    def words(self, d: int) -> np.ndarray:
        """The words of every phrase of level d (from 1), as numbers, one row a phrase."""
        made, at = np.empty((len(self.labels[d - 1]), d), dtype=np.int64), np.arange(len(self.labels[d - 1]))
        for level in range(d - 1, -1, -1):
            made[:, level] = self.labels[level][at]
            at = self.parents[level][at]
        return made

    def phrases(self, words: np.ndarray) -> pa.Array:
        """Phrases from their words' numbers, joined by blanks."""
        named = [self.symbols.take(pa.array(words[:, i])) for i in range(words.shape[1])]
        return pc.binary_join_element_wise(*named, pa.scalar(b" ", pa.binary())) if len(named) > 1 else named[0]

    def composed(self, asked: pa.Array) -> np.ndarray:
        """The counts of asked phrases (0: none): the phrases' automaton and this one are walked together, arc by arc.

        Asked phrases are binary, their words joined by single blanks."""
        split = pc.split_pattern(asked.cast(pa.binary()), b" ")
        size = np.diff(split.offsets.to_numpy())
        number = pc.index_in(split.flatten(), value_set=self.symbols)
        number = number.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        found, live, arc = np.zeros(len(asked), dtype=np.int64), np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64)
        for d in range(self.depth):
            label = number[begin[live] + d]
            keys = _keys(self.parents[d], self.labels[d])
            want = _keys(arc, np.maximum(label, 0))
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            meets = (keys[at] == want) & (label >= 0) if len(keys) else np.zeros(len(live), dtype=bool)
            live, arc = live[meets], at[meets]
            last = size[live] == d + 1
            found[live[last]] = self.weights[d][arc[last]]
            live, arc = live[~last], arc[~last]
        return found

    def packed(self) -> bytes:
        """Bytes of the automaton with equal states shared."""
        arrays = [pc.binary_length(self.symbols).to_numpy(zero_copy_only=False).astype(np.int64)]
        text = b"".join(self.symbols.to_pylist())
        target = np.zeros(len(self.labels[-1]), dtype=np.int64)
        for d in range(self.depth - 1, 0, -1):
            size = np.bincount(self.parents[d], minlength=len(self.labels[d - 1]))
            begin = np.cumsum(size) - size
            state, kept = _register(self.labels[d], self.weights[d], target, begin, size)
            spots = runs(begin[kept], size[kept])
            arrays += [self.labels[d][spots], self.weights[d][spots], target[spots], size[kept]]
            target = state
        arrays += [self.labels[0], self.weights[0], target]
        body = [np.array([self.depth, len(text), *map(len, arrays)], dtype="<i8").tobytes(), text]
        for x in arrays:
            wide = len(x) > 0 and int(x.max()) >> 32 > 0
            body.append(bytes([8 if wide else 4]) + np.ascontiguousarray(x.astype("<u8" if wide else "<u4").view(np.uint8).reshape(-1, 8 if wide else 4).T).tobytes())
        raw = b"".join(body)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, blob: bytes) -> CountAutomaton:
        raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        depth, chars = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        sizes = np.frombuffer(raw, "<i8", 4 * depth, 16)
        at = 16 + 8 * len(sizes)
        text, at, arrays = raw[at : at + chars], at + chars, []
        for n in sizes:
            bytes_each = raw[at]
            planes = np.frombuffer(raw, np.uint8, n * bytes_each, at + 1).reshape(bytes_each, n)
            arrays.append(np.ascontiguousarray(planes.T).view(f"<u{bytes_each}").ravel().astype(np.int64))
            at += 1 + int(n) * bytes_each
        offsets = np.r_[0, np.cumsum(arrays[0])].astype(np.int32)
        symbols = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        label, weight, target = arrays[-3:]
        made = cls(symbols, [label], [np.zeros(len(label), dtype=np.int64)], [weight])
        for d in range(1, depth):
            labels, weights, targets, size = arrays[1 + 4 * (depth - 1 - d) : 5 + 4 * (depth - 1 - d)]
            begin = np.cumsum(size) - size
            live = np.flatnonzero(target)
            state = target[live] - 1
            spots = runs(begin[state], size[state])
            made.labels.append(labels[spots])
            made.parents.append(np.repeat(live, size[state]))
            made.weights.append(weights[spots])
            target = targets[spots]
        return made


def _register(labels: np.ndarray, weights: np.ndarray, targets: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every slice of arcs its state's number (from 1; 0: no arcs) and the slices kept as states, in that order.

    Slices are grouped by a hash of their arcs and compared in full with the first of their group; one that only
    shares its hash becomes a state of its own."""
    live = np.flatnonzero(size)
    state = np.zeros(len(size), dtype=np.int64)
    if not len(live):
        return state, live
    place = runs(np.zeros(len(live), dtype=np.int64), size[live])
    arc = mix(mix(mix(labels.astype(_U)) + weights.astype(_U)) + targets.astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U))
    digest = mix(np.add.reduceat(arc, begin[live]) + size[live].astype(_U))
    _, first, group = np.unique(digest, return_index=True, return_inverse=True)
    like = live[first[group]]
    same = size[live] == size[like]
    pairs = np.flatnonzero(same & (like != live))
    mine, theirs = runs(begin[live[pairs]], size[live[pairs]]), runs(begin[like[pairs]], size[live[pairs]])
    differs = (labels[mine] != labels[theirs]) | (weights[mine] != weights[theirs]) | (targets[mine] != targets[theirs])
    if len(pairs):
        edge = np.cumsum(size[live[pairs]]) - size[live[pairs]]
        same[pairs] = ~np.logical_or.reduceat(differs, edge)
    owner = np.where(same, like, live)
    kept = np.unique(owner)
    state[live] = np.searchsorted(kept, owner) + 1
    return state, kept
