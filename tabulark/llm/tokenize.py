"""Exact token ids of whole texts by the tokenizers library, with repeated work remembered.

The vocabularies split a text at white space, and then into runs of letters, digits and signs, before
any merge; a text's ids are the concatenation of its parts' ids. Many texts are split at once with numpy,
over one byte a character (Latin-1). A part of at most 16 characters is looked up by its exact bytes, all
parts of a slice together, in a table that the worker keeps; longer parts, and words with other characters
or an apostrophe, are looked up as strings. Only what is new goes to the library. The tables change no
result: the older half is forgotten when they are full. Texts with white space beyond Latin-1 or an added
token take a plainer path, piece by piece.

A vocabulary's added tokens (``<|endoftext|>`` and the like) are the library's by default, wherever a text
holds their content: the text is cut at them first, as the library does, and each stretch between is a text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from .textarrays import mix

# The white space of Unicode, as the vocabularies' split patterns see it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
# Fixed value: the split pattern that byte-level vocabularies leave unsaid in their files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_ENTRIES = 100_000
LONGEST_PIECE = 200
# Slots of a worker's table, a power of two; a new one is begun when half are taken.
TABLE_SLOTS = 1 << 21
LONGEST_KEY = 16
SLICE_CHARS, UNITS_AT_ONCE = 1 << 20, 1 << 18

_double = re.compile(f"[{WHITE_SPACE}]{{2}}")
_pieces = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")


_wide_white = np.array([ord(c) for c in WHITE_SPACE if ord(c) > 255], dtype=np.uint32)
_WHITE, _LETTER, _DIGIT, _SIGN = range(4)
_U = np.uint64
_ones = (1 << 64) - 1
# What of a key's two 8-byte words belongs to a part of n characters.
_LOW_MASK = np.array([_ones if n >= 8 else (1 << 8 * n) - 1 for n in range(LONGEST_KEY + 1)], dtype=_U)
_HIGH_MASK = np.array([0 if n <= 8 else (1 << 8 * (n - 8)) - 1 for n in range(LONGEST_KEY + 1)], dtype=_U)


def _visible() -> dict[int, int]:
    """Byte-level vocabularies write a byte as itself if it prints, else as the next character from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(prints)))}


_VISIBLE = _visible()


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Memo:
    """Two generations of a dictionary of at most ``entries`` each."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        self.young: dict = {}
        self.old: dict = {}
        self.entries = entries

    def find(self, keys: list) -> tuple[list, list]:
        """The values, None where unknown, and the distinct unknown keys."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found, []
        absent = []
        for key in {k for k, v in zip(keys, found, strict=True) if v is None}:
            value = self.old.get(key)
            if value is None:
                absent.append(key)
            else:
                self.young[key] = value
        return found, absent

    def learn(self, items: dict) -> None:
        if len(self.young) + len(items) > self.entries:
            self.old, self.young = self.young, {}
        self.young.update(items)

    def all(self, keys: list, make) -> list:
        """The values of all keys; ``make`` turns a list of unknown keys into a dictionary."""
        found, absent = self.find(keys)
        if None not in found:
            return found
        new = make(absent) if absent else {}
        young, old = self.young, self.old
        found = [v if v is not None else new[k] if k in new else young[k] if k in young else old[k] for k, v in zip(keys, found, strict=True)]
        self.learn({k: v for k, v in new.items() if len(k) <= LONGEST_PIECE})
        return found


def keys(words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first LONGEST_KEY bytes of every part, in two words of 8; ``words`` are padded by two words."""
    word, shift = at >> 3, ((at & 7) << 3).astype(_U)
    back, size = _U(63) - shift, np.minimum(sizes, LONGEST_KEY)
    middle = words[word + 1]
    low = (words[word] >> shift | (middle << _U(1)) << back) & _LOW_MASK[size]
    return low, (middle >> shift | (words[word + 2] << _U(1)) << back) & _HIGH_MASK[size]


class Table:
    """Ids of parts, found by their bytes (two words of 8, padded with zeros), many parts at a time."""

    def __init__(self, slots: int = TABLE_SLOTS):
        self.low, self.high, self.entry = np.zeros(slots, dtype=_U), np.zeros(slots, dtype=_U), np.full(slots, -1, dtype=np.int32)
        self.begin, self.count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype="<u4")
        self.entries = self.used = 0
        self.shift, self.last = _U(64 - (slots - 1).bit_length()), slots - 1

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of every key, -1 where there is none."""
        slot = self._slot(low, high)
        entry = self.entry[slot]
        other = np.flatnonzero((entry >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(other):
            slot[other] = at = (slot[other] + 1) & self.last
            entry[other] = found = self.entry[at]
            other = other[(found >= 0) & ((self.low[at] != low[other]) | (self.high[at] != high[other]))]
        return entry

    def add(self, low: np.ndarray, high: np.ndarray, ids: list[bytes]) -> None:
        """Distinct keys that the table does not have, and their ids."""
        entry = np.arange(self.entries, self.entries + len(ids), dtype=np.int32)
        counts = np.array([len(x) >> 2 for x in ids], dtype=np.int64)
        while self.entries + len(ids) > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        self.begin[entry], self.count[entry] = self.used + np.cumsum(counts) - counts, counts
        self.used = self.put(self.used, b"".join(ids))
        self.entries += len(ids)
        slot, left = self._slot(low, high), np.arange(len(ids))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            chosen = free[np.unique(slot[free], return_index=True)[1]]
            at = slot[chosen]
            self.entry[at], self.low[at], self.high[at] = entry[chosen], low[chosen], high[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.last

    def put(self, at: int, ids: bytes) -> int:
        """Writes ids behind the ones in use and returns where they end."""
        end = at + (len(ids) >> 2)
        while end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[at:end] = np.frombuffer(ids, dtype="<u4")
        return end


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, content: bytes | None = None):
        """The vocabulary is the file at ``path``, or ``content`` where its bytes are at hand."""
        import regex
        from tokenizers import Tokenizer

        content = Path(path).read_bytes() if content is None else content
        self.tokenizer = Tokenizer.from_buffer(content)
        self.model = self.tokenizer.model
        whole = json.loads(content)
        says, added = whole["pre_tokenizer"], whole["added_tokens"]
        self.added = {t["content"]: _packed([t["id"]]) for t in added}
        # The longest of those that begin at one place comes first, as in the library.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        # Tokens that take in white space, want a word's edge or are sought in normalised text are left to the library.
        self.plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        split = next((x for x in says.get("pretokenizers", []) if x["type"] == "Split" and x["behavior"] == "Removed"), None)
        self.drops_space = split is not None
        self.parts = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL_PATTERN)
        self.pieces, self.known, self.units = Memo(), Memo(), Memo()
        self.young, self.old = Table(), Table(1 << 10)
        lower = [chr(i).lower() if self.drops_space else chr(i) for i in range(256)]
        self.folded = np.array([ord(c) for c in lower], dtype=np.uint8)
        kinds = {_WHITE: f"[{WHITE_SPACE}]", _LETTER: r"\p{L}", _DIGIT: r"\p{N}", _SIGN: r"."}
        self.kind = np.array([next(k for k, p in kinds.items() if regex.match(p, c, regex.DOTALL)) for c in lower], dtype=np.uint8)

    def _alone(self, piece: str) -> bytes:
        return _packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """A part is what the split pattern leaves whole, so the library's merge model takes it as it is."""
        tokens, space = self.model.tokenize, chr(_VISIBLE[32])
        seen = [
            p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_VISIBLE)
            for p in parts
        ]
        return {p: _packed([t.id for t in tokens(x)]) for p, x in zip(parts, seen, strict=True)}

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces by their parts; where the vocabulary normalises text, that is for pieces of Latin-1
        characters (to which only its lower case applies), and others go to the library whole."""
        learnt, split = {}, {}
        for piece in pieces:
            if not self.drops_space:
                split[piece] = self.parts.findall(piece)
                continue
            try:
                piece.encode("latin-1")
            except UnicodeEncodeError:
                learnt[piece] = self._alone(piece)
            else:
                split[piece] = self.parts.findall(piece.lower())
        ids = iter(self.known.all([p for parts in split.values() for p in parts], self._encode_parts))
        for piece, parts in split.items():
            learnt[piece] = b"".join([next(ids) for _ in parts])
        return learnt

    def __call__(self, text: str) -> bytes:
        if not self.plain:
            return self._alone(text)
        if any(content in text for content in self.added):
            return b"".join([self.added[x] if x in self.added else self._between(x) for x in self.cut.split(text)])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if _double.search(text):
            pieces = _pieces.findall(text)
        else:
            # Single white-space characters only: every space but a first one opens a piece.
            first, *rest = text.split(" ")
            pieces = [first, *[" " + x for x in rest]]
            if not first:
                del pieces[0]
        return b"".join(self.pieces.all(pieces, self._encode_pieces))


    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text (null: empty), as ``__call__`` gives them."""
        if not self.plain:
            yield from (self._alone(t.as_py() or "") for t in texts)
            return
        bodies: list[bytes] = []
        wide: list[np.ndarray] = []
        slow: dict[int, bytes] = {}
        size = 0
        for value in texts:
            text = value.as_py() or ""
            if any(content in text for content in self.added):
                slow[len(bodies)], text = self(text), ""
            try:
                body = text.encode("latin-1")
            except UnicodeEncodeError:
                codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
                beyond = np.flatnonzero(codes > 255)
                if np.isin(codes[beyond], _wide_white).any():
                    slow[len(bodies)], body = self._between(text), b""
                else:
                    body = text.encode("latin-1", "replace")
                    wide.append(np.stack([beyond + size, codes[beyond]]))
            if b"\0" in body:  # zeros pad a key
                zeros = np.flatnonzero(np.frombuffer(body, dtype=np.uint8) == 0)
                wide.append(np.stack([zeros + size, np.zeros(len(zeros), dtype=np.int64)]))
            bodies.append(body)
            size += len(body)
            if size >= SLICE_CHARS:
                yield from self._slice(bodies, wide, slow)
                bodies, wide, slow, size = [], [], {}, 0
        if bodies:
            yield from self._slice(bodies, wide, slow)

    def _units(self, data: np.ndarray, starts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the parts of all texts, in order; a word with a mark or an apostrophe is one."""
        n = len(data)
        kind = self.kind[data]
        white = kind == _WHITE
        first = np.zeros(n, dtype=bool)
        first[starts] = True
        opens = first.copy()
        opens[1:] |= kind[1:] != kind[:-1]
        if self.drops_space:
            opens |= kind == _DIGIT
        marks = np.concatenate([np.flatnonzero(data == 39), marks])
        whole = np.zeros(0, dtype=np.int64)
        if len(marks):
            words = np.flatnonzero(~white & (first | np.concatenate([[True], white[:-1]])))
            ends = np.flatnonzero(~white & np.concatenate([first[1:] | white[1:], [True]])) + 1
            whole = np.unique(np.searchsorted(words, marks, side="right") - 1)
        if not self.drops_space:
            # The last of the white space before a word stands alone, or, a space, with the word.
            last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])
            opens[last] = True
            opens[last[data[last] == 32] + 1] = False
        at = np.flatnonzero(opens)
        if len(whole):
            own = np.searchsorted(words[whole], at, side="left") - 1
            at = at[(own < 0) | (at >= ends[whole][own])]
        end = np.append(at[1:], n)
        solid = ~white[at]
        return (at[solid], end[solid]) if self.drops_space else (at, end)

    def _slice(self, bodies: list[bytes], wide: list[np.ndarray], slow: dict[int, bytes]) -> Iterator[bytes]:
        bounds = np.cumsum([0, *map(len, bodies)])
        n = int(bounds[-1])
        padded = np.zeros((n // 8 + 4) * 8, dtype=np.uint8)
        padded[:n] = self.folded[np.frombuffer(b"".join(bodies), dtype=np.uint8)] if self.drops_space else np.frombuffer(b"".join(bodies), dtype=np.uint8)
        places, codes = np.concatenate(wide, axis=1) if wide else np.zeros((2, 0), dtype=np.int64)
        order = np.argsort(places)
        places, codes = places[order], codes[order]
        begins = bounds[:-1][np.diff(bounds) > 0]
        at, end = self._units(padded[:n], begins, places) if n else (bounds[:0], bounds[:0])
        strings = np.zeros(len(at), dtype=bool)
        strings[np.searchsorted(at, places, side="right") - 1] = True
        strings |= end - at > LONGEST_KEY
        words, raw = padded.view("<u8"), padded.tobytes()
        counts, made = [np.zeros(1, dtype=np.int64)], []

        def string(k: int) -> str:
            a, b = int(at[k]), int(end[k])
            chars = raw[a:b].decode("latin-1")
            x, y = np.searchsorted(places, [a, b])
            if x == y:
                return chars
            out, begin = [], 0
            for p, code in zip((places[x:y] - a).tolist(), codes[x:y].tolist(), strict=True):
                out += [chars[begin:p], chr(code)]
                begin = p + 1
            return "".join([*out, chars[begin:]])

        for from_ in range(0, len(at), UNITS_AT_ONCE):
            part = slice(from_, from_ + UNITS_AT_ONCE)
            begin, count = self._look_up(words, raw, at[part], end[part], np.flatnonzero(strings[part]), lambda k, f=from_: string(k + f))
            ends = np.cumsum(count)
            total = int(ends[-1])
            made.append(self.young.ids[np.repeat(begin - (ends - count), count) + np.arange(total)])
            counts.append(count)
        before = np.cumsum(np.concatenate(counts))[np.searchsorted(at, bounds)]
        ids = np.concatenate(made).tobytes() if made else b""
        for k, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
            yield slow[k] if k in slow else ids[4 * a : 4 * b]

    def _look_up(self, words: np.ndarray, raw: bytes, at: np.ndarray, end: np.ndarray, strings: np.ndarray, string) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each part begin in the young table, and how many there are."""
        if self.young.entries > TABLE_SLOTS // 2:
            self.old, self.young = self.young, Table()
        low, high = keys(words, at, end - at)
        keyed = np.ones(len(at), dtype=bool)
        keyed[strings] = False
        entry = self.young.find(low, high)
        new = np.flatnonzero(keyed & (entry < 0))
        if len(new):
            distinct = {raw[a:b]: k for a, b, k in zip(at[new].tolist(), end[new].tolist(), new.tolist(), strict=True)}
            known = np.array(list(distinct.values()))
            was = self.old.find(low[known], high[known])
            texts = [p.decode("latin-1") for p, e in zip(distinct, was.tolist(), strict=True) if e < 0]
            plain = [t for t in texts if "'" not in t]
            learnt = self._encode_parts(plain) | self._encode_pieces([t for t in texts if "'" in t])
            fresh = iter([learnt[t] for t in texts])
            old = self.old
            ids = [next(fresh) if e < 0 else old.ids[old.begin[e] : old.begin[e] + old.count[e]].tobytes() for e in was.tolist()]
            self.young.add(low[known], high[known], ids)
            entry[new] = self.young.find(low[new], high[new])
        entry[strings] = 0
        begin, count = self.young.begin[entry], self.young.count[entry]
        used = self.young.used
        for k, ids in zip(strings.tolist(), self.units.all([string(k) for k in strings.tolist()], self._encode_pieces), strict=True):
            begin[k], count[k] = used, len(ids) >> 2
            used = self.young.put(used, ids)
        return begin, count


_encoders: dict[str, Encoder] = {}


def _on_worker(name: str, path: str, sent: Broadcast) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(path, sent.value)
    return _encoders[name]


def on_workers(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """What a task calls for its worker's encoder; workers outlive tasks, and so do the memos.

    The driver reads the vocabulary file, some megabytes that do not grow with the data, and sends its bytes: workers
    need no file of that name."""
    content = Path(path).read_bytes()
    return partial(_on_worker, hashlib.sha256(content).hexdigest(), path, spark.sparkContext.broadcast(content))
