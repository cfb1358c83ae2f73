"""Distinct pre-tokens of a worker with their ids, in arrays.

Texts are cut into pre-tokens by classes of bytes, and each distinct pre-token
is encoded once; its ids lie in one array, and the ids of a batch of texts are
gathered from it.  Pre-tokens are found by 64-bit fingerprints and compared by
length and first and last eight bytes.  The table is bounded by bytes and starts
anew, between batches, when it is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from . import textkernel as tk
from .pretokens import PreTokenizer

MOST_BYTES = 32 << 20  # of words with their entries, and their ids
ENTRY_BYTES = 80  # of a word in the tables, beside its ids
TEXTS_AT_ONCE = 2048
CHARS_AT_ONCE = 1 << 21

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC2, 0xCA)]] = _LETTER
_CLASS[0x30:0x3A] = _NUMBER
_CLASS_C2 = np.full(256, _OTHER, np.uint8)  # of characters with the lead byte C2, by their second byte
_CLASS_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_CLASS_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_CLASS_C2[[0x85, 0xA0]] = _SPACE
_ADDED = b"\xff"  # no text has this byte; an added token is this and its id


class Table:
    """64-bit keys with values, for lookups and additions of whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int = -1):
        self.missing, self.n = missing, 0
        self._resize(len(keys))
        self.put(keys.astype(np.uint64), values)

    def _resize(self, n: int) -> None:
        bits = max(10, int(np.ceil(np.log2(4 * max(n, 1)))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.full = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.missing, np.int64), np.zeros(1 << bits, bool)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that aren't there yet."""
        if 2 * (self.n + len(keys)) > len(self.full):
            old = self.keys[self.full], self.values[self.full]
            self._resize(2 * (self.n + len(keys)))
            self.n = 0
            keys, values = np.concatenate([old[0], keys]), np.concatenate([old[1], values])
        self.n += len(keys)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        owner = np.full(len(self.full), -1, np.int64) if len(keys) else None
        while len(left):
            free = left[~self.full[slot[left]]]
            owner[slot[free]] = free  # the last that wants a slot gets it
            put = free[owner[slot[free]] == free]
            self.keys[slot[put]], self.values[slot[put]], self.full[slot[put]] = keys[put], values[put], True
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        full = self.full[slot]
        good = full & (self.keys[slot] == keys)
        out = np.where(good, self.values[slot], self.missing)
        left = np.flatnonzero(full & ~good)
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            at = slot[left]
            full = self.full[at]
            good = full & (self.keys[at] == keys[left])
            out[left[good]] = self.values[at[good]]
            left = left[full & ~good]
        return out


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (the latter excluded) of every pre-token of UTF-8 text in lower case, of characters below U+0250."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        kind[lead + 1] = kind[lead]
        two = lead[data[lead] == 0xC2]
        kind[two] = kind[two + 1] = _CLASS_C2[data[two + 1]]
        three = lead[data[lead] == 0xC3]
        signs = three[(data[three + 1] == 0x97) | (data[three + 1] == 0xB7)]
        kind[signs] = kind[signs + 1] = _OTHER
    n = len(data)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    numbers = np.flatnonzero(kind == _NUMBER)
    start[numbers] = True
    if len(lead):
        start[lead[kind[lead] == _NUMBER] + 1] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe starts a pre-token of its own
    marks = np.flatnonzero((data == 0x27) & start)
    marks = marks[marks + 1 < n]
    marks = marks[kind[marks + 1] == _LETTER]
    if len(marks):
        a, b = data[marks + 1], data[np.minimum(marks + 2, n - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (marks + 2 < n) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for which, size in ((marks[one], 1), (marks[two], 2)):
            start[which + 1] = False
            after = which + 1 + size
            after = after[after < n]
            start[after] = True
    start &= kind != _SPACE
    begins = np.flatnonzero(start)
    stop = np.zeros(n + 1, bool)
    stop[:-1] = start
    stop[:-1] |= kind == _SPACE
    stop[-1] = True
    stops = np.flatnonzero(stop)
    return begins, stops[np.searchsorted(stops, begins, "right")]


class WordTable:
    """Ids of texts by way of their distinct pre-tokens.

    ``encode`` gives the ids of a list of words, one after the other, and how
    many each has; added tokens of the file stand for themselves.
    """

    def __init__(self, pre: PreTokenizer, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.pre, self.encode = pre, encode
        self.clear()

    def clear(self) -> None:
        self.known = Table(np.empty(0, np.uint64), np.empty(0, np.int64))
        self.ids, self.first = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.marks = np.zeros((3, 1 << 14), np.uint64)  # length, first and last eight bytes of each word
        self.n = 0

    @property
    def bytes(self) -> int:
        return ENTRY_BYTES * self.n + 4 * int(self.first[self.n])

    def _pieces(self, text: str) -> list[bytes]:
        if "<|" not in text:
            return [w.encode() for w in self.pre.split(text)]
        out: list[bytes] = []
        for added, s in self.pre.parts(text):
            out.extend([_ADDED + b"%d" % self.pre.added[s]] if added else [w.encode() for w in self.pre.split(s)])
        return out

    def _cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, first and last places of all pre-tokens in order, and how many each text has."""
        parts, sizes, slow = [], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            low = self.pre.lowered(text) if text and "<|" not in text else None
            if low is not None:
                raw = low.encode()
                parts.append(raw)
                sizes[i] = len(raw) + 1
            elif text:
                slow.append((i, self._pieces(text)))
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        begins, ends = spans(data)
        owner = np.searchsorted(np.cumsum(sizes), begins, "right")
        if slow:
            raw = [w for _, pieces in slow for w in pieces]
            lens = np.fromiter(map(len, raw), np.int64, len(raw))
            stops = len(data) + np.cumsum(lens)
            data = np.concatenate([data, np.frombuffer(b"".join(raw), np.uint8)])
            begins, ends = np.concatenate([begins, stops - lens]), np.concatenate([ends, stops])
            owner = np.concatenate([owner, np.repeat([i for i, _ in slow], [len(x) for _, x in slow])])
            order = np.argsort(owner, kind="stable")
            begins, ends, owner = begins[order], ends[order], owner[order]
        return data, begins, ends, np.bincount(owner, minlength=len(texts))

    def _learn(self, words: list[bytes], keys: np.ndarray, marks: np.ndarray) -> None:
        plain = np.array([not w.startswith(_ADDED) for w in words])
        flat, sizes = self.encode([w.decode() for w, text in zip(words, plain) if text])
        if not plain.all():
            count = np.ones(len(words), np.int64)
            count[plain] = sizes
            place = np.repeat(plain, count)
            every = np.empty(int(count.sum()), np.int64)
            every[place], every[~place] = flat, [int(w[1:]) for w, text in zip(words, plain) if not text]
            flat, sizes = every, count
        n, used = self.n + len(words), int(self.first[self.n])
        if n + 1 > len(self.first):
            more = max(n + 1, len(self.first))
            self.first, self.marks = np.concatenate([self.first, np.zeros(more, np.int64)]), np.concatenate([self.marks, np.zeros((3, more), np.uint64)], axis=1)
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(flat), len(self.ids)), np.int32)])
        self.first[self.n + 1 : n + 1] = used + np.cumsum(sizes)
        self.ids[used : used + len(flat)] = flat
        self.marks[:, self.n : n] = marks
        self.known.put(keys, np.arange(self.n, n))
        self.n = n

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); null counts as empty."""
        if self.bytes > MOST_BYTES:
            self.clear()
        data, begins, ends, per = self._cut(texts)
        size = ends - begins
        keys = tk.TextBlock(data, np.array([0, len(data)]), fold=False).hash_spans(begins, ends)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        mask = (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1)
        mask[size >= 8] = np.uint64(0xFFFFFFFFFFFFFFFF)
        marks = np.stack([size.astype(np.uint64), eight[begins] & mask, eight[np.maximum(ends - 8, 0)] & np.where(size >= 8, mask, np.uint64(0))])
        word = self.known.get(keys)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            raw = data.tobytes()
            self._learn([raw[i:j] for i, j in zip(begins[at].tolist(), ends[at].tolist())], fresh, marks[:, at])
            word[new] = self.known.get(keys[new])
        starts = self.first[word]
        sizes = self.first[word + 1] - starts
        stops = np.cumsum(sizes)
        flat = self.ids[np.repeat(starts - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        out = np.diff(np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(per)])])
        same = (self.marks[:, word] == marks).all(axis=0)
        if not same.all():  # two words with one fingerprint
            return self._one_by_one(texts)
        return flat.astype(np.int64), out

    def _one_by_one(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.empty(0, np.int64)], []
        for text in texts:
            own = [np.array([int(w[1:])]) if w.startswith(_ADDED) else self.encode([w.decode()])[0] for w in (self._pieces(text) if text else [])]
            ids.extend(own)
            sizes.append(sum(map(len, own)))
        return np.concatenate(ids).astype(np.int64), np.array(sizes, np.int64)


def slices(texts: pa.Array):
    """(first row, texts) of parts of a column, of some thousands of texts and some millions of bytes, or one text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        many = int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS_AT_ONCE]), CHARS_AT_ONCE, "right"))
        stop = at + max(1, many)
        yield at, texts.slice(at, stop - at).to_pylist()
        at = stop


def lists_of(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
