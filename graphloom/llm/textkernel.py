"""Vectorised text primitives over Arrow string columns.

Texts are handled in blocks of about half a megabyte, so memory is bounded by the
block size or by the longest single text.  A word is a maximal run of bytes
other than 0x20 and 0x09-0x0D; in UTF-8 this is the pattern
``[^\\x20\\x09-\\x0D]+`` over code points, since no multi-byte character holds
those bytes.  Fingerprints are 64-bit and the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .workspace import small_batches

BLOCK_BYTES = 1 << 19
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C13 | 3  # odd, and 3 modulo 4
_BASE = (_BASE & ~7) | 3
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IS_FIRST = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED_VALUES = _BYTE_VALUES[_FOLD]
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(BLOCK_BYTES + 1, n)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def release() -> None:
    """Give freed memory back to the system: a worker lives on after a task, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """The same function over batches, which releases memory at its end."""

    def wrapped(*batches):
        try:
            yield from run(*batches)
        finally:
            release()

    return wrapped


class TextBlock:
    """Some whole texts, as one run of bytes with the offsets of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.data, self.offsets, self.fold = data, offsets.astype(np.int64), fold
        self.between = _SPACE  # bytes that no word holds
        self.n = len(offsets) - 1

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        word = ~self.between[self.data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(word)]
        before[heads] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        after[heads[heads > 0] - 1] = False
        return starts, np.flatnonzero(word & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        """First byte of every word."""
        return self._bounds[0]

    @property
    def ends(self) -> np.ndarray:
        """Byte after every word."""
        return self._bounds[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Words of text i are word_offsets[i] to word_offsets[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def word_text(self) -> np.ndarray:
        """Index of the text of every word."""
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def _prefix(self) -> np.ndarray:
        up, _ = _power_table(len(self.data) + 1)
        values = (_FOLDED_VALUES if self.fold else _BYTE_VALUES)[self.data]
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values * up[: len(self.data)], out=out[1:])
        return out

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of byte spans of this block."""
        _, down = _power_table(len(self.data) + 1)
        body = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @cached_property
    def words(self) -> np.ndarray:
        """Fingerprint of every word."""
        return self.hash_spans(self.starts, self.ends)

    def shingles(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all runs of ``width`` words, and the number of each run's first word."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        acc = np.full(n, width, np.uint64)
        for i in range(width):
            acc = acc * np.uint64(0xFF51AFD7ED558CCD) + self.words[i : n + i]
        whole = np.flatnonzero(self.word_text[: n] == self.word_text[width - 1 :])
        return mix(acc[whole]), whole

    def all_shingles(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Shingles in order of text and place, with the index of each one's text; shorter texts have one."""
        h, at = self.shingles(width)
        text = self.word_text[at]
        few = np.flatnonzero((self.n_words > 0) & (self.n_words < width))
        if len(few):
            first = self.word_offsets[few]
            acc = self.n_words[few].astype(np.uint64)
            for i in range(width - 1):
                more = self.n_words[few] > i
                acc[more] = acc[more] * np.uint64(0xFF51AFD7ED558CCD) + self.words[first[more] + i]
            h, text = np.concatenate([h, mix(acc)]), np.concatenate([text, few])
            order = np.argsort(text, kind="stable")
            h, text = h[order], text[order]
        return h, text

    def shingle_sets(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of every text, ascending by text and fingerprint, and the index of each one's text.

        A text of fewer than ``width`` words, but one at least, has its whole
        word sequence as its only shingle; a text without words has none.
        """
        h, text = self.all_shingles(width)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        return h[new], text[new]

    def spell(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of byte spans, with A-Z lower-cased where words are folded."""
        size = ends - starts
        last = np.cumsum(size)
        body = self.data[np.repeat(starts - last + size, size) + np.arange(int(size.sum()))]
        body = _FOLD[body] if self.fold else body
        offsets = np.concatenate([np.zeros(1, np.int64), last])
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string())

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag of the 256 given."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags[self.data], out=total[1:])
        return np.diff(total[self.offsets])


def byte_flags(chars: str | bytes) -> np.ndarray:
    """A flag for each byte value; ASCII characters only."""
    flags = np.zeros(256, bool)
    flags[list(chars.encode("ascii") if isinstance(chars, str) else chars)] = True
    return flags


def blocks(texts: pa.Array, fold: bool = True, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, TextBlock]]:
    """Yield (first row, row after the last, block) over a string array; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, body = texts.buffers()
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, int(offsets[i]) + limit, "right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield i, j, TextBlock(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold)
        i = j


def map_blocks(df, fn: Callable, schema: str, text: str = "text", fold: bool = True):
    """Apply ``fn(rows, block) -> RecordBatch`` to every block of texts.

    ``rows`` is the RecordBatch of the block's rows.  No shuffle; one pass.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j, block in blocks(column, fold):
                out = fn(batch.slice(i, j - i), block)
                if out is not None and out.num_rows:
                    yield out

    return df.transform(small_batches).mapInArrow(run, schema)


def hash_words(words: list[str], fold: bool = True) -> np.ndarray:
    """Fingerprints of single words, as TextBlock.words gives them."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    block = TextBlock(data, np.concatenate([[0], ends]).astype(np.int64), fold)
    return block.hash_spans(block.offsets[:-1], block.offsets[1:])
