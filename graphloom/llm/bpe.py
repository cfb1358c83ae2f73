"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for each distinct pre-token.  A sequence
of tokens is what the merges give exactly if each token makes itself and every
adjacent pair is compatible: if the merges turn the pair's joined string into
that pair.  All adjacent pairs of a batch are tested at once against a sorted
table of known pairs; pairs not met before are settled once by merging their
strings.  Only pre-tokens with a failing pair, or with a token that its own
merges never make, are merged.

Proposals, tests and merges all run over arrays of a batch; words of more than
LONG bytes are merged one by one, with a heap, in n log n steps.

Recovery and memory: one map over the rows, no shuffle; each worker holds a
table of pre-tokens bounded by bytes.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from . import textkernel as tk
from .pretokens import byte_alphabet, pretokenizer
from .wordtable import Table, WordTable, slices
from .workspace import small_batches

KNOWN_PAIRS = 1_000_000
LONG = 64  # bytes of a word that is merged by itself
_NEVER = np.int64(1 << 60)
_FINAL = np.uint64(0x2545F4914F6CDD1D)


class WordCodec:
    """Encoder of pre-tokens to ids and back, for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.path, self.suffix = path, model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.pre = pretokenizer(path)
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.pre.added.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        letters = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)  # ids of single bytes, within a word
        self.final = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)  # and at its end
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab.__getitem__
        pairs = np.array([ids(a) << 32 | ids(b) for a, b in merges], np.uint64)
        made = np.array([ids(a + b) for a, b in merges], np.int64)
        self.made = made
        self.ranks = Table(pairs, np.arange(len(pairs)), int(_NEVER))
        self.rank_of = dict(zip(pairs.tolist(), range(len(pairs))))
        self._load_strings(letters)
        self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)  # known pairs, ascending
        self.merged = self.proposed = 0  # how many words needed merging, of how many
        alone, n = self.merge(self.raw, self.raw_first, self.is_final)
        self.itself = np.zeros(len(self.names), bool)
        one = n == 1
        self.itself[self.token[one]] = alone[np.concatenate([[0], np.cumsum(n)])[:-1][one]] == self.token[one]
        self.table = WordTable(self.pre, self.encode_words)

    def _load_strings(self, letters: list[str]) -> None:
        """Bytes of every token, and a table of all their prefixes by fingerprint."""
        back = {c: b for b, c in enumerate(letters)}
        tokens, raw, final = [], [], []
        for s, i in self.vocab.items():
            end = bool(self.suffix) and s.endswith(self.suffix) and len(s) > len(self.suffix)
            body = s[: -len(self.suffix)] if end else s
            if all(c in back for c in body):
                tokens.append(i)
                raw.append(bytes(back[c] for c in body))
                final.append(end)
        self.token, self.is_final = np.array(tokens, np.int64), np.array(final)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw], np.int64)
        self.raw_first = np.concatenate([[0], np.cumsum(sizes)])
        self.where = np.full(len(self.names), -1, np.int64)
        self.where[self.token] = np.arange(len(tokens))
        block = tk.TextBlock(self.raw, self.raw_first, fold=False)
        starts = np.repeat(self.raw_first[:-1], sizes)
        prefixes = block.hash_spans(starts, np.arange(len(self.raw)) + 1)
        ends = self.raw_first[1:] - 1
        key = np.where(self.is_final, prefixes[ends] ^ _FINAL, prefixes[ends])
        # -1 for a prefix that is no token
        keys, at = np.unique(np.concatenate([key, prefixes]), return_index=True)
        self.known = Table(keys, np.concatenate([self.token, np.full(len(prefixes), -1)])[at], -2)

    def _spans(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of some tokens, one after the other, and how many each has."""
        at = self.where[token]
        size = self.raw_first[at + 1] - self.raw_first[at]
        ends = np.cumsum(size)
        return self.raw[np.repeat(self.raw_first[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], size

    def merge(self, data: np.ndarray, first: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges themselves: ids of words given as bytes, and how many each has; final tells which words end here.

        The lowest rank goes first, the leftmost among equals.
        """
        sizes = np.diff(first)
        ids = self.inner[data]
        ends = first[1:][final & (sizes > 0)] - 1
        ids[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        out_ids, out_word = [], []
        for w in np.flatnonzero(sizes > LONG).tolist():
            made = self._merge_long(ids[first[w] : first[w + 1]].tolist())
            out_ids.append(np.array(made, np.int64))
            out_word.append(np.full(len(made), w))
        short = sizes[word] <= LONG if len(word) else np.empty(0, bool)
        ids, word = ids[short], word[short]
        rank = self._ranks(ids, word)
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(heads, len(ids)))
            best = np.minimum.reduceat(rank, heads)
            done = np.repeat(best == _NEVER, count)
            if done.any():
                out_ids.append(ids[done])
                out_word.append(word[done])
                ids, word, rank, best, count = ids[~done], word[~done], rank[~done], best[best < _NEVER], count[best < _NEVER]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, count))
            hits = hits[np.concatenate([[True], word[hits][1:] != word[hits][:-1]])]  # the leftmost of each word
            ids[hits] = self.made[rank[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # where they stand after the others have gone
            ids, word, rank = ids[keep], word[keep], rank[keep]
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            near = np.flatnonzero(changed)
            rank[near] = self._ranks(ids, word, near)
        if not out_ids:
            return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
        ids, word = np.concatenate(out_ids), np.concatenate(out_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of each pair of neighbours by its left one; _NEVER at the end of a word."""
        at = np.arange(len(ids)) if at is None else at
        out = np.full(len(at), _NEVER)
        inner = np.flatnonzero(at + 1 < len(ids))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        left = at[inner]
        out[inner] = self.ranks.get((ids[left] << 32 | ids[left + 1]).astype(np.uint64))
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The merges of one word, by a heap over a linked list."""
        n, rank = len(ids), self.rank_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := rank(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def propose(self, block: tk.TextBlock, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words of a block: tokens in order, and the byte that each starts at; ends gives the end of each byte's word."""
        n = len(block.data)
        longest, token = np.ones(n, np.int64), np.full(n, -1, np.int64)
        live, size = np.arange(n), 1
        while len(live):
            stop = live + size
            h = block.hash_spans(live, stop)
            last = stop == ends[live]
            value = self.known.get(h)
            got = np.where(last, self.known.get(h ^ _FINAL), value)
            hit = got >= 0
            longest[live[hit]], token[live[hit]] = size, got[hit]
            live = live[(value != -2) & ~last]
            size += 1
        at = np.zeros(n, bool)
        here = block.offsets[:-1][block.offsets[:-1] < block.offsets[1:]]
        while len(here):
            at[here] = True
            there = here + longest[here]
            here = there[there < ends[here]]
            if len(here) < 16:  # what is left of a few long words
                steps, limit = longest, ends
                for i in here.tolist():
                    stop = int(limit[i])
                    while i < stop:
                        at[i] = True
                        i += int(steps[i])
                break
        starts = np.flatnonzero(at)
        return token[starts], starts

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stands side by side under the merges."""
        keys, back = np.unique(left << 32 | right, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, keys), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
        fits = np.zeros(len(keys), bool)
        fits[known] = self.fits[at[known]]
        new = keys[~known]
        if len(new):
            a, b = new >> 32, new & 0xFFFFFFFF
            good = self.itself[a] & self.itself[b]
            x, y = a[good], b[good]
            data, size = self._spans(np.stack([x, y], axis=1).ravel())
            first = np.concatenate([[0], np.cumsum(size.reshape(-1, 2).sum(axis=1))])
            ids, n = self.merge(data, first, self.is_final[self.where[y]])
            two = n == 2
            at = np.concatenate([[0], np.cumsum(n)])[:-1][two]
            made = np.zeros(len(x), bool)
            made[two] = (ids[at] == x[two]) & (ids[at + 1] == y[two])
            good[good] = made
            fits[~known] = good
            if len(self.pairs) + len(new) > KNOWN_PAIRS:
                self.pairs, self.fits = new, good
            else:
                pairs, fit = np.concatenate([self.pairs, new]), np.concatenate([self.fits, good])
                order = np.argsort(pairs, kind="stable")
                self.pairs, self.fits = pairs[order], fit[order]
        return fits[back]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, as the merges give them, and how many each has."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.concatenate([[0], np.cumsum(sizes)])
        block = tk.TextBlock(data, first, fold=False)
        owner = np.repeat(np.arange(len(words)), sizes)
        ids, starts = self.propose(block, first[1:][owner])
        word = owner[starts]
        bad = np.zeros(len(words), bool)
        bad[word[~self.itself[ids] | (ids < 0)]] = True
        inner = np.flatnonzero((word[1:] == word[:-1]) & ~bad[word[1:]])
        fails = ~self.compatible(ids[inner], ids[inner + 1])
        bad[word[inner[fails]]] = True
        self.proposed += len(words)
        count = np.bincount(word, minlength=len(words))
        if not bad.any():
            return ids, count
        self.merged += int(bad.sum())
        take = bad[owner]
        again, n = self.merge(data[take], np.concatenate([[0], np.cumsum(sizes[bad])]), np.ones(int(bad.sum()), bool))
        good = ~bad[word]
        count[bad] = n
        order = np.argsort(np.concatenate([word[good], np.repeat(np.flatnonzero(bad), n)]), kind="stable")
        return np.concatenate([ids[good], again])[order], count

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Text of each list of ids: the file has no decoder, so the token strings joined by spaces."""
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), self.names.take(pa.array(flat, pa.int32())))
        return pa.compute.binary_join(lists, " ")

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; null counts as empty."""
        return self.table.ids_of(texts)


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    """One codec in each worker process."""
    return WordCodec(path)


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    ends = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(flat, "<i4").tobytes())])


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every whole text.

    Returns the columns in ``keep``, then n_tokens long, ids binary (the ids as
    little-endian unsigned 32-bit integers) and decoded string.  Null and empty
    texts have no ids and the empty decoded text; very long texts and words are
    taken whole; rows are returned as often as they come, whatever their doc_id;
    an empty table gives an empty one.
    """
    names = list(keep)

    def run(batches):
        words = codec(path)
        for batch in batches:
            for at, texts in slices(batch.column(batch.num_columns - 1)):
                flat, sizes = words.encode_batch(texts)
                rows = batch.slice(at, len(texts))
                columns = [rows.column(i) for i in range(len(names))] + [pa.array(sizes, pa.int64()), packed(flat, sizes), words.decode(flat, sizes)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "ids", "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema), "n_tokens long", "ids binary", "decoded string"])
    return docs.select(*names, text).transform(small_batches).mapInArrow(tk.released(run), schema)
