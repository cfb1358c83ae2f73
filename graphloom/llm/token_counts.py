"""Token counts under a unigram model, by dynamic programming shared over a trie.

Distinct pre-tokens (words with the piece file's space mark before them) are
put in a trie.  The best score of every prefix is computed once, at its node,
from the nodes above it; all words with that prefix share it.  A terminal node
stores the number of pieces of its word's best segmentation.

Pieces come from a public vocabulary file, whose order of merges is an order of
frequency; a piece at rank r has the unigram probability of Zipf's law,
proportional to 1 / (r + ZIPF_SHIFT).  A character without a piece counts as
its UTF-8 bytes.  Ties go to fewer pieces.

One map over the texts, no shuffle; the trie of a worker is bounded and starts
anew when it is full.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .workspace import small_batches

ZIPF_SHIFT = 2.7
MOST_NODES = 400_000
MOST_WORDS = 400_000
ROWS_AT_ONCE = 512
MARK = "▁"  # Fixed value: the file's mark of a space before a word

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class UnigramTrie:
    """Unigram scores and a trie of the words met so far."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        self.counts: dict[str, int] = {}
        self.clear()

    @classmethod
    def load(cls, path: str) -> UnigramTrie:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        norm = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(pieces) + 1)))
        scores = {}
        for rank, piece in enumerate(pieces):
            scores.setdefault(piece, -math.log(rank + ZIPF_SHIFT) - norm)
        return cls(scores, -math.log(len(pieces) + ZIPF_SHIFT) - norm)

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | character
        self.best = [0.0]  # forward score of each node
        self.pieces = [0]
        self.made = 0

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of a word."""
        child, best, pieces, scores = self.child, self.best, self.pieces, self.scores
        node, path = 0, [0]
        for i, ch in enumerate(word):
            key = node << 21 | ord(ch)
            node = child.get(key)
            if node is None:
                top = (-math.inf, 0)
                for back in range(max(0, i + 1 - self.longest), i + 1):
                    s = scores.get(word[back : i + 1])
                    if s is not None:
                        at = path[back]
                        top = max(top, (best[at] + s, -pieces[at] - 1))
                if ch not in scores:
                    at, n = path[i], len(ch.encode("utf-8", "surrogatepass"))
                    top = max(top, (best[at] + n * self.byte_score, -pieces[at] - n))
                node = child[key] = len(best)
                best.append(top[0])
                pieces.append(-top[1])
                self.made += 1
            path.append(node)
        return pieces[node]

    def count_batch(self, words: list[list[str]]) -> list[int]:
        """Pieces of each list of words."""
        if len(self.counts) > MOST_WORDS:
            self.counts.clear()
        counts = self.counts
        for word in sorted(set().union(*words).difference(counts)):
            if len(self.best) > MOST_NODES:
                self.clear()
            counts[word] = self.count(MARK + word)
        get = counts.__getitem__
        return [sum(map(get, x)) for x in words]


@lru_cache(maxsize=1)
def trie(path: str) -> UnigramTrie:
    return UnigramTrie.load(path)


def split(text: str | None) -> list[str]:
    """Words between ASCII white space."""
    return _WORDS.findall(text) if text else []


def count(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text.

    Null and empty texts have none of either; rows are counted one by one,
    whatever their doc_id; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = trie(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                words = [split(t) for t in rows.column(1).to_pylist()]
                n = pa.array(np.array([len(x) for x in words], np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), n, pa.array(model.count_batch(words), pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", text).transform(small_batches).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
