"""Toxicity as a severity grade by cumulative-link ordinal regression.

Texts are sparse sets of hashed words.  Grades of the labelled rows are 0 where
the label is 0, and for the others 1 to 3 by how many of the words that mark
toxic texts they hold.  One weight for each word is shared by the ordered
thresholds: P(grade > k) = sigmoid(w.x - t_k).  The expected severity is the sum
of these over k.

Fitting uses at most TRAIN_ROWS labelled rows, of which hashed words alone reach
the driver, and keeps MOST_WORDS words; the weights are broadcast at that size.
Scoring is one map over the texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_model
from . import textkernel as tk

MOST_WORDS = 500
LEAST_TEXTS = 5
GRADES = 3
SLOTS_BITS = 20  # words are hashed to this many bits
RIDGE = 3e-5
TOXIC = 0.4  # least P(grade > 0) of a document called toxic

_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_slots(block: tk.TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of the words of each text, without outer punctuation, and the text of each."""
    starts, ends = block.starts.copy(), block.ends.copy()
    while len(starts):
        live = (starts < ends) & _PUNCTUATION[block.data[np.minimum(starts, len(block.data) - 1)]]
        if not live.any():
            break
        starts[live] += 1
    while len(starts):
        live = (starts < ends) & _PUNCTUATION[block.data[ends - 1]]
        if not live.any():
            break
        ends[live] -= 1
    some = starts < ends
    h = block.hash_spans(starts[some], ends[some]) >> np.uint64(64 - SLOTS_BITS)
    key = np.unique(block.word_text[some].astype(np.int64) << SLOTS_BITS | h.astype(np.int64))
    return key & ((1 << SLOTS_BITS) - 1), key >> SLOTS_BITS


@dataclass
class Model:
    slots: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def severity(self, slots: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for every text and k."""
        total = np.zeros(n)
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
            hit = self.slots[at] == slots
            total = np.bincount(text[hit], weights=self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds[None, :], -40, 40)))


def fit(slots: list[np.ndarray], y: np.ndarray) -> Model:
    """Ordinal model from the distinct slots of each text and labels 0 or 1."""
    n = len(y)
    if n == 0 or y.max() == 0:
        return Model(np.empty(0, np.int64), np.empty(0), np.array([20.0] * GRADES))
    flat = np.concatenate(slots) if slots else np.empty(0, np.int64)
    row = np.repeat(np.arange(n), [len(s) for s in slots])
    all_, toxic = np.bincount(flat, minlength=1 << SLOTS_BITS), np.bincount(flat[y[row] == 1], minlength=1 << SLOTS_BITS)
    pos, neg = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    ratio = np.log((toxic + 0.5) / (pos + 1)) - np.log((all_ - toxic + 0.5) / (neg + 1))
    spread = np.sqrt(1 / (toxic + 0.5) + 1 / (all_ - toxic + 0.5))
    able = np.flatnonzero(all_ >= LEAST_TEXTS)
    chosen = np.sort(able[np.argsort(-np.abs(ratio[able] / spread[able]), kind="stable")[:MOST_WORDS]])
    marks = np.zeros(1 << SLOTS_BITS, bool)
    marks[able[(ratio[able] > 2) & (ratio[able] > 3 * spread[able])]] = True
    held = np.bincount(row[marks[flat]], minlength=n)
    strong = held[y == 1]
    cuts = np.quantile(strong, [1 / 3, 2 / 3]) if len(strong) else np.zeros(2)
    grade = np.where(y == 1, 1 + (held > cuts[0]).astype(int) + (held > cuts[1]), 0)
    at = np.searchsorted(chosen, flat)
    at = np.minimum(at, max(len(chosen) - 1, 0))
    hit = chosen[at] == flat if len(chosen) else np.zeros(len(flat), bool)
    r, c = row[hit], at[hit]
    w, bias, gaps = np.zeros(len(chosen)), 1.0, np.zeros(GRADES - 1)
    over = (grade[:, None] > np.arange(GRADES)[None, :]).astype(float)
    state = [np.zeros(len(w)), 0.0, np.zeros(GRADES - 1)]
    for _ in range(1200):  # adaptive steps; thresholds stay in order, as sums of positive gaps
        thresholds = bias + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=w[c], minlength=n)[:, None] - thresholds, -40, 40)))
        miss = (p - over) / n
        grads = [np.bincount(c, weights=miss.sum(axis=1)[r], minlength=len(w)) + RIDGE * w, -miss.sum(), -np.array([miss[:, k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 1)])]
        for k, g in enumerate(grads):
            state[k] = state[k] + g * g
        w = w - 0.3 * grads[0] / (np.sqrt(state[0]) + 1e-9)
        bias = bias - 0.3 * grads[1] / (np.sqrt(state[1]) + 1e-9)
        gaps = gaps - 0.1 * grads[2] / (np.sqrt(state[2]) + 1e-9)
    return Model(chosen.astype(np.int64), w, bias + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, labels: DataFrame, allowed=None) -> Model:
    """Model of severity from labels.toxic.

    Null labels and doc_ids are left out, of several labels of a document the
    least counts, null texts have no words; without toxic rows nothing is toxic.
    """
    chosen = quality_model.training_rows(docs, labels, quality_model.not_held_out() if allowed is None else allowed, "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # TRAIN_ROWS at most

    def run(rows, block):
        slots, text = word_slots(block)
        ends = np.searchsorted(text, np.arange(block.n + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slots.astype(np.int32)))
        return pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("y")).cast(pa.int32()), lists], names=["y", "slots"])

    rows = tk.map_blocks(texts, run, "y int, slots array<int>").collect()
    return fit([np.array(r[1], np.int64) for r in rows], np.array([r[0] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with expected_severity (0 to GRADES), grade (its most likely value) and toxic (P(grade > 0) is TOXIC or more).

    Null and empty texts have no words and the severity of those; rows are
    scored one by one, whatever their doc_id; columns with the names of the new
    ones are replaced, others stay; an empty table gives no rows.
    """
    docs = docs.drop("expected_severity", "grade", "toxic")
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(rows, block):
        p = model.severity(*word_slots(block), block.n)
        steps = np.concatenate([np.ones((block.n, 1)), p, np.zeros((block.n, 1))], axis=1)
        grade = (steps[:, :-1] - steps[:, 1:]).argmax(axis=1).astype(np.int32)
        made = [pa.array(p.sum(axis=1)), pa.array(grade), pa.array(p[:, 0] >= TOXIC)]
        return pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*names, "expected_severity", "grade", "toxic"])

    return tk.map_blocks(docs, run, f"{kinds}, expected_severity double, grade int, toxic boolean", text)
