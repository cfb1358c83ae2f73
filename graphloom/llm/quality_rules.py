"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds.

For each stratum (language) and each rule (a score where higher is worse), the
labelled good documents give the share that a cutoff would reject falsely.  The
strictest cutoff is taken whose exact (Clopper-Pearson) upper bound on that
share is at most the rule's part of the allowed risk.  Cutoffs are tried from
the laxest on and the first failure ends the search (fixed-sequence testing), so
only strata and rules need a correction, by Bonferroni.  With probability
1 - DELTA no stratum loses more than RISK of its good documents to the rules.
Every language is a stratum; one with too few labelled good documents for any
certificate rejects nothing.

Counting is one pass over the texts; the only shuffles are of numbers (a join of
labels by doc_id and histograms of strata that can be certified).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .workspace import drop, store

RISK = 0.05  # of good documents rejected falsely by all rules together, in each stratum
DELTA = 0.05
BINS = 200
MOST_BROADCAST = 10_000  # strata with cutoffs
WINDOW = 5

_SYMBOLS = tk.byte_flags("#*$%&|<>")
_UPPER = tk.byte_flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = tk.byte_flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_POINT = tk._IS_FIRST & ~tk._SPACE

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
EXTRA = "n_lines long, n_upper long, n_letters long, n_distinct long, n_same_next long"


def count_block(block: tk.TextBlock) -> dict[str, np.ndarray]:
    """The counts of every text of a block; words are compared as they stand."""
    text, n = block.word_text, block.n
    size = block.data.size
    newline = np.flatnonzero(block.data == 0x0A)
    begins = np.unique(np.concatenate([block.offsets[:-1], newline + 1]))
    begins = begins[begins < size]
    owner = np.searchsorted(block.offsets, begins, "right") - 1
    ends = np.minimum(np.append(begins[1:], size), block.offsets[owner + 1])
    ends = ends - ((ends > begins) & (block.data[np.maximum(ends, 1) - 1] == 0x0A))
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, begins)
    begins, ends, owner = begins[worded], ends[worded], owner[worded]
    lines = block.hash_spans(begins, ends)
    order_lines = np.lexsort((lines, owner))
    again = (lines[order_lines][1:] == lines[order_lines][:-1]) & (owner[order_lines][1:] == owner[order_lines][:-1])
    h, at = block.shingles(WINDOW)
    order = np.lexsort((h, text[at]))
    twice = np.zeros(len(h), bool)
    same = (h[order][1:] == h[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    cover = np.zeros(len(text) + WINDOW + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    covered = np.cumsum(cover)[: len(text)] > 0
    order = np.lexsort((block.words, text))
    w, t = block.words[order], text[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    next_same = (block.words[1:] == block.words[:-1]) & (text[1:] == text[:-1])
    count = lambda which: np.bincount(which, minlength=n).astype(np.int64)
    return {
        "n_words": block.n_words.astype(np.int64),
        "word_chars": block.count(_POINT),
        "n_symbols": block.count(_SYMBOLS),
        "n_dup_lines": count(owner[order_lines][1:][again]),
        "n_repeat_words": count(text[covered]),
        "n_lines": count(owner),
        "n_upper": block.count(_UPPER),
        "n_letters": block.count(_LETTER),
        "n_distinct": count(t[fresh]),
        "n_same_next": count(text[1:][next_same]),
    }


def counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text: str = "text") -> DataFrame:
    """The counts of every whole text, with the columns in ``keep``; null texts count as empty."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(rows, block):
        made = count_block(block)
        return pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(keep))] + [pa.array(x) for x in made.values()], names=[*keep, *made])

    return tk.map_blocks(docs.select(*keep, F.col(text).alias("text")), run, f"{kinds}, {BASE}, {EXTRA}", fold=False)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def scores() -> dict[str, Column]:
    """The rules' scores, from 0 to 1, higher is worse; 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.least(F.try_divide(a, b), F.lit(1.0)), F.lit(0.0))
    return {
        "symbols": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": share(F.col("n_repeat_words"), F.col("n_words")),
        "upper": share(F.col("n_upper"), F.col("n_letters")),
        "same_next": share(F.col("n_same_next"), F.col("n_words")),
    }


def _tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial of n and p."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(1, k + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n - i + 1) - np.log(i) + math.log(p) - math.log1p(-p))]) + n * math.log1p(-p)
    top = logs.max()
    return min(1.0, float(math.exp(top) * np.exp(logs - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound on a binomial share, of k in n."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(k, n, mid) > delta else (low, mid)
    return high


def bounded(k: int, n: int, delta: float, share: float) -> bool:
    """Whether the exact upper confidence bound on a share, of k in n, is at most ``share``: one tail at that share tells."""
    return n > 0 and k <= share * n and _tail(k, n, share) <= delta


def least_documents(tests: int, share: float, delta: float = DELTA) -> int:
    """Fewest good documents with which any cutoff can be certified: none of them rejected."""
    return math.ceil(math.log(delta / max(tests, 1)) / math.log1p(-share))


def choose_cutoffs(rows: list[tuple[str, str, int, int]], strata: int | None = None, risk: float = RISK, delta: float = DELTA, bins: int = BINS) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from (stratum, rule, bin, good documents in it).

    A document is rejected if its score reaches the cutoff.  Where no cutoff
    can be certified, the stratum has none for that rule and rejects nothing.
    ``strata`` is how many there are, of which rows may have fewer.
    """
    held: dict[tuple[str, str], np.ndarray] = {}
    for s, r, i, n in rows:
        held.setdefault((s, r), np.zeros(bins + 1, np.int64))[i] += n
    rules = {r for _, r in held}
    each, part = delta / max((strata or len({s for s, _ in held})) * len(rules), 1), risk / max(len(rules), 1)
    out = {}
    for key, counts in held.items():
        total, above, best = int(counts.sum()), 0, None
        for i in range(bins, 0, -1):
            above += int(counts[i])
            if not bounded(above, total, each, part):
                break
            best = i / bins
        if best is not None:
            out[key] = best
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of every document.

    Cutoffs are learnt from all labelled good documents (quality 1; a document
    with several labels counts as good if all say so).  Null and empty texts
    have counts of 0 and fail the base rule; very long texts are counted whole;
    documents without a column lang, or with nulls in it, are one stratum; rows
    with a null doc_id are judged but never learnt from; with no labels at all
    only the base rule decides.
    """
    made = store(counts(docs, tuple(c for c in ("doc_id", "lang") if c in docs.columns)), "rules")
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    learnt = made.where(~base_failed()).join(good, "doc_id", "left_semi")
    rules = scores()
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    learnt = store(learnt.withColumn("_s", stratum), "learnt")
    sizes = learnt.groupBy("_s").agg(F.count("*").alias("n"))
    strata = sizes.count()
    able = sizes.where(F.col("n") >= least_documents(strata * len(rules), RISK / len(rules))).select("_s")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.floor(v * BINS).cast("int").alias("bin")) for k, v in rules.items()]))
    histogram = learnt.join(able, "_s", "left_semi").select("_s", pairs.alias("p")).groupBy("_s", "p.rule", "p.bin").count()
    # a stratum that can be certified has hundreds of labelled documents, so these are few, whatever the number of strata
    cutoffs = choose_cutoffs([tuple(r) for r in histogram.collect()], strata)
    drop(learnt)
    table = [(s, *[next((round(c * BINS) for (t, r), c in cutoffs.items() if (t, r) == (s, rule)), None) for rule in rules]) for s in sorted({s for s, _ in cutoffs})]
    least = docs.sparkSession.createDataFrame(table, ", ".join(["_s string", *(f"_{rule} int" for rule in rules)]))
    least = F.broadcast(least) if len(table) <= MOST_BROADCAST else least
    judged = made.withColumn("_s", stratum).join(least, "_s", "left")
    rejects = F.lit(False)
    for rule, score in rules.items():
        rejects = rejects | F.coalesce(F.floor(score * BINS) >= F.col(f"_{rule}"), F.lit(False))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejects).select(*made.columns, "base_failed", "kept")
