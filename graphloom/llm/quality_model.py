"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees are grown on statistics of labelled texts; every path from
a root is a rule, a conjunction of comparisons.  A logistic model with a lasso
penalty weighs the rules and leaves most out.  What remains is compiled to a
Spark column expression over the statistics.

Fitting uses at most TRAIN_ROWS labelled rows (those with the smallest hash of
doc_id), of which only numbers reach the driver.  Scoring is one map over the
texts and a projection, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from . import textkernel as tk
from .workspace import free_name

TRAIN_ROWS = 20_000
TREES, DEPTH, LEAVES_LEAST, CUTS = 24, 3, 20, 24
LASSO = 0.0015
THRESHOLD = 0.3

_FLAGS = {
    "pipes": tk.byte_flags("|"),
    "marks": tk.byte_flags("#*$%&<>{}[]\\^~=_+"),
    "shouts": tk.byte_flags("!?"),
    "digits": tk.byte_flags("0123456789"),
    "stops": tk.byte_flags(".,;:"),
    "points": tk._IS_FIRST,
}
#: Statistics that the rules compare; text and counts of it are their only inputs.
FEATURES = ("log_words", "word_length", "pipes", "marks", "shouts", "digits", "stops", "upper", "dup_lines", "repeats", "same_next", "distinct", "line_words", "symbols")


def _features(block: tk.TextBlock) -> dict[str, np.ndarray]:
    c = {k: v.astype(float) for k, v in quality_rules.count_block(block).items()} | {k: block.count(v).astype(float) for k, v in _FLAGS.items()}
    over = lambda a, b: a / np.maximum(b, 1)
    chars = c["word_chars"]
    return {
        "log_words": np.log1p(c["n_words"]),
        "word_length": over(chars, c["n_words"]),
        "pipes": over(c["pipes"], chars),
        "marks": over(c["marks"], chars),
        "shouts": over(c["shouts"], chars),
        "digits": over(c["digits"], chars),
        "stops": over(c["stops"], chars),
        "upper": over(c["n_upper"], c["n_letters"]),
        "dup_lines": over(c["n_dup_lines"], c["n_lines"]),
        "repeats": over(c["n_repeat_words"], c["n_words"]),
        "same_next": over(c["n_same_next"], c["n_words"]),
        "distinct": over(c["n_distinct"], np.sqrt(c["n_words"])),
        "line_words": over(c["n_words"], c["n_lines"]),
        "symbols": over(c["n_symbols"], chars),
    }


def statistics(docs: DataFrame, text: str = "text", name: str = "_stats") -> DataFrame:
    """The documents with a struct of the statistics of every whole text; null texts count as empty."""
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(rows, block):
        made = _features(block)
        stats = pa.StructArray.from_arrays([pa.array(made[k]) for k in FEATURES], names=list(FEATURES))
        return pa.RecordBatch.from_arrays([*rows.columns, stats], names=[*names, name])

    return tk.map_blocks(docs, run, f"{kinds}, {name} struct<{', '.join(f'{k}: double' for k in FEATURES)}>", text, fold=False)


@dataclass(frozen=True)
class Rule:
    """Comparisons (feature, whether it must be above, cut), all of which must hold."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for feature, above, cut in self.parts:
            out &= (x[:, feature] > cut) if above else (x[:, feature] <= cut)
        return out

    def column(self, name: str = "_stats") -> Column:
        out = None
        for feature, above, cut in self.parts:
            c = F.col(name)[FEATURES[feature]]
            part = c > F.lit(cut) if above else c <= F.lit(cut)
            out = part if out is None else out & part
        return out


def _grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, rules: dict) -> list[tuple[tuple, float]]:
    """Leaves (path, mean) of a regression tree; every path on the way goes to rules."""
    best = (1e-9, None)
    if depth and len(rows) >= 2 * LEAVES_LEAST:
        total, n = target[rows].sum(), len(rows)
        for f, values in enumerate(cuts):
            if not len(values):
                continue
            at = np.searchsorted(values, x[rows, f], "left")  # x <= values[k] for at <= k
            count = np.cumsum(np.bincount(at, minlength=len(values) + 1))[:-1]
            sums = np.cumsum(np.bincount(at, weights=target[rows], minlength=len(values) + 1))[:-1]
            ok = (count >= LEAVES_LEAST) & (n - count >= LEAVES_LEAST)
            gain = np.where(ok, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            if gain.max() > best[0]:
                best = (gain.max(), (f, float(values[gain.argmax()])))
    if best[1] is None:
        return [(path, float(target[rows].mean()) if len(rows) else 0.0)]
    f, cut = best[1]
    out = []
    for above in (False, True):
        part = rows[(x[rows, f] > cut) == above]
        longer = path + ((f, above, cut),)
        rules.setdefault(Rule(longer))
        out += _grow(x, target, cuts, part, depth - 1, longer, rules)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model by accelerated proximal gradients."""
    n, k = z.shape
    step = 4.0 / max(np.linalg.norm(z, 2) ** 2 / n + 1, 1e-9)
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ miss) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        shift = c - step * miss.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), shift + (t - 1) / after * (shift - b)
        w, b, t = new, shift, after
    return w, b


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))

    def column(self, name: str = "_stats") -> Column:
        """The score as an expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(name), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Model of labels 0 and 1; without both labels, the constant of what there is (a half without any)."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model([], float(np.log(share / (1 - share))))
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        spread = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1])) if len(values) > CUTS else (values[1:] + values[:-1]) / 2
        cuts.append(np.unique(np.concatenate([spread, np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1]))])))
    rules: dict[Rule, None] = {}
    rng = np.random.default_rng(0)
    base = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-base))
        some = np.sort(rng.choice(len(y), max(1, len(y) * 2 // 3), replace=False))
        for path, mean in _grow(x, residual, cuts, some, DEPTH, (), rules):
            base += np.where(Rule(path).holds(x), 2.0 * mean, 0)
    kept, columns, seen = [], [], set()
    for rule in rules:
        z = rule.holds(x)
        key = z.tobytes()
        if 0.002 < z.mean() < 0.998 and key not in seen:
            seen.add(key)
            kept.append(rule)
            columns.append(z)
    if not kept:
        return Model([], float(np.log(y.mean() / (1 - y.mean()))))
    z = np.array(columns, float).T
    scale = z.std(axis=0)
    mean = z.mean(axis=0)
    w, b = _lasso((z - mean) / scale, y.astype(float), LASSO)
    w = w / scale
    return Model([(r, float(v)) for r, v in zip(kept, w) if v], float(b - (w * mean).sum()))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, column: str = "quality") -> DataFrame:
    """(doc_id, y) of at most TRAIN_ROWS labelled documents; the smallest label where several disagree."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & allowed)
    one = known.groupBy("doc_id").agg(F.min(column).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


def not_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of quality, from labels whose doc_id isn't held out.

    Null labels and doc_ids are left out, of several labels of a document the
    least counts, null texts count as empty; without labels, or with one kind
    only, the score is a constant.
    """
    chosen = training_rows(docs, labels, not_held_out())
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # TRAIN_ROWS at most
    rows = statistics(texts).select("y", "_stats.*").collect()
    x = np.array([r[1:] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[0] for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 if the score is THRESHOLD or more).

    Null and empty texts have the statistics of the empty text and its score;
    rows are scored one by one, so ties and repeated rows stay as they are;
    columns named score and predicted are replaced, others stay; an empty table
    gives no rows.
    """
    name = free_name(docs, "_stats")
    scored = statistics(docs, name=name).withColumn("score", model.column(name)).drop(name)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
