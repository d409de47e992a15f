"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of every whole text are computed once, in numpy, by a pass over the documents.
2. On a bounded sample of labelled rows the driver boosts small trees on binned statistics.  Every path from a root to
   a node is a rule: a conjunction of bounds on statistics.
3. Lasso logistic regression, by accelerated proximal gradient, gives most rules the weight 0; the penalty is the one
   that does best on a fifth of the sample that neither the trees nor the compared weights have seen.  The final weights
   are fitted to the whole sample.
4. The rules that are left become Spark column expressions; all documents are scored in the JVM.

Defined results.  A null text is scored as the empty text.  Rows are scored each alone, repeated ones alike.  A null
doc_id is not held out and never labelled.  Labels that contradict each other are averaged and rounded.  Without
labels of both kinds every score is the smoothed share of label 1 (0.5 for none).  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import cut, small_batches
from weft.llm.stats import base_stats, doc_of, lines
from weft.llm.textblock import Block, blocks

STATISTICS = (
    "log_words mean_word symbols upper dup_lines repeats same_as_last distinct stops shouts bars digits words_per_line not_ascii capitals odd_words".split()
)


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  #: labelled rows that are learnt from, at most (the first by a hash of doc_id)
    trees: int = 40
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    leaf: int = 15
    seed: int = 7
    penalties: tuple[float, ...] = (0.01, 0.004, 0.0015)
    threshold: float = 0.3
    enough: float = 0.01  #: boosting ends where the mean error on the sample is below


def statistics(block: Block) -> np.ndarray:
    """One row of STATISTICS for each document."""
    data, (start, end, code, first) = block.data, block.words
    base, doc = base_stats(block), doc_of(first)
    n, chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    is_upper = (data >= 65) & (data <= 90)
    accented = np.zeros(len(data), dtype=bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = is_upper | accented
    count = lambda *bytes_: block.per_doc(np.isin(data, bytes_))
    again = np.zeros(len(code), dtype=bool)
    number = block.numbers
    again[1:] = (number[1:] == number[:-1]) & (doc[1:] == doc[:-1])
    key = np.sort(doc << 32 | number)
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount(key[new] >> 32, minlength=block.n)
    line_doc = lines(block)[2]
    n_lines = np.maximum(np.bincount(line_doc, minlength=block.n), 1)
    per = lambda flags: np.bincount(doc[flags], minlength=block.n)
    lower_next = np.zeros(len(start), dtype=bool)
    at = np.minimum(start + 1, max(len(data) - 1, 0))
    lower_next[:] = (start + 1 < end) & (data[at] >= 97) & (data[at] <= 122) if len(data) else False
    letters = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0x80)
    letter_sum = np.concatenate([[0], np.cumsum(letters)])
    odd = 2 * (letter_sum[end] - letter_sum[start]) < end - start
    return np.stack(
        [
            np.log1p(base["n_words"]), base["word_chars"] / n, base["n_symbols"] / n, block.per_doc(upper) / chars, base["n_dup_lines"] / n_lines,
            base["n_repeat_words"] / n, per(again) / n, distinct / n, count(*b".,;:?") / n, count(*b"!") / n, count(*b"|") / n,
            count(*b"0123456789") / chars, n / n_lines, block.per_doc((data & 0xC0) == 0xC0) / chars, per(upper[start] & lower_next) / n if len(start) else np.zeros(block.n), per(odd) / n,
        ],
        axis=1,
    ).astype(float)


def described(documents: DataFrame) -> DataFrame:
    """doc_id and a column for each statistic."""

    def of(batches):
        for part, block in blocks(batches):
            table = statistics(block)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in table.T)], names=["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return small_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, schema)


# Learning, on the driver.

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether at most, bound) for each condition


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each statistic, the bounds a rule may use: middles between neighbouring quantiles."""
    out = []
    for column in x.T:
        q = np.quantile(column, np.linspace(0, 1, bins + 1))
        q = q[np.append(True, q[1:] > q[:-1])]
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(binned, gradient, hessian, rows, every, bounds, how: Settings, rules: set, path: Rule, out: np.ndarray) -> None:
    """Split ``rows`` on the best bound while it gains; add the path to each node to ``rules``, and the leaf's step to
    ``out`` for ``every`` row that comes there."""
    if path:
        rules.add(tuple(sorted(path)))
    best, split = 1e-6, None
    g, h = gradient[rows], hessian[rows]
    if len(path) < how.depth and len(rows) >= 2 * how.leaf:
        total = g.sum() ** 2 / (h.sum() + 1)
        for f in range(binned.shape[1]):
            if len(bounds[f]):
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(bounds[f]) + 1))[:-1] for w in (g, h, None))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - total
                gain[(ns < how.leaf) | (len(rows) - ns < how.leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, split = gain[k], (f, k)
    if split is None:
        out[every] -= how.rate * g.sum() / (h.sum() + 1)
        return
    f, k = split
    for at_most in (True, False):
        mine, all_ = ((r[(binned[r, f] <= k) == at_most]) for r in (rows, every))
        grow(binned, gradient, hessian, mine, all_, bounds, how, rules, (*path, (f, at_most, float(bounds[f][k]))), out)


def boost(x: np.ndarray, y: np.ndarray, how: Settings) -> list[Rule]:
    """The rules of all boosted trees, each grown on a part of the rows."""
    rng = np.random.default_rng(how.seed)
    bounds = cut_points(x, how.bins)
    binned = np.stack([np.searchsorted(b, c) for b, c in zip(bounds, x.T, strict=True)], axis=1)
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        if np.abs(p - y).mean() < how.enough:
            break
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        grow(binned, p - y, p * (1 - p), rows, np.arange(len(y)), bounds, how, rules, (), margin)
    return sorted(rules)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, at_most, bound in rule:
        out &= (x[:, f] <= bound) == at_most
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 150) -> np.ndarray:
    """Weights (the intercept first, not penalised) of logistic regression with an absolute-value penalty (FISTA)."""
    n, y = len(y), y.astype(np.float32)
    v = np.random.default_rng(0).random(z.shape[1]).astype(np.float32)
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        v = z.T @ (z @ v)
        size = np.linalg.norm(v)
        v /= size or 1
    rate = 4 * n / (1.05 * size + n)
    w = u = start.astype(np.float32)
    rate, penalty = np.float32(rate), np.float32(penalty)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(u[0] + z @ u[1:])))
        step = np.concatenate([[np.mean(p - y, dtype=np.float32)], z.T @ (p - y) / np.float32(n)])
        new = u - rate * step
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        u = new + np.float32((last - 1) / t) * (new - w)
        w = new
    return w.astype(float)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, column=F.col) -> Column:
        """The ensemble as a Spark expression over the statistics' columns."""

        def condition(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [column(STATISTICS[f]) <= F.lit(b) if m else column(STATISTICS[f]) > F.lit(b) for f, m, b in rule])

        parts = [F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.intercept))))


def fit(x: np.ndarray, y: np.ndarray, how: Settings = Settings()) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    # A fifth is kept from the trees as well as from the weights that the penalties are compared by.
    valid = np.random.default_rng(how.seed).random(len(y)) < 0.2
    grown = ~valid if y[~valid].min(initial=1) < y[~valid].max(initial=0) else np.ones(len(y), dtype=bool)
    rules = boost(x[grown], y[grown], how)
    z = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    spread = z.std(axis=0)
    keep = np.flatnonzero(spread > 0.005)
    z, spread, rules = z[:, keep], spread[keep], [rules[k] for k in keep]
    middle = z.mean(axis=0)
    z -= middle
    z /= spread
    path, w = [], np.zeros(z.shape[1] + 1)
    for penalty in how.penalties:
        w = lasso(z[grown], y[grown], penalty, w)
        p = 1 / (1 + np.exp(-(w[0] + z[valid] @ w[1:])))
        loss = -np.mean(np.where(y[valid] == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))) if valid.any() else 0.0
        path.append((loss, penalty))
    best = min(path)[1]
    w = np.zeros(z.shape[1] + 1)
    for penalty in how.penalties:
        w = lasso(z, y, penalty, w)
        if penalty == best:
            break
    weights = w[1:] / spread
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble(float(w[0] - (w[1:] / spread * middle).sum()), tuple((rules[k], float(weights[k])) for k in used))


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from labels of documents that aren't held out."""
    table = cut(described(documents))
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label")).dropna().filter(~is_held_out())
    marks = marks.groupBy("doc_id").agg(F.round(F.avg("label")).alias("label"))
    sample = table.join(marks, "doc_id").orderBy(F.xxhash64(F.lit(how.seed), "doc_id"), "doc_id", *STATISTICS).limit(how.sample).select("label", *STATISTICS)
    rows = sample.toArrow()
    x = np.stack([np.array(rows.column(s), dtype=float) for s in STATISTICS], axis=1)
    model = fit(x, np.array(rows.column("label"), dtype=float), how)
    scored = table.select("doc_id", is_held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= how.threshold).cast("int"))
