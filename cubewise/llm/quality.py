"""Text quality with a sparse ensemble of rules.

Statistics of every text are Spark column expressions. Small trees are grown
on a bounded sample of labelled rows by gradient boosting; every path from a
root is a rule, a conjunction of limits on statistics. A logistic model with
an L1 penalty gives most rules no weight; the rest are compiled into one
Spark column expression, so that scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import fold
from .scratch import Scratch, read_table

#: Labelled rows that the classifier is fitted on, at most: those smallest by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
PENALTY = 5e-4
SYMBOLS = r"[#$%&*@^~=+<>_\\/{}\[\]]+"


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one column for each statistic of ``docs(doc_id, text)``.
    Shares are of characters or words; a null or empty text has 0 everywhere."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    chars, n, m = F.length(text), F.size(words), F.size(lines)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def kind(pattern: str) -> Column:
        return share(chars - F.length(F.regexp_replace(text, pattern, "")), chars)

    def mark(of: str) -> Column:
        return share(chars - F.length(F.replace(text, F.lit(of), F.lit(""))), chars)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .select("doc_id", "text", F.array_remove(F.split(text, r"\s+"), "").alias("words"), F.array_remove(F.split(text, "\n"), "").alias("lines")) \
        .select("doc_id", chars.cast("double").alias("chars"), n.cast("double").alias("words_all"),
                share(chars, n).alias("word_chars"), share(n, m).alias("line_words"),
                share(F.size(F.array_distinct(words)), n).alias("distinct_words"), share(F.size(F.array_distinct(lines)), m).alias("distinct_lines"),
                kind(r"\p{Lu}+").alias("upper"), kind(r"[0-9]+").alias("digits"), kind(r"\p{L}+").alias("letters"), kind(SYMBOLS).alias("symbols"),
                mark("|").alias("bars"), mark("!").alias("shouts"), mark(".").alias("stops"), mark(",").alias("commas"))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """All of ``(statistic, limit, above)`` hold: > limit if above, else <=."""

    limits: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, limit, above in self.limits:
            v = x[:, names.index(name)]
            out &= (v > limit) if above else (v <= limit)
        return out

    def column(self) -> Column:
        out = None
        for name, limit, above in self.limits:
            one = F.col(name) > F.lit(limit) if above else F.col(name) <= F.lit(limit)
            out = one if out is None else out & one
        return out


@dataclass(frozen=True)
class Ensemble:
    base: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1, of the statistics' columns."""
        terms = [F.lit(float(self.base)), *(F.when(r.column(), F.lit(float(r.weight))).otherwise(F.lit(0.0)) for r in self.rules)]
        while len(terms) > 1:  # added in pairs: a deep expression costs the driver memory for each of its levels
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
        return 1 / (1 + F.exp(-terms[0]))


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, names: list[str]):
    """One tree: the rules of all its nodes, and its values on all rows."""
    rules, values = [], np.zeros(len(grad))

    def split(rows: np.ndarray, limits: tuple, depth: int) -> None:
        g, h = grad[rows], hess[rows]
        if limits:
            rules.append(limits)
        best = (1e-6, None, None)
        if depth < DEPTH and len(rows) >= 20:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gl, hl = (np.cumsum(np.bincount(b, w, BINS))[:-1] for w in (g, h))
                count = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                gain = gl**2 / (hl + 1) + (g.sum() - gl)**2 / (h.sum() - hl + 1) - whole
                gain[(count < 10) | (count > len(rows) - 10)] = 0
                gain[len(edges[f]):] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            values[rows] = -g.sum() / (h.sum() + 1)
            return
        _, f, k = best
        below = binned[rows, f] <= k
        limit = (names[f], float(edges[f][k]))
        split(rows[below], (*limits, (*limit, False)), depth + 1)
        split(rows[~below], (*limits, (*limit, True)), depth + 1)

    split(np.arange(len(grad)), (), 0)
    return rules, values


def _shorten(limits: tuple) -> tuple:
    """One limit for each statistic and side."""
    kept: dict[tuple[str, bool], float] = {}
    for name, limit, above in limits:
        old = kept.get((name, above), limit)
        kept[name, above] = max(old, limit) if above else min(old, limit)
    return tuple(sorted((n, v, a) for (n, a), v in kept.items()))


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """Rules and weights from rows of statistics and 0/1 labels. Without rows
    of both labels the score is the labels' mean (0.5 without any)."""
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else float(np.clip(y.mean(), 0.01, 0.99))
        return Ensemble(float(np.log(p / (1 - p))), ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, None] = {}
    rng = np.random.default_rng(3)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        use = rng.random(len(y)) < 0.7
        rules, values = _grow(binned, edges, (p - y) * use, np.maximum(p * (1 - p), 1e-6) * use, names)
        margin += RATE * values
        found.update(dict.fromkeys(map(_shorten, rules)))
    rules = [Rule(limits) for limits in found]
    hits = np.stack([r.holds(x, names) for r in rules], axis=1)
    _, first = np.unique(np.packbits(hits, axis=0), axis=1, return_index=True)
    rules, hits = [rules[i] for i in sorted(first)], hits[:, sorted(first)].astype(np.float32)
    weights, base = _lasso(hits, y.astype(np.float32))
    return Ensemble(base, tuple(Rule(r.limits, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def _lasso(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient steps."""
    n = len(y)
    ones = np.concatenate([z, np.ones((n, 1), np.float32)], axis=1)
    v = np.ones(ones.shape[1], np.float32)
    for _ in range(15):  # largest eigenvalue, for the step
        v = ones.T @ (ones @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (ones.T @ (ones @ v)))
    w = np.zeros(ones.shape[1], np.float32)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        grad = ones.T @ (1 / (1 + np.exp(-(ones @ ahead))) - y) / n
        new = ahead - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * PENALTY, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (old - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


# ---------------------------------------------------------------- operator


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fit on the ``sample`` labelled rows (``labels(doc_id, quality)``) that
    are smallest by a hash of their id; only their statistics reach the
    driver, of a doc_id on several rows those of the smallest. Rows with a null
    label or id teach nothing."""
    names = [c for c in stats.columns if c != "doc_id"]
    chosen = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = stats.join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("of")).orderBy("doc_id", "quality").collect()
    x = np.array([[r["of"][n] for n in names] for r in rows], np.float64).reshape(len(rows), len(names))
    return fit(x, np.array([r["quality"] for r in rows], np.float64), names)


def quality_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id,
    text)``; labels of held-out rows are not learnt from. Null and empty texts
    are scored by their (zero) statistics; repeated rows each; other columns
    are ignored; an empty table gives no rows."""
    stats = scratch.save(text_statistics(docs))
    model = learn(stats, labels.where(fold("doc_id", 3) != 1))
    out = stats.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), Scratch(spark, "quality"))
