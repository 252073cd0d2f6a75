"""Operator 9: quality by a sparse rule ensemble, compiled to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .line_rules import SYMBOLS, blank, let, n_of, words

#: Labelled rows that a fit takes at most, those of the least hashes.
MAX_TRAIN = 20_000


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, carried columns and text statistics (f_...) for every row of docs; a null text is an empty one."""
    text = F.col("text")
    base = docs.select("doc_id", *carried, F.coalesce("text", F.lit("")).alias("text"))
    cut = base.select("doc_id", *carried, "text", words(text).alias("w"), F.filter(F.split("text", "\n"), lambda x: ~blank(x)).alias("lines"))
    chars, n, n_lines = F.length("text"), F.size("w"), F.size("lines")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))
    pairs = F.when(n < 2, F.lit(0)).otherwise(let(F.col("w"), lambda a: F.size(F.array_distinct(F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.xxhash64(x, y))))))
    return cut.select(
        "doc_id",
        *carried,
        F.log1p(n.cast("double")).alias("f_words"),
        share(F.length(F.array_join("w", "")), n).alias("f_word_length"),
        share(F.size(F.array_distinct("w")), n).alias("f_distinct_words"),
        share(pairs, n).alias("f_distinct_pairs"),
        share(F.size(F.array_distinct("lines")), n_lines).alias("f_distinct_lines"),
        share(n, n_lines).alias("f_line_words"),
        share(n_of(text, SYMBOLS), n).alias("f_symbols"),
        share(n_of(text, "|"), n).alias("f_bars"),
        share(n_of(text, "!?"), n).alias("f_marks"),
        share(n_of(text, ".,;:"), n).alias("f_stops"),
        share(n_of(text, "0123456789"), chars).alias("f_digits"),
        share(n_of(text, "{}[]()=_/\\@^~`+\"'"), chars).alias("f_code"),
        share(upper, chars).alias("f_upper"),
    )


@dataclass
class Rule:
    """A conjunction: tests (feature, at_most?, threshold)."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, below, t in self.tests:
            out &= (x[:, j] <= t) if below else (x[:, j] > t)
        return out


@dataclass
class RuleEnsemble:
    features: list[str]
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a Column over the statistics."""
        z = F.lit(float(self.intercept))
        for r in self.rules:
            test = F.lit(True)
            for j, below, t in r.tests:
                test = test & ((F.col(self.features[j]) <= float(t)) if below else (F.col(self.features[j]) > float(t)))
            z = z + F.when(test, F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, path: tuple, out: list, rows: np.ndarray) -> np.ndarray:
    """A regression tree on the gradient; adds the path of every node below the root to out; its step for each row."""
    step = np.zeros(len(grad))
    step[rows] = grad[rows].sum() / (hess[rows].sum() + 1.0)
    if not depth or len(rows) < 2 * least:
        return step
    best, g, h, total, weight = (1e-6, None), grad[rows], hess[rows], grad[rows].sum(), hess[rows].sum()
    gain = lambda a, b: a * a / (b + 1.0)
    for j, edges in enumerate(bins):
        if not len(edges):
            continue
        c, m = codes[rows, j], len(edges) + 1
        left_g, left_h, left_n = (np.cumsum(np.bincount(c, v, m))[:-1] for v in (g, h, None))
        ok = (left_n >= least) & (len(rows) - left_n >= least)
        score = np.where(ok, gain(left_g, left_h) + gain(total - left_g, weight - left_h) - gain(total, weight), -1.0)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (score[k], (j, k))
    if best[1] is None:
        return step
    j, k = best[1]
    low = codes[rows, j] <= k
    for side, below in ((rows[low], True), (rows[~low], False)):
        tests = (*path, (j, below, float(bins[j][k])))
        out.append(tests)
        step[side] = _grow(x, bins, codes, grad, hess, depth - 1, least, tests, out, side)[side]
    return step


def fit(x: np.ndarray, y: np.ndarray, features: list[str], trees: int = 30, depth: int = 3, penalty: float = 0.002, rounds: int = 400) -> RuleEnsemble:
    """Boosted trees give the rules, a lasso logistic regression (accelerated proximal steps) their weights.

    Without rows, or with one label only, the score is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = RuleEnsemble(features, float(np.log(share / (1 - share))))
    if len(y) < 4 or y.min() == y.max():
        return model
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    bins = [b[b < c.max()] for b, c in zip(bins, x.T, strict=True)]
    codes = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bins, x.T, strict=True)], 1)
    z, paths, least = np.full(len(y), model.intercept), [], max(2, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        z = z + 0.3 * _grow(x, bins, codes, y - p, p * (1 - p), depth, least, (), paths, np.arange(len(y)))
    rules = [Rule(t) for t in dict.fromkeys(paths)]
    held = np.stack([r.holds(x) for r in rules], 1)
    _, first = np.unique(np.packbits(held, axis=0), axis=1, return_index=True)  # of rules that hold alike, one
    rules, held = [rules[i] for i in sorted(first)], held[:, sorted(first)].astype(np.float32)
    spread = held.std(0) + 1e-3
    a = (held - held.mean(0)) / spread
    w, b, v, vb, t = np.zeros(a.shape[1]), model.intercept, np.zeros(a.shape[1]), model.intercept, 1.0
    power = np.ones(a.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, for the step
        power = a.T @ (a @ power)
        power /= np.linalg.norm(power) + 1e-12
    rate = 1 / (0.25 * (np.linalg.norm(a @ power) ** 2 / len(y) + 1))
    for _ in range(rounds):
        err = 1 / (1 + np.exp(-(a @ v + vb))) - y
        new = v - rate * (a.T @ err / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, nt = vb - rate * err.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    model.intercept = float(b - (w / spread * held.mean(0)).sum())
    model.rules = [Rule(r.tests, float(c)) for r, c in zip(rules, w / spread, strict=True) if c]
    return model


def train_rows(scored: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """Up to `most` rows of scored with a label, outside the held-out fold; those of the least hashes of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(label).alias("_label"))
    # Labels hold an id and a number a row; a bounded choice of them joins the wide side.
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return scored.join(F.broadcast(some), "doc_id")


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most: int = MAX_TRAIN) -> RuleEnsemble:
    """A rule ensemble from the statistics of at most `most` labelled rows outside the held-out fold."""
    rows = statistics(train_rows(docs.select("doc_id", "text"), labels, "quality", folds, held, most), "_label")
    names = [c for c in rows.columns if c.startswith("f_")]
    seen = rows.select(*names, "_label").toPandas().sort_values([*names, "_label"])  # the same model whatever the order of rows
    return fit(seen[names].to_numpy(float).reshape(-1, len(names)), seen["_label"].to_numpy(float), names)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most: int = MAX_TRAIN) -> tuple[DataFrame, RuleEnsemble]:
    """(doc_id, held_out, score) for every row of docs, and the model.

    Null and empty texts get the score of their (zero) statistics; repeated rows stay; a null doc_id can't be labelled
    and is never held out.
    """
    model = train(docs, labels, folds, held, most)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return statistics(docs).select("doc_id", out.alias("held_out"), model.column().alias("score")), model


def keep(docs: DataFrame, model: RuleEnsemble, cut: float) -> DataFrame:
    """The rows of docs that score `cut` or more, scored where they are read.

    An explode, not a filter: Catalyst would push a filter below the statistics and compute them at every mention.
    """
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    scored = statistics(docs.select("doc_id", "text", row), "_row")
    return scored.select(F.explode(F.when(model.column() >= cut, F.array("_row")).otherwise(F.array().cast(f"array<{scored.schema['_row'].dataType.simpleString()}>"))).alias("_row")).select("_row.*")
