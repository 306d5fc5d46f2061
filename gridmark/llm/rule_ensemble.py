"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of small depth are grown on a bounded sample of labelled documents; every path from a root to a
node is a rule, a conjunction of bounds on statistics. A logistic model with an L1 penalty weighs the rules, most
of which get weight 0; the penalty is chosen on a part of the sample kept out of the fit. What is left is compiled
into one Spark column over the statistics, so that scoring is a plain projection.

Labels come from rows whose crc32(id as text) mod 5 isn't 0 (the others are held out); of these, at most ``most``,
those with the least hashes of their ids. Inputs of the score are the statistics alone.

Defined results. Null or empty text: the score of all-zero statistics. Null id: never labelled, not held out. Repeated
rows: a row each. Labels other than 0 and 1, null ids and ids without a document: skipped. Repeated ids: see ``train``. Labels of one kind only, or none:
every score is the share of label 1 (0.5 without labels). Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gridmark.llm.common import row_key, without
from gridmark.llm.text_stats import NAMES, measured

SAMPLE, TREES, DEPTH, BINS, RATE = 6000, 30, 3, 48, 0.3
CUT = 0.3

Rule = tuple[tuple[int, bool, float], ...]  # statistic, whether it is over the bound, bound


@dataclass
class Rules:
    base: float
    weighted: list[tuple[float, Rule]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for weight, rule in self.weighted:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def column(self) -> Column:
        total = F.lit(self.base)
        for weight, rule in self.weighted:
            test = F.lit(True)
            for k, over, bound in rule:
                test = test & ((F.col(NAMES[k]) > bound) if over else (F.col(NAMES[k]) <= bound))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, bound in rule:
        out &= (x[:, k] > bound) == over
    return out


def _bounds(x: np.ndarray) -> list[np.ndarray]:
    """Candidate bounds of each statistic: midpoints between neighbouring quantiles."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _grow(binned: np.ndarray, bounds: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, rule: Rule, depth: int, rules: set[Rule], out: np.ndarray) -> None:
    """Splits rows by the best bound; leaves get Newton steps in out, every node's path goes to rules."""
    if rule:
        rules.add(rule)
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-3, None)
    if depth and len(rows) >= 20:
        for k, cuts in enumerate(bounds):
            if not len(cuts):
                continue
            b = binned[rows, k]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(cuts) + 1))[:-1] for w in (gradient[rows], weight[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 5) | (len(rows) - nl < 5)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], (k, j))
    if best[1] is None:
        out[rows] = g / (h + 1)
        return
    k, j = best[1]
    over = binned[rows, k] > j
    for side in (False, True):
        _grow(binned, bounds, gradient, weight, rows[over == side], (*rule, (k, side, float(bounds[k][j]))), depth - 1, rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 1) -> list[Rule]:
    """Paths of boosted trees, each grown on half of the rows."""
    bounds = _bounds(x)
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T, strict=True)], 1)
    random, total, rules = np.random.default_rng(seed), np.zeros(len(y)), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        step = np.zeros(len(y))
        _grow(binned, bounds, y - p, p * (1 - p), rows, (), DEPTH, own := set(), step)
        for rule in own:
            rules.add(rule)
        # Rows outside the half get their leaf's step too: by the deepest rule that holds.
        leaf = {r: step[rows][holds(r, x[rows])] for r in own if not any(q[: len(r)] == r and q != r for q in own)}
        for r, values in leaf.items():
            if len(values):
                total[holds(r, x)] += RATE * values[0]
    return sorted(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Weights of standardised columns by accelerated proximal gradient; the base isn't penalised."""
    n, m = a.shape
    a1 = np.column_stack([np.ones(n), a])
    rate = 4 * n / (np.linalg.norm(a1, 2) ** 2 + 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a1 @ v, -30, 30)))
        u = v - rate * (a1.T @ (p - y) / n)
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        w, t = u, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Rules(float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    a = np.stack([holds(r, x) for r in rules], 1).astype(float)
    _, first = np.unique(a, axis=1, return_index=True)
    rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
    spread = np.maximum(a.std(0), 0.05)  # of rare rules only so much
    kept = np.arange(len(y)) % 4 == 0
    losses = []
    for penalty in (0.03, 0.01, 0.003, 0.001):
        base, w = lasso_logistic(a[~kept] / spread, y[~kept], penalty)
        s = np.clip(base + (a[kept] / spread) @ w, -30, 30)
        losses.append((np.mean(np.log1p(np.exp(-s)) * y[kept] + np.log1p(np.exp(s)) * (1 - y[kept])), penalty))
    base, w = lasso_logistic(a / spread, y, min(losses)[1])
    return Rules(base, [(float(v / d), r) for v, d, r in zip(w, spread, rules, strict=True) if abs(v) > 1e-6])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Rules:
    """The rules that the labelled sample gives; at most ``most`` labels are used, and their rows come to the driver.

    An id has one row of the sample: of labels that repeat it the least one counts, of documents the one with the least
    row_key. So the rules depend on the rows alone, not on how they are spread.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(label_col).cast("int").alias("y"))
    usable = usable.filter(F.col("y").isin(0, 1) & F.col("labelled").isNotNull() & ~held_out(F.col("labelled"))).groupBy("labelled").agg(F.min("y").alias("y"))
    sample = F.broadcast(usable.orderBy(F.xxhash64("labelled"), "labelled").limit(most))  # ``most`` rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = measured(texts.join(sample, F.col("id") == F.col("labelled"), "left_semi"), "id", "text", row_key(F.col("text")))
    one = known.groupBy("doc_id").agg(F.min(F.struct("row_key", *NAMES)).alias("s"))
    rows = sorted(one.join(sample, F.col("doc_id") == F.col("labelled")).select("doc_id", "y", "s.*").drop("row_key").collect())
    table = np.array([r[1:] for r in rows], float).reshape(len(rows), len(NAMES) + 1)
    return fit(table[:, 1:], table[:, 0])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    score = train(docs, labels, most, id_col=id_col, text_col=text_col).column()
    scored = measured(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """docs without the rows predicted 0; all columns as they were, whatever their names.

    Rows, not ids, go: a row is known by its id and its text, on which alone the score depends.
    """
    score = train(docs, labels, **options, id_col=id_col, text_col=text_col).column()
    scored = measured(docs, id_col, text_col, row_key(F.col(text_col))).select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), score.alias("score"))
    return without(docs, scored.filter(~(F.col("score") >= cut)), id_col, text_col)
