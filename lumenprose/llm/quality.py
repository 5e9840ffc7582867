"""Operator 2: quality by a sparse rule ensemble, compiled to Spark columns.

Statistics of each whole text are Spark expressions. Small boosted trees are grown on a bounded sample of labelled rows;
each path from a root to a node is a conjunctive rule over the statistics; a lasso-penalised logistic fit leaves few
rules with a weight; these become one Spark column, so that scoring runs inside the JVM without Python.

Learning reads at most ``SAMPLE`` labelled rows whose crc32(doc_id) mod 5 is not 0, and one text for each of these ids (the
one of the smallest hash): a documented bound. The lasso's penalty alone decides how many rules keep a weight. Labels, lang,
source and doc_id are no inputs.

Defined cases: null texts are empty; an empty text has statistics of 0 and gets a score like any other; each row is scored by
its own whole text, however long, so repeated rows and ties have equal scores; no rows give no rows; other columns are
neither read nor changed, whatever their names; labels that are null, or whose id is null, are not used, of an id that is
labelled both ways the label 1 counts. Without labelled rows of both classes the score is the share of 1 (1 if there
are none), and so it is where they are too few, or too alike, for a rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, stored, table
from .toxicity import sample_of, sampled_texts

SAMPLE = 12_000
THRESHOLD = 0.3
TREES, DEPTH, BINS = 40, 3, 32
#: The lasso's penalty on the mean logistic loss.
PENALTY = 0.008


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, each a double."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"\n"), lambda x: x != "")

    def share(rx: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, rx, ""))) / n

    def share_of(marks: str) -> Column:
        left = sum((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit(""))) for m in marks[1:]), F.length(text) - F.length(F.replace(text, F.lit(marks[0]), F.lit(""))))
        return left / n

    solid = F.length(F.regexp_replace(text, r"\s+", ""))

    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": solid / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_length": n / n_lines,
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "accents": share(r"[À-ɏ]"),
        "symbols": share(r"[#$%&*+=<>@^~_/\\{}\[\]]"),
        "bars": share_of("|"),
        "marks": share_of("!?"),
        "stops": share_of("."),
        "commas": share_of(","),
        "spaces": (F.length(text) - solid) / n,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 2)) / n_words,
        "capital_words": F.size(F.regexp_extract_all(text, F.lit(r"(?<![^\s])\p{Lu}"), F.lit(0))) / n_words,
    }


NAMES = ["log_chars", "word_length", "distinct_words", "distinct_lines", "line_length", "upper", "digits", "accents", "symbols", "bars", "marks", "stops", "commas", "spaces", "short_words", "capital_words"]

#: A condition: (index of a statistic, threshold, whether the value must be above it).
Condition = tuple[int, float, bool]


@dataclass
class RuleModel:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as one column expression over the statistics."""
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, at, above in rule:
                value = stats[NAMES[k]]
                test = test & ((value > at) if above else (value <= at))
            z = z + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, at, above in rule:
        out &= (x[:, k] > at) if above else (x[:, k] <= at)
    return out


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], depth: int, out: list, step: np.ndarray) -> None:
    """One regression tree on gradients by histograms; each node's path is a rule."""
    G, H = g[rows].sum(), h[rows].sum()
    best = (1e-3, -1, 0)
    if depth and len(rows) >= 20:
        for k in range(codes.shape[1]):
            m = len(cuts[k]) + 1
            c = codes[rows, k]
            gl, hl, nl = (np.cumsum(np.bincount(c, v, m))[:-1] for v in (g[rows], h[rows], None))
            if len(gl):
                gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                gain[(nl < 8) | (len(rows) - nl < 8)] = 0
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
    if best[1] < 0:
        step[rows] = -G / (H + 1)
        return
    _, k, at = best
    left = codes[rows, k] <= at
    for side, above in ((rows[left], False), (rows[~left], True)):
        rule = (*path, (k, float(cuts[k][at]), above))
        out.append(rule)
        _grow(x, codes, cuts, g, h, side, rule, depth - 1, out, step)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Boosted trees -> rules -> lasso logistic weights."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1 - 1e-6
        return RuleModel([], [], math.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    rules: list[tuple[Condition, ...]] = []
    p0 = y.mean()
    z = np.full(len(y), math.log(p0 / (1 - p0)))
    rng = np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), max(1, len(y) * 7 // 10), replace=False))
        found: list[tuple[Condition, ...]] = []
        _grow(x, codes, cuts, p - y, p * (1 - p), rows, (), depth, found, step)
        rules += found
        z += 0.3 * step
    distinct: dict[bytes, tuple[Condition, ...]] = {}
    for r in rules:  # rules that hold for the same rows are one rule; the shortest is kept
        key = np.packbits(_holds(r, x)).tobytes()
        if key not in distinct or len(r) < len(distinct[key]):
            distinct[key] = r
    rules = list(distinct.values())
    if not rules:  # too few rows, or rows with equal statistics: no node was divided
        return RuleModel([], [], math.log(p0 / (1 - p0)))
    a = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float32)
    scale = np.maximum(a.std(axis=0), 1e-3)
    mean = a.mean(axis=0)
    a = (a - mean) / scale
    w, bias = np.zeros(a.shape[1]), math.log(p0 / (1 - p0))
    w, bias = _lasso(a, y, penalty)
    kept = np.flatnonzero(w)
    # weights without the penalty's shrinkage, on the kept rules only
    v, bias = _lasso(a[:, kept], y, 0.0002)
    real = v / scale[kept]
    return RuleModel([rules[i] for i in kept], real.tolist(), float(bias - (real * mean[kept]).sum()))


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps on the logistic loss with an l1 penalty; the bias has none."""
    n, m = a.shape
    u = np.ones(m) / math.sqrt(max(m, 1))
    for _ in range(12):
        u = a.T @ (a @ u)
        u /= np.linalg.norm(u) + 1e-12
    rate = 1 / (0.25 * (float(np.linalg.norm(a @ u)) ** 2 / n + 1) * 1.05)
    w, b = np.zeros(m), math.log(y.mean() / (1 - y.mean()))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(a @ v + c))) - y) / n
        w2 = v - rate * (a.T @ r)
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - rate * penalty)
        b2 = c - rate * r.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    # the sampled texts are written first, so that the statistics are computed for them only
    texts = stored(sampled_texts(docs, sample_of(labels, "quality", sample)).repartition(16), "quality-sample")
    stats = statistics(F.col("text"))
    rows = texts.select("doc_id", "y", *(stats[k].alias(k) for k in NAMES)).toPandas()
    rows = rows.sort_values(["doc_id", *NAMES])
    return fit(rows[NAMES].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, score) of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stats = statistics(text)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(stats[k].alias(k) for k in NAMES)).alias("s"))
    return known.select("doc_id", model.column({k: F.col(f"s.{k}") for k in NAMES}).alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    model = learn(docs, labels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = set(docs.columns)
    stats, row = (next(f"{x}{i}" for i in range(len(taken) + 1) if f"{x}{i}" not in taken) for x in ("_stats", "_row"))
    # a projection with a row number: the planner doesn't push the test below it, where each statistic would be computed for each rule
    known = F.struct(*(c.alias(k) for k, c in statistics(text).items())).alias(stats)
    with_stats = docs.select(*(F.col(f"`{c}`") for c in docs.columns), known, F.monotonically_increasing_id().alias(row))
    good = model.column({k: F.col(f"{stats}.{k}") for k in NAMES}) >= threshold
    return with_stats.filter((F.col(row) >= 0) & good).drop(stats, row)
