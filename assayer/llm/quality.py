"""A quality classifier of sparse rules: conjunctions from tree paths, lasso weights, compiled to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.scratch import table
from assayer.llm.toxicity import labelled_sample

#: Labelled rows that fitting reads at most; trees, their depth, candidate thresholds per statistic.
MAX_ROWS, TREES, DEPTH, CUTS = 20_000, 40, 3, 32

WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; each is finite, also for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    n_chars = F.greatest(F.length(text), F.lit(1))
    lines = F.greatest(F.regexp_count(text, F.lit("\n")) + 1, F.lit(1))

    def share(chars: str, of: Column) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / of

    return {
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(text) / n_words,
        "distinct": F.size(F.array_distinct(words)) / n_words,
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / n_chars,
        "junk": share("#$%&*|~^<>{}\\", n_words),
        "shout": share("!", n_words),
        "stops": share(".", n_words),
        "commas": share(",;", n_words),
        "digits": share("0123456789", n_chars),
        "bars": share("|", n_words),
        "symbols": share("!?#$%&*@=+_/\\<>[]{}()~^`\"", n_chars),
        "line_words": n_words / lines,
    }


@dataclass(frozen=True)
class RuleEnsemble:
    """score = sigmoid(bias + sum of the weights of the rules that hold); a rule: ((statistic, is above, cut), ...)."""

    bias: float
    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]

    def column(self, stats: str) -> Column:
        """The score over a struct column of the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, cut in rule:
                value = F.col(stats)[name]
                holds = holds & ((value > cut) if above else (value <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _best_split(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float]:
    best = (1e-9, -1, 0.0)
    g, h = slope.sum(), curve.sum()
    for f, values in enumerate(cuts):
        if not len(values):
            continue
        place = np.searchsorted(values, x[:, f], "left")
        left_g = np.cumsum(np.bincount(place, slope, len(values) + 1))[:-1]
        left_h = np.cumsum(np.bincount(place, curve, len(values) + 1))[:-1]
        gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
        gain[(left_h < 0.5) | (h - left_h < 0.5)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(values[k]))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[tuple]:
    """The paths to all nodes of gradient-boosted trees on half samples, without repeats."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, CUTS))) for f in range(x.shape[1])]
    score, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        half = rng.random(len(y)) < 0.5

        def grow(rows: np.ndarray, path: tuple, left: int, slope=slope, curve=curve, half=half) -> None:
            used = rows & half
            gain, f, cut = _best_split(x[used], slope[used], curve[used], cuts) if left else (0, -1, 0.0)
            if path:
                rules.setdefault(tuple(sorted(path)), None)
            if f < 0:
                score[rows] += 0.3 * slope[used].sum() / (curve[used].sum() + 1)
                return
            above = x[:, f] > cut
            grow(rows & ~above, (*path, (names[f], False, cut)), left - 1)
            grow(rows & above, (*path, (names[f], True, cut)), left - 1)

        grow(np.ones(len(y), bool), (), depth)
    return list(rules)


def rule_matrix(x: np.ndarray, names: list[str], rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for name, above, cut in rule:
            column = x[:, names.index(name)]
            out[:, k] *= (column > cut) if above else (column <= cut)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the logistic loss with an absolute penalty; the bias goes free."""
    n, k = r.shape
    centre = r.mean(0)
    z = r - centre
    step = 4 * n / max(1e-9, float(np.linalg.norm(z.T @ z, 2)))
    bias, w = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(k)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(bias + z @ v)))
        bias += 4 * float((y - p).mean()) * 0.5
        ahead = v + step * (z.T @ (y - p)) / n
        new = np.sign(ahead) * np.maximum(np.abs(ahead) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return bias - float(centre @ w), w


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fits on labelled_sample(docs, labels): at most max_rows labelled documents.

    Statistics are computed by Spark over the whole texts; the driver gets one short row of numbers per labelled
    document of the sample. No labelled row, or one label only: a constant.
    """
    stats = statistics(F.col("text"))
    sample = labelled_sample(docs, labels, "quality", max_rows)
    rows = sample.select(*(c.cast("double").alias(n) for n, c in stats.items()), "label").toArrow()
    names = list(stats)
    y = rows.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), (), ())
    x = np.stack([rows.column(n).to_numpy() for n in names], 1)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    rules = tree_rules(x, y, names)
    bias, weights = lasso_logistic(rule_matrix(x, names, rules), y)
    kept = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]
    return RuleEnsemble(bias, tuple(r for r, _ in kept), tuple(w for _, w in kept))


def score_quality(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs' columns with score, one row per input row; only the text counts. Null text: as empty."""
    keep = [c for c in docs.columns if c != "score"]
    stats = statistics(F.col("text"))
    wide = docs.select(F.struct(*keep).alias("row"), F.struct(*(c.cast("double").alias(n) for n, c in stats.items())).alias("stats"))
    return wide.select("row.*", model.column("stats").alias("score"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit_quality(docs, labels.where(~held_out))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
