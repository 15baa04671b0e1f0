"""Quality classifier: a sparse ensemble of rules.

Small boosted trees are grown on statistics of labelled texts. Every path from a root to a node is a
rule, a conjunction of comparisons. A logistic regression with an L1 penalty weighs the rules; those with a weight
other than zero are compiled into one Spark column expression over the statistics.

Scale: the statistics are column expressions, computed where a text is read; scoring is one pass
without a shuffle. The fit alone is bounded: it takes ``MAX_ROWS`` labelled rows, the first
by a hash of their id, so it needs no more memory for a larger corpus. Their ids are broadcast.

Edge cases: a null or empty text has statistics of 0 and is scored like any other; a repeated label
counts as its largest value; labels of absent documents and null labels are ignored; without labelled rows
the score is 0.5, with labels of one kind the smoothed share of that kind; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, content, fold, with_value, words

MAX_ROWS = 20_000
TREES = 24
DEPTH = 3
BINS = 24
LEARNING_RATE = 0.3
PENALTY = 0.001
ITERATIONS = 400
THRESHOLD = 0.3


# --- Statistics of a text ----------------------------------------------------------------------


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name; all are doubles, 0 for an empty text."""
    plain = content(text)
    n_chars = F.length(F.regexp_replace(plain, SPACES, ""))

    def characters(kind: str) -> Column:
        return share(F.length(F.regexp_replace(plain, f"[^{kind}]+", "")), n_chars)

    def words_of(w: Column) -> Column:
        n = F.size(w)
        n_pairs = n - 1
        pairs = F.transform(
            F.when(n > 1, F.sequence(F.lit(1), n_pairs)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)),
        )
        return F.struct(
            n.cast("double").alias("n_words"),
            share(F.size(F.array_distinct(w)), n).alias("distinct_words"),
            share(F.size(F.array_distinct(pairs)), n_pairs).alias("distinct_pairs"),
            share(
                F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))), n
            ).alias("same_as_last"),
            share(F.size(F.filter(w, lambda x: F.length(x) <= 3)), n).alias("short_words"),
        )

    def lines_of(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(
            n.cast("double").alias("n_lines"),
            share(F.size(F.array_distinct(lines)), n).alias("distinct_lines"),
        )

    w = with_value(words(text), words_of)
    lines = with_value(
        F.filter(F.split(plain, "\n"), lambda x: x.rlike("[^ \\t-\\r]")), lines_of
    )
    return {
        **{
            name: w[name]
            for name in (
                "n_words", "distinct_words", "distinct_pairs", "same_as_last", "short_words",
            )
        },
        **{name: lines[name] for name in ("n_lines", "distinct_lines")},
        "word_length": share(n_chars, F.size(words(text))),
        "upper": characters("A-Z"),
        "digits": characters("0-9"),
        "stops": characters(".,;:?"),
        "exclaims": characters("!"),
        "bars": characters("|"),
        "symbols": characters("#*$%&<>"),
        "not_ascii": characters("^\\x00-\\x7F"),
    }


STATISTICS = (
    "n_words", "distinct_words", "distinct_pairs", "same_as_last", "short_words", "n_lines",
    "distinct_lines", "word_length", "upper", "digits", "stops", "exclaims", "bars", "symbols",
    "not_ascii",
)


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(
        *keep,
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"stat_{n}")
          for n, c in statistics(F.col("text")).items()],
    )


# --- Rules from trees --------------------------------------------------------------------------


@dataclass(frozen=True, order=True)
class Condition:
    """``statistic <= bound`` or, with ``above``, ``statistic > bound``."""

    statistic: int
    bound: float
    above: bool


Rule = tuple[Condition, ...]


def grow(x, binned, bounds, gradient, hessian, rows, path, depth, rules) -> np.ndarray:
    """Grow one tree of the boosting; add the paths of its nodes; return the rows' new margins."""
    if path:
        rules.append(tuple(sorted(set(path))))
    total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
    leaf = np.zeros(len(gradient))
    leaf[rows] = total_g / (total_h + 1.0)
    if depth == 0 or len(rows) < 40:
        return leaf
    best, choice = 1e-6, None
    for j in range(x.shape[1]):
        g = np.bincount(binned[rows, j], gradient[rows], BINS + 1).cumsum()[:-1]
        h = np.bincount(binned[rows, j], hessian[rows], BINS + 1).cumsum()[:-1]
        n = np.bincount(binned[rows, j], minlength=BINS + 1).cumsum()[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain = np.where((n >= 10) & (len(rows) - n >= 10), gain, 0.0)[: len(bounds[j])]
        if len(gain) and gain.max() > best:
            best, choice = gain.max(), (j, int(gain.argmax()))
    if choice is None:
        return leaf
    j, cut = choice
    below = binned[rows, j] <= cut
    out = np.zeros(len(gradient))
    for above, part in ((False, rows[below]), (True, rows[~below])):
        condition = Condition(j, float(bounds[j][cut]), above)
        out += grow(
            x, binned, bounds, gradient, hessian, part, [*path, condition], depth - 1, rules
        )
    return out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct rules of all trees."""
    bounds = [
        np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])
    ]
    binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], 1)
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        margin += LEARNING_RATE * grow(
            x, binned, bounds, y - p, p * (1 - p), np.arange(len(y)), [], DEPTH, rules
        )
    return sorted(set(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, [(x[:, c.statistic] > c.bound) == c.above for c in rule])


def lasso_weights(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty (accelerated gradient)."""
    n, k = r.shape
    centre, spread = r.mean(0), np.maximum(r.std(0), 0.05)
    z = (r - centre) / spread
    step = 4.0 / (np.linalg.norm(z.T @ z, 2) / n + 1)
    w, b, t = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), 1.0
    ahead_w, ahead_b = w, b
    for _ in range(ITERATIONS):
        error = 1 / (1 + np.exp(-(z @ ahead_w + ahead_b))) - y
        moved = ahead_w - step * (z.T @ error) / n
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = ahead_b - step * error.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + (t - 1) / new_t * (new_w - w)
        ahead_b = new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b - float((w / spread) @ centre), w / spread


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of a good text, over the columns of ``with_statistics``."""
        def condition(c: Condition) -> Column:
            value = F.col(f"stat_{STATISTICS[c.statistic]}")
            return value > c.bound if c.above else value <= c.bound

        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(reduce(and_, map(condition, rule)), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y):
        return RuleModel(0.0, ())
    if y.min() == y.max():
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    rules = tree_rules(x, y)
    if not rules:
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    intercept, weights = lasso_weights(np.stack([holds(r, x) for r in rules], 1).astype(float), y)
    return RuleModel(
        intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0)
    )


# --- The operator ------------------------------------------------------------------------------


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    """Fit the rules on at most ``max_rows`` labelled documents outside the held-out fold."""
    sample = (
        labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = (
        with_statistics(found, "doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "stat_n_words", "stat_word_length")
        .limit(max_rows)
        .toPandas()
    )
    x = rows[[f"stat_{n}" for n in STATISTICS]].to_numpy(float)
    return fit(x, (rows["quality"].to_numpy() == 1).astype(float))


def classified(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    return with_statistics(docs, "doc_id").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        model.score().alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    scored = with_statistics(docs.withColumn("row", F.struct("*")), "row")
    return scored.filter(model.score() >= threshold).select("row.*")
