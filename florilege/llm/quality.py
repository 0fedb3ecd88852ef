"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class gets a mean and a covariance, shrunk towards the pooled covariance and then towards its own mean variance.
A score is the difference of the two Mahalanobis log-densities, from Cholesky factors that are computed once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from florilege.llm.common import fold, labelled_sample, packed, with_labels

FOLDS, HELD = 3, 1
#: Most labelled rows that the model is fitted on, taken in the order of the hash of their id.
SAMPLE = 12_000
_MARKS = re.compile(r"[^\w\s.,;:'\"()?-]")
STATISTICS = 14


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text; all are finite and 0 for an empty one."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * STATISTICS
    counts = Counter(words)
    letters = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = len(_MARKS.findall(text))
    upper = sum(1 for c in words if c.isupper() and len(c) > 1)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    single = sum(1 for c in counts if len(c) == 1 and not c.isalnum())
    ends = text.count(".") + text.count("?") + text.count("!")
    small = lambda x: float(np.log1p(200.0 * x))  # noqa: E731 - shares crowd near zero
    return [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        letters / n / 10.0,
        small(marks / chars),
        small(upper / n),
        small(sum(map(text.count, "0123456789")) / chars),
        small(text.count("!") / n),
        float(np.log1p(len(counts)) / np.log1p(n)),
        small(repeated / n),
        small(1.0 - len(set(lines)) / len(lines) if lines else 0.0),
        small(sum(counts[c] for c in counts if len(c) == 1 and not c.isalnum()) / n) + 0.1 * single,
        sum(k for w, k in counts.items() if len(w) <= 3) / n,
        float(np.log1p(n / (1 + ends))),
        small((text.count(",") + text.count(".")) / n),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(statistics)


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: per class a mean, the inverse Cholesky factor of its covariance and a log weight."""

    middle: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        x = np.clip((rows - self.middle) / self.spread, -8.0, 8.0)
        logs = [w - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, w in zip(self.means, self.factors, self.weights, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _density(x: np.ndarray, y: np.ndarray, own: float, even: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pooled = np.zeros((x.shape[1], x.shape[1]))
    means, covs, counts = [], [], []
    for c in (0, 1):
        part = x[y == c]
        mean = part.mean(axis=0) if len(part) else np.zeros(x.shape[1])
        scatter = (part - mean).T @ (part - mean)
        pooled += scatter
        means.append(mean), covs.append(scatter), counts.append(len(part))
    pooled /= max(1, len(x))
    factors, weights = [], []
    for c in (0, 1):
        cov = (1 - own) * covs[c] / max(1, counts[c]) + own * pooled
        cov = (1 - even) * cov + (even * np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        weights.append(np.log((counts[c] + 1) / (len(x) + 2)) - np.log(np.diag(low)).sum())
    return np.array(means), np.array(factors), np.array(weights)


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Choose the two shrinkages by log-loss on every fourth row and fit on all. No rows: every score is 0.5."""
    if not len(x):
        x, y = np.zeros((2, STATISTICS)), np.array([0, 1])
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - middle) / spread, -8.0, 8.0)
    test = np.arange(len(z)) % 4 == 3
    best = (np.inf, 0.5, 0.1)
    if test.any() and len(set(y[~test])) == 2:
        for own in (0.05, 0.2, 0.5, 0.8):
            for even in (0.01, 0.05, 0.2):
                p = np.clip(Discriminant(np.zeros(1), np.ones(1), *_density(z[~test], y[~test], own, even)).scores(z[test]), 1e-6, 1 - 1e-6)
                best = min(best, (-np.log(np.where(y[test] == 1, p, 1 - p)).mean(), own, even))
    return Discriminant(middle, spread, *_density(z, y, *best[1:]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Discriminant:
    """Fit on at most ``most`` labelled rows outside the held-out fold; only their statistics come to the driver."""
    sample = labelled_sample(labels, "quality", FOLDS, HELD, most)
    rows = with_labels(docs, sample).select("_id", F.col("_label").cast("int").alias("y"), _statistics("text").alias("x"))
    got = rows.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("x")).limit(most).collect()
    return fit(np.array([r.x for r in got], dtype=float).reshape(-1, STATISTICS), np.array([int(r.y == 1) for r in got], dtype=int))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """Every row with held_out, score and predicted added (columns of these names are replaced).

    Null and empty texts have the statistics zero and the model's score of those; equal texts have equal scores.
    """

    @F.pandas_udf("double")
    def scores(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(rows.map(lambda t: statistics(t or "")).tolist(), dtype=float).reshape(-1, STATISTICS)), dtype=float)

    out = docs.withColumn("score", scores("text"))
    return out.withColumns({"held_out": fold(F.col("doc_id"), FOLDS) == HELD, "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score all of them."""
    return score(docs, train(docs, labels))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, with their own columns."""
    judged = quality_scores(packed(docs, "doc_id", "text"), labels)
    return judged.where("predicted = 1").select("_row.*")
