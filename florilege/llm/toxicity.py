"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters are fixed words and patterns and stems that labelled texts show to be telling. The label model estimates by
expectation-maximisation how often each voter fires on toxic and on other texts, counts correlated voters as less
than one each, and gives every training text a probability. A logistic regression on the votes learns those.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from florilege.llm.common import fold, labelled_sample, with_labels

FOLDS, HELD, BOUND = 4, 2, 0.3
#: Most labelled rows to learn from, most stems found in them, and the share of toxic texts among those with such a stem.
SAMPLE, STEMS, PRECISION, SUPPORT = 12_000, 400, 0.8, 3
PREFIXES = (4, 5, 6, 7, 8)
#: Insults and slurs of mild form by language.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "clowns", "imbecile", "jerk", "creep", "filth", "vermin", "degenerate", "bastard", "crap", "hate", "ugly",
    "dummkopf", "trottel", "abschaum", "versager", "widerlich", "arschloch", "blödmann", "depp", "mistkerl", "scheisse", "scheiße", "dreck",
    "crétin", "imbécile", "connard", "salaud", "ordure", "minable", "abruti", "dégoûtant", "débile", "merde", "racaille",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "asqueroso", "asquerosa", "inútil", "patético", "payaso", "mierda", "cabrón",
)
#: Attacks and threats as patterns over lower-cased text.
PATTERNS = (
    r"\byou(?:'re| are)? (?:an? |such an? |all )?(?:\w+ )?(?:idiot|moron|loser|clown|scum|trash|jerk)",
    r"\b(?:shut up|go to hell|get lost|drop dead|kill yourself|go die)\b",
    r"\b(?:i|we) (?:will|'ll|ll) (?:kill|hurt|find) you\b",
    r"\bhate (?:you|them|those)\b",
)
_WORD = re.compile(r"[^\W\d_]+")


def stems(text: str | None) -> set[str]:
    """Whole words (``=word``) and prefixes of the lower-cased text."""
    words = set(_WORD.findall((text or "").lower()))
    return {"=" + w for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


@F.pandas_udf(ArrayType(StringType()))
def _stems(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(stems(t)))


@dataclass(frozen=True)
class Voters:
    """Words, prefixes and patterns with their places in a vote vector."""

    words: dict[str, int]
    prefixes: dict[int, dict[str, int]]
    patterns: tuple[str, ...]
    count: int

    @classmethod
    def of(cls, found: list[str]) -> Voters:
        words, prefixes, n = {}, defaultdict(dict), 0
        for stem in dict.fromkeys([*("=" + w for w in LEXICON), *found]):
            if stem.startswith("="):
                words[stem[1:]] = n
            else:
                prefixes[len(stem)][stem] = n
            n += 1
        return cls(words, dict(prefixes), PATTERNS, n + len(PATTERNS))

    def votes(self, text: str | None) -> np.ndarray:
        """1 for every voter that fires on the text, and two summaries: how many fire, and on what share of the words."""
        low = (text or "").lower()
        all_words = _WORD.findall(low)
        out, hit = np.zeros(self.count + 2, dtype=np.float32), set()
        for word in set(all_words):
            at = self.words.get(word)
            if at is not None:
                out[at] = 1
                hit.add(word)
            for n, known in self.prefixes.items():
                at = known.get(word[:n])
                if at is not None:
                    out[at] = 1
                    hit.add(word)
        if "you" in low or "hate" in low or "go " in low or "shut" in low or "drop" in low or "get " in low:
            for k, pattern in enumerate(self.patterns):
                if re.search(pattern, low):
                    out[self.count - len(self.patterns) + k] = 1
        out[self.count] = np.log1p(len(hit))
        out[self.count + 1] = np.log1p(100.0 * len(hit) / max(1, len(all_words)))
        return out


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Probability of toxic for each row, from binary ``votes`` and the noisy label ``gold`` as one more voter."""
    belief = np.where(gold > 0, 0.9, 0.1)
    v = np.column_stack([votes, gold]).astype(float)
    weight = np.ones(v.shape[1])
    for k in range(rounds):
        yes, no = belief.sum() + 1e-9, (1 - belief).sum() + 1e-9
        a = np.clip((v.T @ belief + 0.05) / (yes + 1.0), 1e-4, 1 - 1e-4)
        b = np.clip((v.T @ (1 - belief) + 0.01) / (no + 1.0), 1e-5, 1 - 1e-4)
        if k == 0:  # correlations beyond what the classes explain; a voter among c like it counts as one of c
            rest = v - (belief[:, None] * a + (1 - belief)[:, None] * b)
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            tied = (rest.T @ rest) / len(v) / np.outer(scale, scale)
            np.fill_diagonal(tied, 0)
            tied[-1, :] = tied[:, -1] = 0
            weight = 1.0 / (1.0 + np.where(tied > 0.2, tied, 0).sum(axis=0))
        prior = np.log(yes / no)
        logit = prior + (v * (np.log(a / b) * weight) + (1 - v) * (np.log((1 - a) / (1 - b)) * weight)).sum(axis=1)
        belief = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
    return belief


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on probabilities, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w = w - step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    voters: Voters
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        x = self.voters.votes(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def found_stems(rows: DataFrame, most: int, precision: float, support: int) -> list[str]:
    """Stems that stand mostly in toxic texts of ``rows`` (text, _label), the most telling first, at most ``most``."""
    each = rows.select(F.when(F.col("_label") == 1, 1).otherwise(0).alias("y"), F.explode(_stems("text")).alias("stem"))
    counts = each.groupBy("stem").agg(F.sum("y").alias("toxic"), F.count("*").alias("texts"))
    telling = counts.where((F.col("toxic") >= support) & (F.col("toxic") / F.col("texts") >= precision))
    weight = F.col("toxic") * F.log((F.col("toxic") + 1.0) / (F.col("texts") - F.col("toxic") + 0.5))
    return [r.stem for r in telling.orderBy(weight.desc(), "stem").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    rows = with_labels(docs, labelled_sample(labels, "toxic", FOLDS, HELD, most))
    voters = Voters.of(found_stems(rows, STEMS, PRECISION, SUPPORT))

    @F.pandas_udf("array<float>")
    def votes(texts: pd.Series) -> pd.Series:
        """The two summaries and the places of the voters that fire: few numbers, since they come to the driver."""
        full = texts.map(voters.votes)
        return full.map(lambda v: np.concatenate([v[voters.count :], np.nonzero(v[: voters.count])[0]]).astype(np.float32))

    got = rows.select("_id", F.when(F.col("_label") == 1, 1).otherwise(0).alias("y"), votes("text").alias("x")).orderBy(F.xxhash64("_id"), "_id").limit(most).collect()
    if not got:
        return Model(voters, np.append(np.zeros(voters.count + 2), -2.0))
    x, y = np.zeros((len(got), voters.count + 2), dtype=np.float32), np.array([r.y for r in got])
    for row, r in zip(x, got, strict=True):
        row[voters.count :] = r.x[:2]
        row[np.array(r.x[2:], dtype=int)] = 1
    return Model(voters, logistic(x, label_model(x[:, : voters.count], y)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts have the score of no votes."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype(float)

    out = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), scores(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= BOUND, 1).otherwise(0))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score all of them."""
    return score(docs, train(docs, labels))
