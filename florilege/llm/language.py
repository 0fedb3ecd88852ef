"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

Features are hashed n-grams of the bytes of the lower-cased letters of a whole text. All machines are squared-hinge
linear SVMs, fitted on a bounded number of documents for each language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import fold

FOLDS, HELD = 4, 2
#: Most training documents of a language, and of all languages together.
PER_LANGUAGE, SAMPLE = 700, 5600
BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Families of languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("pl", "cs", "sk", "ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile(r"[^\W\d_]")
_KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def family(lang: str) -> str:
    """Family of a language tag such as ``en`` or ``pt-BR``."""
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], "=" + lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, of length one; zero for a text without letters."""
    raw = _KEPT[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    blank = raw == 32
    raw = raw[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    total, code = np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(raw), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(raw) < order:
            break
        code = (code[: len(raw) - order + 1] * np.uint32(257)) + raw[order - 1 :]
        total += np.bincount((code * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(20), minlength=BUCKETS)
    out = np.sqrt(total.astype(np.float32))
    size = np.linalg.norm(out)
    return out / size if size else out


def svm(x: np.ndarray, y: np.ndarray, strength: float = 30.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by accelerated gradient steps.

    ``y`` is 1 or -1; both sides weigh the same however many rows they have.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * strength
    way = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):
        way = x.T @ (cost * (x @ way))
        top = np.linalg.norm(way)
        way = way / max(top, 1e-12)
    step = 1.0 / (1.0 + 2.2 * top)
    w = last = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(rounds):
        ahead = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        last, w = w, ahead - step * (ahead - 2 * (x.T @ (cost * y * slack)))
    return w


@dataclass(frozen=True)
class Model:
    """Family machines (one against the rest) and, within each family, one machine for each pair of languages."""

    families: dict[str, list[str]] = field(default_factory=dict)
    against_rest: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); ``und`` and 0 where nothing can be told."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = np.append(grams(text), np.float32(1))
        names = list(self.families)
        margins = np.array([float(x @ self.against_rest[f]) for f in names]) if len(names) > 1 else np.zeros(1)
        odds = np.exp(3.0 * (margins - margins.max()))
        best = int(odds.argmax())
        share, langs = odds[best] / odds.sum(), self.families[names[best]]
        if len(langs) == 1:
            return langs[0], float(share)
        votes, belief = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            p = 1.0 / (1.0 + np.exp(-3.0 * float(x @ self.pairs[a, b])))
            votes[a if p >= 0.5 else b] += 1
            belief[a] += p
            belief[b] += 1 - p
        lang = max(langs, key=lambda t: (votes[t], belief[t]))
        return lang, float(share * belief[lang] / (len(langs) - 1))


def fit(texts: list[str], langs: list[str]) -> Model:
    """All machines from training texts and their languages."""
    known = [(t, y) for t, y in zip(texts, langs, strict=True) if has_letter(t)]
    if not known:
        return Model()
    x, y = np.array([grams(t) for t, _ in known]), np.array([y for _, y in known])
    families: dict[str, list[str]] = {}
    for lang in sorted(set(y)):
        families.setdefault(family(lang), []).append(lang)
    of = np.array([family(lang) for lang in y])
    rest = {f: svm(x, np.where(of == f, 1, -1).astype(np.float32)) for f in families} if len(families) > 1 else {}
    pairs = {}
    for members in families.values():
        for a, b in combinations(members, 2):
            at = (y == a) | (y == b)
            pairs[a, b] = svm(x[at], np.where(y[at] == a, 1, -1).astype(np.float32))
    return Model(families, rest, pairs)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> Model:
    """Fit on a bounded number of documents for each non-null language outside the held-out fold, by hash of the id."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD)).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    # the hash of an id as a share of its range, times the rows of its language, is about its place in the order of the hash
    rows = ids.groupBy("_lang").agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), "_lang").limit(most)
    place = (F.xxhash64("_id") / F.lit(2.0**64) + 0.5) * F.col("_rows")
    few = ids.join(F.broadcast(rows), "_lang").withColumn("_place", place).where(F.col("_place") <= per_language).orderBy("_place", "_lang").limit(most).select("_id", "_lang").distinct()
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text").join(F.broadcast(few), ["_id", "_lang"])
    got = texts.orderBy(F.xxhash64("_id"), "_lang").limit(most).select("text", "_lang").collect()
    return fit([r.text for r in got], [r._lang for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; ``und`` with score 0 for null texts and those without a letter.

    Without training documents every text is ``und``; equal texts have equal answers; other columns are not read.
    """

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), told("text").alias("_told")).select("doc_id", "held_out", "_told.lang_pred", "_told.score")


def languages(docs: DataFrame) -> DataFrame:
    """Fit on the tagged rows of ``docs`` and identify all of them."""
    return identify(docs, train(docs))
