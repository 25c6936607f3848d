"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards a multiple of the identity.  A score
is the difference of the two log densities: Mahalanobis distances from Cholesky factors that are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import pick
from tessera.llm.labelled import FIT_DOCS, fit_labels, held_out
from tessera.session import cut

#: Share of the pooled covariance, then of the identity, in each class covariance.
POOLED, ROUND = 0.1, 0.02
#: Log density differences are divided by this before they become probabilities; correlated statistics overstate them.
TEMPER = 4.0
FEATURES = ("words", "word_len", "word_len_dev", "unique", "adjacent", "pairs", "upper", "digits", "marks", "symbols", "stops", "line_words", "dup_lines", "longest")
MARKS = "!?|&%$*#<>~^=+_@/\\{}[]"
UPPER = bytes(range(65, 91))


def statistics_of(text: str | None) -> list[float]:
    """Counts and shares of one text, by logarithms and square roots nearer to normal."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    length = np.fromiter(map(len, words), np.int64, n)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(codes) + ids[1:]
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(len(text), 1)
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, UPPER))
    root = lambda x: float(np.sqrt(max(x, 0.0)))
    return [
        float(np.log1p(n)), float(np.log(length.mean())), float(np.log1p(length.std())), len(codes) / n,
        root(float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0), root(1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0.0),
        root(upper / chars), root(sum(map(text.count, "0123456789")) / chars), root(sum(map(text.count, MARKS)) / chars),
        root(text.count("!") / n), root(sum(map(text.count, ".,;:")) / n), float(np.log1p(n / max(len(lines), 1))),
        root(1 - len(set(lines)) / max(len(lines), 1)), float(np.log1p(length.max())),
    ]


def statistics(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(t) for t in texts])

    return run(text)


@dataclass
class Discriminant:
    means: np.ndarray
    factors: np.ndarray  # Cholesky factors of the two covariances
    constants: np.ndarray  # log prior minus half the log determinant
    temper: float = TEMPER

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(constant - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / self.temper, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, round_: float = ROUND, temper: float = TEMPER) -> Discriminant | float:
    """The discriminant, or one score for all if a class has no rows."""
    n = np.bincount(y, minlength=2)
    if not n.all():
        return float(n[1] / n.sum()) if n.sum() else 0.5
    means = np.stack([x[y == k].mean(0) for k in (0, 1)])
    scatter = [(x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in (0, 1)]
    common = (scatter[0] + scatter[1]) / len(x)
    scale = np.sqrt(np.maximum(np.diag(common), 1e-9))
    factors, constants = [], []
    for k in (0, 1):
        s = ((1 - pooled) * scatter[k] / n[k] + pooled * common) / np.outer(scale, scale)
        s = (1 - round_) * s + round_ * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        factor = np.linalg.cholesky(s) * scale[:, None]
        factors.append(factor)
        constants.append(np.log(n[k] / len(x)) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.stack(factors), np.array(constants), temper)


def quality_scores(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = FIT_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    The model is fitted on at most about ``most`` labelled documents outside the held-out third.  Null and empty texts
    have all statistics zero and are scored like any other; rows that repeat a doc_id are scored by their own texts;
    without labels every score is 0.5; an empty table gives an empty result.
    """
    base = cut(pick(docs, doc_id="bigint", text="string").select("doc_id", statistics(F.col("text")).alias("x")))
    sample = base.join(F.broadcast(fit_labels(labels, column, most)), "doc_id").select("x", "y").toPandas()  # bounded by ``most``
    x = np.stack(sample["x"]) if len(sample) else np.zeros((0, len(FEATURES)))
    model = fit(x, sample["y"].to_numpy(np.int64))

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series(np.full(len(rows), model))
        return pd.Series(model.scores(np.stack(rows)) if len(rows) else [], dtype=float)

    out = base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
