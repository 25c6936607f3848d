"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, quote or other.  Transducers read the symbols of a
clause and compose: an insult or a threat is aimed if a target stands near, it is negated inside the reach of a
negation, and it is reported after a verb of saying or inside quotes.  Each kind of matched clause has a weight.  The
insult vocabulary (words, and word beginnings for languages that derive many forms) and the weights are learned from
labelled documents; the grammar is fixed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import pick
from tessera.llm.labelled import FIT_DOCS, fit_labels, held_out
from tessera.session import cut

WORD = re.compile(r"[^\W\d_]+|[\"“”„«»]")
BREAK = re.compile(r"[.!?;:\n]+")
# Closed word classes in English, German, French and Spanish.
TARGET = set("you your yours yourself he she they them him her his their those these people du dich dir dein ihr euch euer sie ihn tu te toi ton ta vous votre ils elles eux lui ustedes usted tú ti tus vosotros ellos ellas".split())
NEGATION = set("not no never nobody neither nor isn aren wasn don doesn nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún ninguna tampoco".split())
REPORT = set("said says saying claimed claims reported reports quoted wrote called sagte sagt schrieb behauptet nannte dit disait écrit déclaré dijo dice escribió afirmó llamó".split())
THREAT = set("kill murder hurt destroy burn beat shoot stab töten umbringen schlagen verletzen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split())
QUOTES = set("\"“”„«»")

#: Words after a negation that it reaches, and words between an attack and its target.
REACH, NEAR = 3, 4
KINDS = ("aimed_insult", "bare_insult", "negated_insult", "reported_insult", "aimed_threat", "bare_threat", "held_threat")
#: A vocabulary entry stands in at least this many toxic documents, and in this share of them ...
LEAST_DOCS, LEAST_SHARE = 4, 0.01
#: ... and at least this share of the documents that hold it are toxic.
PRECISION = 0.9
#: Lengths of word beginnings that may become entries.
BEGINNINGS = (4, 5, 6)
#: Most entries kept, those with the most toxic documents; bounds what is sent to the workers.
MOST_ENTRIES = 5_000
#: Terms that one worker counts before it passes its partial counts on.
FLUSH = 200_000
RIDGE = 0.05


def terms_of(text: str) -> set[str]:
    """Distinct words of a text, and their beginnings marked by a star."""
    words = {w for w in WORD.findall(text.lower()) if w not in QUOTES}
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()

    def flushed() -> pd.DataFrame:
        keys = list(toxic.keys() | clean.keys())
        out = pd.DataFrame({"term": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})
        toxic.clear()
        clean.clear()
        return out.astype({"term": object, "toxic": "int64", "clean": "int64"})

    for batch in batches:
        for text, y in zip(batch["text"], batch["y"]):
            (toxic if y else clean).update(terms_of(text or ""))
            if len(toxic) + len(clean) > FLUSH:
                yield flushed()
    yield flushed()


def vocabulary(sample: DataFrame) -> dict[str, set[str]]:
    """Insult words and beginnings; ``sample`` has text and y, texts that repeat count once."""
    once = sample.select("text", "y").distinct()
    total = once.agg(F.sum("y")).first()[0] or 0
    need = max(LEAST_DOCS, LEAST_SHARE * total)
    found = once.mapInPandas(count_terms, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = found.filter((F.col("toxic") >= need) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    rows = [r["term"] for r in strong.orderBy(F.col("toxic").desc(), "term").limit(MOST_ENTRIES).collect()]
    return {"words": {t for t in rows if not t.endswith("*")}, "beginnings": {t[:-1] for t in rows if t.endswith("*")}}


class Grammar:
    """Counts the matched clauses of a text by kind."""

    def __init__(self, vocabulary: dict[str, set[str]]):
        self.words = vocabulary["words"]
        self.beginnings = vocabulary["beginnings"]
        self.known: dict[str, bool] = {}

    def insulting(self, word: str) -> bool:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = word in self.words or any(word[:n] in self.beginnings for n in BEGINNINGS if len(word) > n)
        return found

    def clause(self, words: list[str]) -> list[int]:
        """Kinds of the attacks in one clause: one pass over its symbols, one state for each composed transducer."""
        negated = 0  # words that a negation still reaches
        reported = quoted = False
        targets = [i for i, w in enumerate(words) if w in TARGET]
        out = []
        for i, w in enumerate(words):
            if w in QUOTES:
                quoted = not quoted
            elif w in NEGATION:
                negated = REACH + 1
            elif w in REPORT:
                reported = True
            threat = w in THREAT
            if threat or self.insulting(w):
                aimed = any(abs(t - i) <= NEAR for t in targets)
                held = negated > 0 or reported or quoted
                if threat:
                    out.append(6 if held else 4 if aimed else 5)
                else:
                    out.append(2 if negated > 0 else 3 if reported or quoted else 0 if aimed else 1)
            negated = max(0, negated - 1)
        return out

    def kinds(self, text: str | None) -> np.ndarray:
        counts = np.zeros(len(KINDS))
        low = (text or "").lower()
        if not any(map(self.insulting, set(WORD.findall(low)))) and not any(w in low for w in THREAT):
            return counts
        for part in BREAK.split(low):
            for kind in self.clause(WORD.findall(part)):
                counts[kind] += 1
        return counts


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> np.ndarray:
    """Bias and weights of the kinds by Newton steps on the ridge-penalised log loss; the prior alone without both classes."""
    n = np.bincount(y, minlength=2)
    start = np.zeros(x.shape[1] + 1)
    start[0] = np.log((n[1] + 0.5) / (n[0] + 0.5)) if n.sum() else -2.0
    if not n.all():
        return start
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    w = start
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def clause_kinds(text: Column, vocabulary: dict[str, set[str]]) -> Column:
    grammar: list[Grammar] = []  # one for each worker

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        if not grammar:
            grammar.append(Grammar(vocabulary))
        return pd.Series([grammar[0].kinds(t) for t in texts])

    return run(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = FIT_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Vocabulary and weights are learned from at most about ``most`` labelled documents outside the held-out third.
    Null and empty texts match no clause and get the score of the bias; rows that repeat a doc_id are scored by their
    own texts; without labels the score is a low constant; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    learn = F.broadcast(fit_labels(labels, column, most))  # bounded by ``most``
    sample = cut(rows.join(learn, "doc_id").select("text", "y"))
    known = vocabulary(sample)
    seen = sample.select("y", clause_kinds(F.col("text"), known).alias("k")).toPandas()
    x = np.log1p(np.stack(seen["k"])) if len(seen) else np.zeros((0, len(KINDS)))
    weights = fit_weights(x, seen["y"].to_numpy(np.int64))
    kinds = F.col("k")
    logit = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        logit = logit + F.log1p(kinds[i]) * float(w)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), clause_kinds(F.col("text"), known).alias("k"))
    out = scored.select("doc_id", "held_out", (1 / (1 + F.exp(-logit))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
