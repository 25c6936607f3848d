"""Periodic runs of words in whole texts, by seed and extend on diagonals.

Words q apart that are identical form a diagonal of lag q.  A run of ``length`` words with period q is a stretch of
``length - q`` on that diagonal, so every run with a lag of one octave holds a k-gram whose length k is the least overlap
that the limits guarantee there.  k-grams are indexed by exact names (pairs of names of half their length), and only
neighbouring occurrences of one k-gram are paired: k is at least the lag, so inside a run they are one period apart, and
a longer lag that is no smallest period is never met.  A table holds for each lag how far it is covered already, so a
stretch is extended once however many seeds it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import pick

#: A run has at least so many words, and so many copies of its period.
MIN_WORDS, MIN_COPIES = 6, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


@lru_cache(maxsize=256)
def overlap(low: int, high: int, min_words: int, min_copies: int) -> int:
    """The least stretch that a run with a lag from ``low`` up to, not including, ``high`` has on its diagonal."""
    lag = np.arange(low, min(high, max(low + 1, min_words + 1)))  # beyond min_words it only grows
    return int(np.maximum(min_words - lag, (min_copies - 1) * lag).min())


def paired_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same number for the same pair of names."""
    return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]


def grams(names: dict[int, np.ndarray], k: int) -> np.ndarray:
    """Names of all k-grams; ``names`` keeps those whose length is a power of two."""
    half = 1
    while 2 * half <= k:
        if 2 * half not in names:
            names[2 * half] = paired_names(names[half][:-half], names[half][half:])
        half *= 2
    short = names[half]
    return short if half == k else paired_names(short[:len(short) - (k - half)], short[k - half:])


def first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many items from the start are the same, looked at in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 64
    a, b = a[:n], b[:n]
    while at < n:
        other = a[at:at + step] != b[at:at + step]
        if other.any():
            return at + int(other.argmax())
        at, step = at + len(other), 2 * step
    return n


def seeds(word: np.ndarray, min_words: int, min_copies: int) -> Iterator[tuple[int, int]]:
    """(position, lag) of neighbouring occurrences of a k-gram, by position within each octave of lags."""
    names, low = {1: word}, 1
    while True:
        k = overlap(low, 2 * low, min_words, min_copies)
        grows = overlap(2 * low, 4 * low, min_words, min_copies) >= k  # and goes on growing
        if k + low > len(word):
            if grows:
                return
            low *= 2
            continue
        name = grams(names, k)
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        if grows and not same.any():
            return  # longer k-grams do not repeat either
        lag = (order[1:] - order[:-1])[same]
        near = (lag >= low) & (lag < 2 * low)
        at, lag = order[:-1][same][near], lag[near]
        for i in np.argsort(at, kind="stable"):
            yield int(at[i]), int(lag[i])
        low *= 2


def find_runs(word: np.ndarray, min_words: int = MIN_WORDS, min_copies: int = MIN_COPIES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a sequence of numbers, by start, then period."""
    if min_copies < 3:
        raise ValueError("with fewer than three copies the least overlap may be shorter than the lag")
    covered: dict[int, int] = {}  # lag -> first position beyond the stretch that was extended last
    out = []
    for at, lag in seeds(word, min_words, min_copies):
        if at < covered.get(lag, 0):
            continue
        end = at + first_difference(word[at:], word[at + lag:])
        begin = at - first_difference(word[:at][::-1], word[lag:at + lag][::-1])
        covered[lag] = end
        if end - begin + lag >= max(min_words, min_copies * lag):
            out.append((begin, end - begin + lag, lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period."""
    if not runs:
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def text_runs(text: Column, min_words: int = MIN_WORDS, min_copies: int = MIN_COPIES) -> Column:
    """(runs, collapsed) of a text."""
    @F.pandas_udf(f"runs {RUN}, collapsed string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = WORD.findall(t or "")
            numbers: dict[str, int] = {}
            found = find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), min_words, min_copies) if len(words) >= min_words else []
            out.append(([{"start": a, "length": n, "period": p} for a, n, p in found], collapsed(words, found)))
        return pd.DataFrame(out, columns=["runs", "collapsed"])

    return run(text)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_copies: int = MIN_COPIES) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period), collapsed (text without the repeats).

    A run is a maximal stretch of words with smallest period q of at least ``min_words`` words and ``min_copies * q``.
    Null, empty and white texts have no runs and collapse to an empty text; rows that repeat each other, or an id, are
    documents of their own; a null doc_id stays null; an empty table gives an empty result.  Nothing is shuffled, and a
    text of any length is searched whole in about n log n steps.
    """
    rows = pick(docs, doc_id="bigint", text="string").withColumn("t", text_runs(F.col("text"), min_words, min_copies))
    return rows.select("doc_id", "t.runs", "t.collapsed")


def looped(docs: DataFrame) -> DataFrame:
    """The documents of the query: a tenth of them, chosen by the checksum of the id, end in a loop of their own words.

    A document without an id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = pick(docs, doc_id="bigint", text="string").withColumn("h", h)
    hit = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    placed = hit.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    word = lambda w, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w)
    return placed.select("doc_id", F.when(n > 0, F.array_join(F.transform("w", word), " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and checksums of all runs and of the collapsed text."""
    order = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(
        x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    top = found.withColumn("top", F.get(order, F.lit(0)))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return top.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
                      F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("bigint").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
