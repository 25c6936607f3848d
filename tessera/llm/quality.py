"""Quality rules: counts of each text, and lines that too many documents of one host share.

Lines are normalised and hashed.  A line above the limit of distinct documents on its host is boilerplate and is
removed; a document that keeps too small a share of its words is depleted and is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import context, drop_lines, line_entries, pick, row_key
from tessera.session import cut

MIN_WORDS = 50
#: Base rule: percent of words that may stand in repeated three-word windows.
MAX_REPEAT = 50
#: A line is boilerplate on a host when more documents than this hold it ...
LINE_DOCS = 50
#: ... in more different texts than this, so that copies of one text keep their lines.
LINE_CONTEXTS = 25
#: A document that keeps fewer than this percent of its words is depleted.
MIN_LEFT = 20
WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) > 2_000_000:  # the product of three codes must fit
        _, pair = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)
        window = pair[:-1].astype(np.int64) * len(codes) + ids[2:]
    else:
        window = (ids[:-2] * len(codes) + ids[1:-1]) * len(codes) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(window)] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            repeats += line in seen
            seen.add(line)
    return repeats


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words))


def text_counts(text: Column) -> Column:
    @F.pandas_udf(COUNTS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")

    return run(text)


def frequent_lines(lines: DataFrame, docs_limit: int, contexts_limit: int) -> DataFrame:
    """(host, h) of the lines above both limits; ``lines`` has host, k1, k2, c and h per occurrence.

    Lines with too few occurrences go first, by a count with map-side combine; only the rest is counted exactly.
    """
    often = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(docs_limit, contexts_limit)).select(F.col("host").alias("ho"), F.col("h").alias("hh"))
    some = lines.join(often, F.col("host").eqNullSafe(F.col("ho")) & (F.col("h") == F.col("hh")), "left_semi")
    spread = some.groupBy("host", "h").agg(F.countDistinct("k1", "k2").alias("docs"), F.countDistinct("c").alias("contexts"))
    return spread.filter((F.col("docs") > docs_limit) & (F.col("contexts") > contexts_limit)).select("host", "h")


def judged(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_contexts: int = LINE_CONTEXTS, min_left: int = MIN_LEFT,
           hashes: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, k1, k2, the five counts, n_removed_words, base_failed, kept, and on request the removed line hashes.

    A null text has no words and fails the base rule; a null host is a host of its own; rows that repeat each other
    count as one document and get the same verdict; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string", **{host: "string"}).withColumnRenamed(host, "host")
    base = cut(rows.select("doc_id", "host", *row_key("doc_id", "text", "host"), text_counts(F.col("text")).alias("s"), line_entries().alias("e"))
               .select("doc_id", "host", "k1", "k2", "s.*", context("e").alias("c"), "e"))
    lines = base.select("host", "k1", "k2", "c", F.explode("e").alias("l")).select("host", "k1", "k2", "l.h", "c")
    marked = frequent_lines(lines, line_docs, line_contexts).select(F.col("host").alias("ho"), F.col("h").alias("hh"))
    hit = lines.join(marked, F.col("host").eqNullSafe(F.col("ho")) & (F.col("h") == F.col("hh")), "left_semi")
    gone = hit.groupBy("k1", "k2").agg(F.collect_set("h").alias("g"))
    out = base.join(gone, ["k1", "k2"], "left")
    removed = F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.array_contains(F.col("g"), x["h"]), x["w"]).otherwise(0))
    out = out.withColumn("n_removed_words", F.when(F.col("g").isNull(), F.lit(0).cast("bigint")).otherwise(removed))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < min_left * F.col("n_words")
    return out.select("doc_id", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words",
                      failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *([F.col("g").alias("gone")] if hashes else []))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def cleaned(docs: DataFrame, host: str = "source") -> DataFrame:
    """Documents that pass, without the lines above the limit; the columns of ``docs``."""
    found = judged(docs, host, hashes=True).filter("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("gone").alias("__gone")).dropDuplicates(["__k1", "__k2"])
    k1, k2 = row_key("doc_id", "text", host)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2}).join(found, ["__k1", "__k2"])
    return replaced(keyed, docs, drop_lines(F.col("text"), F.col("__gone")))


def replaced(keyed: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with another text and its length in n_chars."""
    kinds = dict(docs.dtypes)
    own = {"text": text.alias("text"), "n_chars": F.length(text).cast(kinds.get("n_chars", "bigint")).alias("n_chars")}
    return keyed.select(*[own.get(c, F.col(f"`{c}`")) for c in docs.columns])
