"""Line dedup across sites: lines that stand on many sites, in many different texts, are boilerplate.

DataFrame functions only.  Each line hash has one HyperLogLog sketch of its sites and one of its texts; sketches
merge by aggregation.  Lines whose estimate lies near a threshold get exact distinct counts before anything goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import context, drop_lines, line_entries, pick, row_key
from tessera.llm.quality import replaced
from tessera.session import cut

MIN_SITES = 10
#: Different texts that must hold the line, so that copies of one text on many sites keep their lines.
MIN_CONTEXTS = 10
#: Sketch size 2^LOG_K; the relative deviation is about 1.04 / sqrt(2^LOG_K).
LOG_K = 10
#: Half width of the band around a threshold, in deviations, that is counted exactly.
BAND = 6.0
#: Parts into which a line's occurrences are dealt before its sketches merge, so that a very common line is no hot key.
SALTS = 32


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, min_contexts: int = MIN_CONTEXTS, log_k: int = LOG_K) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites and in at least ``min_contexts`` different texts.

    ``lines`` has site, h, c per occurrence.  A line with fewer occurrences than a threshold cannot reach it, so a
    count with map-side combine goes first and sketches are built for the others only.
    """
    often = cut(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(min_sites, min_contexts)).select("h"))
    salted = lambda d: d.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    some = lines.withColumn("salt", F.pmod("c", F.lit(SALTS)).cast("int")).join(salted(often), ["h", "salt"], "left_semi")
    parts = some.groupBy("h", "salt").agg(F.hll_sketch_agg(F.coalesce("site", F.lit("\x00")), F.lit(log_k)).alias("s"), F.hll_sketch_agg("c", F.lit(log_k)).alias("c"))
    seen = parts.groupBy("h").agg(F.hll_union_agg("s").alias("s"), F.hll_union_agg("c").alias("c"))
    seen = seen.select("h", F.hll_sketch_estimate("s").alias("sites"), F.hll_sketch_estimate("c").alias("contexts"))
    width = BAND * 1.04 / (2 ** (log_k / 2))
    low, high = (lambda t: t - t * width - 1), (lambda t: t + t * width + 1)
    passed = seen.filter((F.col("sites") >= low(min_sites)) & (F.col("contexts") >= low(min_contexts)))
    passed = passed.withColumn("sure", (F.col("sites") > high(min_sites)) & (F.col("contexts") > high(min_contexts)))
    near = passed.filter(~F.col("sure")).select("h")
    exact = some.join(salted(near), ["h", "salt"], "left_semi").groupBy("h").agg(
        F.countDistinct(F.coalesce("site", F.lit("\x00"))).alias("sites"), F.countDistinct("c").alias("contexts"))
    return passed.filter("sure").select("h").unionByName(exact.filter((F.col("sites") >= min_sites) & (F.col("contexts") >= min_contexts)).select("h"))


def marked_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(k1, k2, gone): the boilerplate hashes of every document that has some."""
    rows = pick(docs, doc_id="bigint", text="string", **{site: "string"}).withColumnRenamed(site, "site")
    base = cut(rows.select("site", *row_key("doc_id", "text", "site"), line_entries().alias("e")).select("site", "k1", "k2", context("e").alias("c"), F.transform("e", lambda x: x["h"]).alias("e")))
    lines = base.select("k1", "k2", "site", "c", F.explode("e").alias("h"))
    gone = cut(spread_lines(lines, min_sites, min_contexts))  # written, so that a very common line can be split in the join
    return lines.join(gone, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set("h").alias("gone"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_contexts: int = MIN_CONTEXTS, counts: bool = False) -> DataFrame:
    """All documents with their columns, boilerplate lines removed from the text; n_chars follows.

    A null text stays null; a null site is a site of its own; rows that repeat each other are all cleaned alike; a
    document of nothing but boilerplate keeps an empty text; an empty table gives an empty result.
    ``counts`` adds __lines (lines with a word) and __removed.
    """
    marked = marked_lines(docs, site, min_sites, min_contexts).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("gone").alias("__gone"))
    k1, k2 = row_key("doc_id", "text", site)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2}).join(marked, ["__k1", "__k2"], "left")
    text = drop_lines(F.col("text"), F.col("__gone"))
    out = replaced(keyed, docs, text)
    if not counts:
        return out
    worded = lambda t: F.size(F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))).cast("bigint")
    full = keyed.withColumns({"__lines": worded(F.col("text")), "__left": worded(text), "__text": text})
    return full.select("doc_id", F.col("__lines").alias("n_lines"), (F.col("__lines") - F.col("__left")).alias("n_removed"), F.col("__text").alias("text"))
