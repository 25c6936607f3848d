"""Mixing sources to target weights by entropy balancing.

Each source's document rates are tilted exponentially by size, exp(lambda * size / mean size) up to a bound, and
lambda solves the source's token constraint: the convex dual of staying as close as possible to one copy of each
document.  Newton steps run over counts per (source, size), which are exact and small; the sums are decimals, so reruns
agree.  Rates become whole copies by carrying the remainder from the largest size to the smallest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import SPACE, pick, row_key
from tessera.operators.ordered import ordinal_in_slots
from tessera.session import cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of one document, and of a source.
MOST = 3
#: Relative distance from its target at which a source's Newton steps end.
NEAR = 1e-7
ROUNDS = 60
#: Documents of one (source, size) that are numbered in one slice.
SLICE = 4096


def source_key(source: str = "source"):
    """Null sources sort last and join like any other."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("s")


def targets(counts: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(s, docs, source_size, target) from counts per (s, size): shares by weight, stopped at ``most`` times the source.

    Resharing the excess until no source is above its stop is filling to one level per weight; the level is found by
    running sums over the sources in the order in which they stop.
    """
    by = counts.groupBy("s").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    order = Window.orderBy("s")  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("stop", (most * F.col("source_size")).cast("double"))
    stops = Window.orderBy(F.col("stop") / F.col("w"), "s")
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumns({"full": F.coalesce(F.sum("stop").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
                         "all": F.sum("source_size").over(every), "ws": F.sum("w").over(every), "nth": F.row_number().over(stops)})
    by = by.withColumn("level", (F.col("all") - F.col("full")) / (F.col("ws") - F.col("gone")))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct("nth", "level"))).over(every)["level"])
    return by.select("s", "docs", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("stop")), F.col("stop")).alias("target"))


def balanced(counts: DataFrame, aims: DataFrame, most: int = MOST, near: float = NEAR, rounds: int = ROUNDS) -> DataFrame:
    """(s, lam, mean) with sum n * size * min(most, exp(lam * size / mean)) = target for every source between its bounds."""
    open_ = aims.filter((F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size")))
    state = cut(open_.select("s", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("lam"),
                             F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("off")))
    for _ in range(rounds):
        d = counts.join(state, "s")
        x = F.col("size") / F.col("mean")
        r = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * x, F.lit(30.0))))
        exact = lambda c: F.sum((c * 1e6).cast("decimal(38,0)")).cast("double") / 1e6
        mass = F.col("n") * F.col("size") * r
        sums = d.groupBy("s").agg(exact(mass).alias("f"), exact(F.when(r < most, mass * x).otherwise(0.0)).alias("g"))
        d = state.join(sums, "s")
        high = F.col("f") > F.col("target")
        lo, hi = F.when(high, F.col("lo")).otherwise(F.col("lam")), F.when(high, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") + F.when((F.col("g") > 0) & (F.col("f") > 0), F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("g"))
        off = F.abs(F.col("f") - F.col("target")) / F.col("target")
        middle = F.when(F.col("hi2") >= 1e6, 2 * F.greatest("lo2", F.lit(1.0))).when(F.col("lo2") <= -1e6, 2 * F.least("hi2", F.lit(-1.0))).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        d = d.withColumns({"lo2": lo, "hi2": hi, "step": step, "off2": off})
        d = d.withColumn("next", F.when(F.col("off2") <= near, F.col("lam")).when((F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2")), F.col("step")).otherwise(middle))
        state = cut(d.select("s", "target", "mean", F.col("next").alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("off2").alias("off")))
        worst = state.agg(F.max(F.when(F.col("hi") - F.col("lo") > 1e-12 * F.abs("lam"), F.col("off")))).first()[0]
        if worst is None or worst <= near:
            break
    return state.select("s", "lam", "mean")


def whole_copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies per size of one source, the largest first; what a size cannot take is carried to the next."""
    pdf = pdf.sort_values("size", ascending=False)
    low, extra, due = [], [], 0.0
    for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
        base = math.floor(rate)
        due += n * (rate - base) * size
        more = int(min(max(np.floor(due / size + 0.5), 0), n if rate > base else 0))
        due -= more * size
        low.append(base)
        extra.append(more)
    return pd.DataFrame({"s": pdf["s"], "size": pdf["size"], "n": pdf["n"], "low": low, "extra": extra})


def mixed(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per row: doc_id, k1, k2, size, source_size, target, copies.

    A null text has size 0 and is never copied; a null source is a source of its own, the last; of rows alike in
    source and size the hash of id and text says which get one copy more, so rows that repeat each other may differ by
    one; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string", **{source: "string"})
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE.replace("[", "[^") + "+")), F.lit(0)).cast("bigint")
    base = cut(rows.select("doc_id", *row_key("doc_id", "text", source), source_key(source), words.alias("size")))
    counts = cut(base.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = cut(targets(counts, weights, most))
    lam = balanced(counts.filter("size > 0"), aims, most)
    rate = F.coalesce(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(30.0)))), F.lit(float(most)))
    rates = counts.filter("size > 0").join(lam, "s", "left").select("s", "size", "n", rate.alias("rate"))
    copies = cut(rates.groupBy("s").applyInPandas(whole_copies, "s string, size bigint, n bigint, low bigint, extra bigint"))  # one row per size
    placed = base.join(copies, ["s", "size"], "left").select("doc_id", "k1", "k2", "s", "size", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "low", "extra")])
    torn = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    some = placed.filter(torn).withColumn("slot", F.pmod(F.xxhash64("k1", "k2"), F.ceil(F.col("n") / SLICE)))
    some = ordinal_in_slots(some, ["s", "size"], ["slot"], ["k1", "k2"], "k").withColumn("copies", F.col("low") + (F.col("k") < F.col("extra")).cast("bigint")).drop("slot", "k")
    rest = placed.filter(~torn).withColumn("copies", F.col("low") + (F.col("extra") > 0).cast("bigint"))
    out = some.unionByName(rest).join(aims.select("s", "source_size", "target"), "s")
    return out.select("doc_id", "k1", "k2", "size", "source_size", "target", "copies")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


def taken(docs: DataFrame, source: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    found = mixed(docs, source).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    k1, k2 = row_key("doc_id", "text", source)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2}).join(found.filter("__copies > 0"), ["__k1", "__k2"])
    alike = Window.partitionBy("__k1", "__k2").orderBy("__copies")
    share = F.expr("int(__copies div __rows)") + (F.row_number().over(alike) <= F.col("__copies") % F.col("__rows")).cast("int")
    many = keyed.withColumn("__share", share).filter("__share > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__share"))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])
