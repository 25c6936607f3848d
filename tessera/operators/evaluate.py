"""Scoring of class probabilities: decisions, confusion, calibration, comparison, blends.

A probability row is ``(row_id, y, fold, model, probs ARRAY<DOUBLE>)``; a decision row adds
``pred``, ``conf`` and ``p_true``.  Argmax ties go to the lowest class id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import lgamma, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import ordered
from tessera.session import cut
from tessera.vocabulary import N_CLASSES

n_rows = lambda name="n": F.count(F.lit(1)).alias(name)
tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
EPS = 1e-9


def argmax(probs: str | Column) -> Column:
    arr = F.col(probs) if isinstance(probs, str) else probs
    return F.array_position(arr, F.array_max(arr)).cast("int") - 1


def argmax_rows(prob_rows: DataFrame) -> DataFrame:
    return prob_rows.select("row_id", "y", "fold", "model", argmax("probs").alias("pred"), F.array_max("probs").alias("conf"),
                            F.element_at("probs", F.col("y") + 1).alias("p_true"))


def class_rows(df: DataFrame, value: str = "label_id", n: int = N_CLASSES) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(value))


# ---- decisions -------------------------------------------------------------------------------

def force_class(rows: DataFrame, when: str, sources: Sequence[int], target: int) -> DataFrame:
    """Send decisions in ``sources`` to ``target`` where the predicate column holds."""
    return rows.withColumn("ruled", F.when(F.col("pred").isin(*sources) & F.col(when), F.lit(target)).otherwise(F.col("pred")))


def prior_row(rows: DataFrame) -> DataFrame:
    """Class shares as one array row."""
    return rows.agg(F.array(*[share(F.col("y") == k) for k in range(N_CLASSES)]).alias("prior"))


def prior_correct(prob_rows: DataFrame, prior: Column) -> DataFrame:
    """Divide by the class prior and renormalise; a class without rows gets no weight."""
    d = prob_rows.withColumn("__prior", prior)
    w = F.zip_with("probs", "__prior", lambda p, q: F.coalesce(F.try_divide(p, q), F.lit(0.0)))
    return normalise(d.withColumn("probs", w).drop("__prior"))


def normalise(prob_rows: DataFrame) -> DataFrame:
    """Rows scaled to sum 1; the sum is made once per row, not once per class."""
    return prob_rows.withColumn("probs", F.aggregate("probs", F.lit(0.0), lambda a, b: a + b, lambda t: F.transform("probs", lambda p: p / t)))


def defer_within_pair(prob_rows: DataFrame, margin: float, prior: Column) -> DataFrame:
    """When the two best classes belong to one application and are close, answer with the more frequent one."""
    ranked = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("np"), i.alias("k"))))
    df = prob_rows.withColumn("__r", F.slice(ranked, 1, 2)).withColumn("__prior", prior)
    k1, k2 = F.col("__r")[0]["k"], F.col("__r")[1]["k"]
    gap = F.col("__r")[1]["np"] - F.col("__r")[0]["np"]
    close = (F.floor(k1 / 2) == F.floor(k2 / 2)) & (gap < margin)
    prefer2 = F.element_at("__prior", k2 + 1) > F.element_at("__prior", k1 + 1)
    return df.select("row_id", "y", "model", k1.alias("raw_pred"), F.when(close & prefer2, k2).otherwise(k1).alias("pred"))


# ---- scores ----------------------------------------------------------------------------------

def confusion(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts in fixed class order, one row per true class (and key)."""
    keys = list(keys)
    got = rows.groupBy(*keys, "y").agg(*[tally(F.col("pred") == k).alias(f"p{k}") for k in range(N_CLASSES)])
    if keys:
        return got
    full = class_rows(rows, "y").join(got, "y", "left")
    return full.select("y", *[F.coalesce(f"p{k}", F.lit(0)).alias(f"p{k}") for k in range(N_CLASSES)])


def hard_pairs(rows: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent confusions; ties by class ids."""
    return (rows.filter("y <> pred").groupBy("y", "pred").agg(n_rows("count"))
            .orderBy(F.desc("count"), "y", "pred").limit(k))


def class_report(rows: DataFrame, keys: Sequence[str] = (), pred: str = "pred", weight: Column | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined values are 0 and absent classes count."""
    keys = list(keys)
    w = F.lit(1) if weight is None else weight
    cells = rows.groupBy(*keys, "y", pred).agg(F.sum(w).alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)))
    sides = F.explode(F.array(F.struct(F.col("y").alias("label_id"), F.when(F.col("y") == F.col(pred), F.col("n")).otherwise(0).alias("tp"),
                                       F.col("n").alias("actual"), F.lit(0).cast("long").alias("called")),
                              F.struct(F.col(pred).alias("label_id"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"),
                                       F.col("n").alias("called"))))
    # one zero row per class keeps absent classes in the report
    zero = cells.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    zeros = zero.select(*keys, k.alias("label_id"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "actual", "called")])
    long = cells.select(*keys, sides.alias("s")).select(*keys, "s.*").unionByName(zeros)
    agg = long.groupBy(*keys, "label_id").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "called")])
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return agg.select(*keys, "label_id", div(F.col("tp"), F.col("called")).alias("precision"), div(F.col("tp"), F.col("actual")).alias("recall"),
                      div(2 * F.col("tp"), F.col("called") + F.col("actual")).alias("f1"), F.col("actual").alias("support"), "tp")


def summary(rows: DataFrame, keys: Sequence[str] = (), pred: str = "pred", weight: Column | None = None) -> DataFrame:
    """Accuracy and macro-F1."""
    rep = class_report(rows, keys, pred, weight)
    return rep.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")), F.lit(0.0)).alias("accuracy"),
                                  F.avg("f1").alias("macro_f1"))


def log_loss(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(-F.log(F.greatest("p_true", F.lit(EPS)))).alias("log_loss"))


def calibration_error(rows: DataFrame, keys: Sequence[str] = (), bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins, open below and closed above."""
    keys = list(keys)
    b = rows.withColumn("bin", F.greatest(F.ceil(F.col("conf") * bins), F.lit(1)))
    per = b.groupBy(*keys, "bin").agg(n_rows(), share(F.col("pred") == F.col("y")).alias("acc"), F.avg("conf").alias("c"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("c"))) / F.sum("n")).alias("ece"))


def calibration_summary(rows: DataFrame, method: str = "model", raw: str | None = None) -> DataFrame:
    """Accuracy, NLL, ECE and mean confidence when wrong per method, with the best and the selected one marked."""
    base = rows.groupBy(method).agg(share(F.col("pred") == F.col("y")).alias("accuracy"),
                                    F.avg(F.when(F.col("pred") != F.col("y"), F.col("conf"))).alias("wrong_confidence"))
    s = base.join(log_loss(rows, [method]), method).join(calibration_error(rows, [method]), method)
    # one row per method from here on
    every = Window.partitionBy(F.lit(0))
    first = lambda col: F.row_number().over(every.orderBy(col, method)) == 1
    raw_acc = F.max(F.when(F.col(method) == raw, F.col("accuracy"))).over(every)
    s = s.withColumn("eligible", F.col("accuracy") >= raw_acc - 0.01)
    return (s.withColumn("best_by_nll", first(F.col("log_loss"))).withColumn("best_by_ece", first(F.col("ece")))
            .withColumn("selected", F.row_number().over(every.orderBy(F.desc("eligible"), "log_loss", method)) == 1).drop("eligible"))


def error_budget(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("y").agg(n_rows("support"), tally(F.col("pred") != F.col("y")).alias("errors"),
                                F.coalesce(F.avg(F.when(F.col("pred") != F.col("y"), F.col("conf"))), F.lit(0.0)).alias("wrong_confidence"))
    total = F.sum("errors").over(Window.partitionBy(F.lit(0)))  # at most one row per class
    return per.withColumn("error_share", F.col("errors") / F.greatest(total, F.lit(1)))


def regime_table(rows: DataFrame, flag: str = "audio_only") -> DataFrame:
    per = rows.groupBy(flag).agg(n_rows("flows"), share(F.col("pred") == F.col("y")).alias("accuracy"), tally(F.col("pred") != F.col("y")).alias("errors"))
    total = F.sum("flows").over(Window.partitionBy(F.lit(0)))  # two rows
    return per.select(F.when(F.col(flag), "audio_only").otherwise("larger_packet").alias("regime"), "flows",
                      (F.col("flows") / total).alias("share"), "accuracy", "errors")


# ---- comparison ------------------------------------------------------------------------------

def paired_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two models on the same rows: rows meet by a grouped maximum, not a join."""
    ok = F.col("pred") == F.col("y")
    flag = lambda m: F.max(F.when(F.col("model") == m, ok))
    per = rows.filter(F.col("model").isin(a, b)).groupBy("row_id").agg(flag(a).alias("a"), flag(b).alias("b")).dropna()
    return per.agg(n_rows("rows"), share(F.col("a")).alias("acc_a"), share(F.col("b")).alias("acc_b"),
                   tally(F.col("b") & ~F.col("a")).alias("b_only"), tally(F.col("a") & ~F.col("b")).alias("a_only"))


def _stirling_rest(n: Column) -> Column:
    """ln n! minus Stirling's main term; small n from the definition, larger n from the series."""
    small = [lgamma(k + 1) - ((k + 0.5) * log(k) - k + 0.5 * log(2 * pi)) for k in range(1, 16)]
    x = n.cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 15, F.try_element_at(F.array(*[F.lit(v) for v in small]), n.cast("int"))).otherwise(series)


def _log_half_binomial(n: Column, i: Column) -> Column:
    """ln of C(n, i) / 2^n for 0 < i < n, in the form that keeps its digits for large n."""
    p = i / n
    divergence = p * F.log(2 * p) + (1 - p) * F.log(2 * (1 - p))
    return -n * divergence - 0.5 * F.log(2 * pi * n * p * (1 - p)) + _stirling_rest(n) - _stirling_rest(i) - _stirling_rest(n - i)


def mcnemar(counts: DataFrame) -> DataFrame:
    """Exact two-sided binomial test on the discordant pairs.

    At p = 1/2 the distribution is symmetric, so the value is twice the smaller tail, capped at 1.  The tail
    is summed downwards from its largest term; terms more than 6 sqrt(n) further down are below e^-72 of
    it, so the work grows with sqrt(n) and not with the number of rows.
    """
    d = counts.withColumn("n", F.col("a_only") + F.col("b_only")).withColumn("lo", F.least("a_only", "b_only"))
    n, lo = F.col("n"), F.col("lo")
    d = d.withColumn("__top", F.when(lo == 0, -n * log(2.0)).otherwise(_log_half_binomial(n, lo)))
    terms = F.least(lo, F.ceil(6 * F.sqrt(n.cast("double"))) + 100)
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), terms.cast("bigint")),
                        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
                        lambda s, k: F.struct((s["term"] * (lo - k) / (n - lo + k + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
                        lambda s: s["sum"])
    p = F.when(n == 0, F.lit(None).cast("double")).when(F.col("a_only") == F.col("b_only"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp("__top") * total))
    d = d.withColumn("p_value", p)
    sig = F.col("p_value") < 0.05
    return d.withColumn("verdict", F.when(sig & (F.col("b_only") > F.col("a_only")), "B significantly better")
                        .when(sig & (F.col("a_only") > F.col("b_only")), "A significantly better").otherwise("not established")).drop("lo", "__top").withColumnRenamed("n", "discordant")


def best_points(points: DataFrame, families: Sequence[str]) -> dict[str, str]:
    """The strongest stored point of each family; ``points`` has family, point, group_acc, one row per stored point.

    A point without a positive score does not count; of equal scores the first by name is taken.  A family without a
    point is an error.
    """
    own = points.filter(F.col("family").isin(list(families)) & (F.col("group_acc") > 0))
    ranked = own.groupBy("family", "group_acc").agg(F.min("point").alias("point"))
    best = {r["family"]: r["point"] for r in ranked.groupBy("family").agg(F.max_by("point", "group_acc").alias("point")).collect()}  # one row per family
    if set(best) != set(families):
        raise ValueError(f"families without a stored point: {sorted(set(families) - set(best))}")
    return best


def compare_best(rows: DataFrame, points: DataFrame, a: str, b: str) -> DataFrame:
    """The exact test between the strongest stored points of two families; ``rows`` holds the answers of every point under its name."""
    best = best_points(points, [a, b])
    return mcnemar(paired_counts(rows, best[a], best[b])).select(F.lit(best[a]).alias("point_a"), F.lit(best[b]).alias("point_b"), "*")


def bootstrap_gain(rows: DataFrame, before: str, after: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the macro-F1 difference.

    Rows shrink to counts per (y, before, after) first.  The Poisson(1) weights of a cell's rows add up to one Poisson
    draw with the count as its mean, so each replicate draws one total per cell; draws are seeded by the replicate and
    cells stand in a fixed order, so a retry repeats them.  There are at most classes^3 cells, whatever the rows.
    """
    cells = rows.groupBy("y", before, after).agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("y").cast("int").alias("y"), F.col(before).cast("int").alias("a"), F.col(after).cast("int").alias("b"), "n"))).alias("cells"))
    spark = rows.sparkSession
    reps = spark.range(replicates).select(F.col("id").cast("int").alias("rep")).withColumn("cells", cells.select("cells").scalar())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rep, own in zip(pdf["rep"], pdf["cells"]):
                y, a, b, n = (np.array([c[k] for c in own], np.int64) for k in ("y", "a", "b", "n"))
                w = np.random.default_rng([seed, int(rep)]).poisson(n)
                classes = range(N_CLASSES)
                f1 = lambda p: np.mean([2 * w[(y == k) & (p == k)].sum() / max(w[y == k].sum() + w[p == k].sum(), 1) for k in classes])
                out.append((rep, f1(b) - f1(a)))
            yield pd.DataFrame(out, columns=["rep", "delta"]).astype({"rep": "int32", "delta": "float64"})

    d = reps.mapInPandas(draw, "rep int, delta double")
    # one row per replicate
    return d.agg(F.avg("delta").alias("delta_mean"), F.percentile("delta", F.lit(0.025)).alias("ci_low"),
                 F.percentile("delta", F.lit(0.975)).alias("ci_high"), share(F.col("delta") > 0).alias("p_gain_positive"))


# ---- groups and clusters ---------------------------------------------------------------------

def cluster_quality(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Mean purity, singletons, largest cluster and adjusted Rand index from the contingency counts."""
    cell = cut(rows.groupBy(cluster, truth).agg(n_rows()))  # five figures read the counts
    per = cell.groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    head = per.agg(n_rows("clusters"), F.avg(F.col("top") / F.col("n")).alias("mean_purity"), tally(F.col("n") == 1).alias("singletons"),
                   F.max("n").alias("largest"))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    a, b = per.agg(pairs("n")), cell.groupBy(truth).agg(F.sum("n").alias("n")).agg(pairs("n"))
    both, total = cell.agg(pairs("n")), cell.agg((F.sum("n").cast("double") * (F.sum("n") - 1) / 2))
    d = head.withColumns({"__a": a.scalar(), "__b": b.scalar(), "__ab": both.scalar(), "__t": total.scalar()})
    expected = F.col("__a") * F.col("__b") / F.col("__t")
    ari = F.coalesce(F.try_divide(F.col("__ab") - expected, (F.col("__a") + F.col("__b")) / 2 - expected), F.lit(1.0))
    return d.withColumn("adjusted_rand", ari).drop("__a", "__b", "__ab", "__t")


def group_vote(prob_rows: DataFrame, group: str, how: str) -> DataFrame:
    """One answer per group of at least two rows: summed logs, or probabilities weighted by confidence^4."""
    p = F.posexplode("probs").alias("k", "p")
    if how == "logsum":
        long = prob_rows.select(group, p).withColumn("v", F.log(F.greatest("p", F.lit(EPS))))
    else:
        long = prob_rows.withColumn("w", F.pow(F.array_max("probs"), F.lit(4.0))).select(group, "w", p).withColumn("v", F.col("p") * F.col("w"))
    tot = long.groupBy(group, "k").agg(F.sum("v").alias("v"), n_rows())
    best = tot.filter("n > 1").groupBy(group).agg(F.max_by("k", F.struct(F.round("v", 9), -F.col("k"))).cast("int").alias("vote"))
    rows = argmax_rows(prob_rows.select("row_id", "y", "fold", "model", "probs"))
    return (prob_rows.select("row_id", group).join(rows, "row_id").join(best, group, "left")
            .withColumn("voted", F.coalesce("vote", "pred")).drop("vote"))


# ---- blends ----------------------------------------------------------------------------------

def blend(prob_rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the members' arrays, row-normalised; one grouped pass over (row, class)."""
    w = F.coalesce(*[F.when(F.col("model") == m, F.lit(float(v))) for m, v in weights.items()])
    sums = [F.sum(w * F.element_at("probs", k + 1)) for k in range(N_CLASSES)]
    out = prob_rows.filter(F.col("model").isin(*weights)).groupBy("row_id", "y", "fold").agg(F.array(*sums).alias("probs"))
    return normalise(out.withColumn("model", F.lit("blend")))


def rank_average(prob: DataFrame) -> DataFrame:
    """Mean over members of the tie-averaged rank of each class column, as a share of the rows."""
    ranks = ordered.average_ranks(prob, ["model", "k"], "p")
    tot = prob.groupBy("model", "k").agg(n_rows("n"))
    r = prob.join(ranks, ["model", "k", "p"]).join(F.broadcast(tot), ["model", "k"])  # one row per member and class
    return r.groupBy("row_id", "k").agg(F.avg(F.col("avg_rank") / F.col("n")).alias("rank_score"))


def temper(prob_rows: DataFrame, t: float | Column) -> DataFrame:
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return normalise(prob_rows.withColumn("probs", F.transform("probs", lambda p: F.pow(F.greatest(p, F.lit(EPS)), 1 / t))))


def temperature_grid(lo: float = 0.4, hi: float = 4.0, n: int = 73) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def temperature_losses(prob_rows: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """NLL at each grid temperature: all grid points are aggregates of one pass, nothing is replicated."""
    logs = [F.log(F.greatest(F.element_at("probs", k + 1), F.lit(EPS))) for k in range(N_CLASSES)]
    z = prob_rows.select(*keys, F.col("y"), *[l.alias(f"z{k}") for k, l in enumerate(logs)])
    zy = F.element_at(F.array(*[F.col(f"z{k}") for k in range(N_CLASSES)]), F.col("y") + 1)
    z = z.withColumn("zy", zy).withColumn("top", F.greatest(*[F.col(f"z{k}") for k in range(N_CLASSES)]))
    grid = temperature_grid()
    arr = F.array(*[F.lit(g) for g in grid])
    # per row: array of losses over the grid, then an element-wise mean through posexplode with partial sums
    zs = F.array(*[F.col(f"z{k}") - F.col("top") for k in range(N_CLASSES)])
    losses = F.transform(arr, lambda t: F.log(F.aggregate(zs, F.lit(0.0), lambda a, v: a + F.exp(v / t))) - (F.col("zy") - F.col("top")) / t)
    return (z.select(*keys, F.posexplode(losses).alias("g", "loss")).groupBy(*keys, "g").agg(F.avg("loss").alias("nll"))
            .withColumn("temperature", F.element_at(arr, F.col("g") + 1)))


def fit_temperature(prob_rows: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return temperature_losses(prob_rows, keys).groupBy(*keys).agg(
        F.min_by(F.struct("temperature", "nll"), F.struct(F.round("nll", 12), "g")).alias("b")).select(*keys, "b.*")


# ---- cross-corpus ----------------------------------------------------------------------------

def app_crosstab(prob_rows: DataFrame) -> DataFrame:
    """True application by predicted application."""
    rows = argmax_rows(prob_rows).withColumn("true_app", F.floor(F.col("y") / 2).cast("int")).withColumn("pred_app", F.floor(F.col("pred") / 2).cast("int"))
    return rows.groupBy("true_app").agg(*[tally(F.col("pred_app") == a).alias(f"app{a}") for a in range(5)],
                                        share(F.col("true_app") == F.col("pred_app")).alias("agreement"))


def restricted_agreement(prob_rows: DataFrame, allowed: Sequence[int]) -> DataFrame:
    """Agreement on rows of the allowed applications when the answer must be one of them."""
    apps = [F.element_at("probs", 2 * a + 1) + F.element_at("probs", 2 * a + 2) for a in allowed]
    arr = F.array(*apps)
    best = F.element_at(F.array(*[F.lit(a) for a in allowed]), F.array_position(arr, F.array_max(arr)).cast("int"))
    rows = prob_rows.withColumn("true_app", F.floor(F.col("y") / 2).cast("int")).filter(F.col("true_app").isin(*allowed))
    return rows.agg(n_rows("rows"), share(best == F.col("true_app")).alias("restricted_agreement"))
