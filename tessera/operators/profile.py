"""Integrity, duplicate, collision, drift and class profiles of a flow table, and key lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import ordered
from tessera.operators.flows import gap_rows, gaps, label_text, lens, packet_rows, times
from tessera.session import cut
from tessera.vocabulary import (APPS, BANDS, CALLS_TEST, CALLS_TRAIN, FLOW_COLUMNS, N_CLASSES, TIMES)

n_rows = lambda name="n": F.count(F.lit(1)).alias(name)
share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def integrity(df: DataFrame) -> DataFrame:
    """One pass over the rows."""
    x = lens()
    return df.agg(
        n_rows("n_rows"), F.sum(sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in FLOW_COLUMNS), F.lit(0))).alias("missing_cells"),
        (tally(F.abs(F.col(TIMES[0])) > 1e-8) == 0).alias("t0_all_zero"),
        tally(any_of([g < 0 for g in gaps()])).alias("non_monotonic_rows"),
        tally(any_of([g == 0 for g in gaps()])).alias("zero_gap_rows"),
        F.min(F.least(*x)).alias("min_length"), F.max(F.greatest(*x)).alias("max_length"),
        F.min(times()[-1]).alias("min_duration"), F.max(times()[-1]).alias("max_duration"))


def collisions(df: DataFrame, key: str = "lkey") -> DataFrame:
    """Duplicate and collision counts; every group is reduced to one row before it is looked at."""
    per_row = df.groupBy(*FLOW_COLUMNS).agg(n_rows())
    per_key = df.groupBy(key).agg(n_rows(), F.countDistinct("label_id").alias("classes"))
    dup = per_row.agg((F.sum("n") - n_rows()).alias("exact_duplicate_rows"))
    keys = per_key.agg(n_rows("unique_length_tuples"), tally(F.col("classes") > 1).alias("length_tuples_multiclass"),
                       F.sum(F.when(F.col("classes") > 1, F.col("n")).otherwise(0)).alias("rows_in_multiclass_tuples"))
    return keys.withColumn("exact_duplicate_rows", dup.scalar())


def class_mix(df: DataFrame, key: str = "lkey") -> DataFrame:
    """Class counts of every key that carries more than one class."""
    per = df.groupBy(key).agg(*[tally(F.col("label_id") == k).alias(f"c{k}") for k in range(N_CLASSES)])
    classes = sum((F.when(F.col(f"c{k}") > 0, 1).otherwise(0) for k in range(N_CLASSES)), F.lit(0))
    return per.filter(classes > 1)


def group_sizes(df: DataFrame, key: str = "gkey") -> DataFrame:
    sizes = df.groupBy(key).agg(n_rows())
    big = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return sizes.agg(n_rows("n_pseudo_groups"), F.max("n").alias("largest_group"), big.alias("rows_in_groups_gt1"),
                     (big / F.sum("n")).alias("share_rows_in_groups_gt1"))


def frequent_values(packets: DataFrame, k: int = 60) -> DataFrame:
    """Share of each of the ``k`` most frequent lengths within a class; ties go to the smaller length."""
    by_class = packets.groupBy("label_id", "length").agg(n_rows())
    top = (by_class.groupBy("length").agg(F.sum("n").alias("total"))
           .orderBy(F.desc("total"), "length").limit(k).select("length"))
    # both sides are counts: at most classes x distinct lengths rows
    kept = by_class.join(F.broadcast(top), "length", "left_semi")
    total = F.sum("n").over(Window.partitionBy("label_id"))
    return kept.select("label_id", "length", "n", (F.col("n") / total).alias("share"))


def top_values_text(packets: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent lengths per class as ``v(c), v(c)``."""
    by_class = packets.groupBy("label_id", "length").agg(n_rows())
    w = Window.partitionBy("label_id").orderBy(F.desc("n"), "length")
    top = by_class.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    item = F.concat(F.col("length").cast("bigint").cast("string"), F.lit("("), F.col("n").cast("string"), F.lit(")"))
    return top.groupBy("label_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", item.alias("s")))), lambda z: z["s"]), ", ").alias("top_lengths"))


def band_mix(packets: DataFrame) -> DataFrame:
    return packets.groupBy("label_id").agg(*[
        share((F.col("length") >= lo) & (F.col("length") < hi)).alias(f"share_{b}") for b, (lo, hi) in BANDS.items()])


def mtu_contrast(packets: DataFrame) -> DataFrame:
    """Mean over classes of the MTU share, video against voice."""
    per = band_mix(packets).withColumn("mode", F.when(F.col("label_id") % 2 == 1, "video").otherwise("voice"))
    return per.groupBy("mode").agg(F.avg("share_mtu").alias("mean_mtu_share"))


def mean_by_position(packets: DataFrame) -> DataFrame:
    return packets.groupBy("label_id").agg(*[
        F.avg(F.when(F.col("packet_index") == i, F.col("length"))).alias(f"pos_{i}") for i in range(5)])


def constant_flows(df: DataFrame) -> DataFrame:
    x = lens()
    constant = reduce(lambda a, b: a & b, [c == x[0] for c in x[1:]])
    return df.groupBy("label_id").agg(tally(constant).alias("constant_flows"), n_rows("total_flows"), share(constant).alias("share"))


def burstiness(df: DataFrame) -> DataFrame:
    rows = gap_rows(df, "label_id")
    agg = rows.groupBy("label_id").agg(share(F.col("iat") < 1e-3).alias("sub_ms"), share(F.col("iat") > 0.02).alias("over_20ms"))
    return agg.join(ordered.exact_percentiles(rows, ["label_id"], "iat", {"median_iat": 0.5}), "label_id")


def describe(df: DataFrame, keys: Sequence[str], value: str,
             probs: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles per key."""
    probs = probs or {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    basic = df.groupBy(*keys).agg(n_rows("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                  F.min(value).alias("min"), F.max(value).alias("max"))
    return basic.join(ordered.exact_percentiles(df, keys, value, probs), list(keys))


def class_prior(df: DataFrame) -> DataFrame:
    """Flows per source call and the test mix they imply; classes without flows count 0."""
    counts = [tally(F.col("label_id") == k).alias(f"c{k}") for k in range(N_CLASSES)]
    row = df.agg(*counts)
    long = row.select(F.posexplode(F.array(*[F.col(f"c{k}") for k in range(N_CLASSES)])).alias("label_id", "flows"),
                      sum((F.col(f"c{k}") for k in range(N_CLASSES)), F.lit(0)).alias("total"))
    per_call = F.col("flows") / CALLS_TRAIN
    return long.select("label_id", "flows", per_call.alias("flows_per_call"), (per_call * CALLS_TEST).alias("implied_test_flows"),
                       (F.col("flows") / F.col("total")).alias("implied_test_share"))


def mix_against_prior(pred: DataFrame, train: DataFrame) -> DataFrame:
    """Predicted class mix next to the prior; both sides are ten rows."""
    got = class_prior(pred).select("label_id", F.col("flows").alias("predicted_flows"), F.col("implied_test_share").alias("predicted_share"))
    prior = class_prior(train).select("label_id", F.col("implied_test_share").alias("prior_share"))
    return got.join(F.broadcast(prior), "label_id").withColumn("ratio", F.try_divide("predicted_share", "prior_share"))


def ks_statistic(df: DataFrame, columns: Sequence[str], side: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per column; ``side`` is true for the first sample.

    Values are counted first, so the ordered pass sees each distinct value once.
    """
    long = df.select(side.alias("s"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("r")).select("s", "r.*")
    counts = long.groupBy("feature", "value").agg(tally(F.col("s")).alias("a"), tally(~F.col("s")).alias("b"))
    run = ordered.running_totals(counts, ["feature"], "value", ["a", "b"])
    tot = counts.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    run = run.join(F.broadcast(tot), "feature")  # one row per column name
    fa = (F.col("a_below") + F.col("a")) / F.col("na")
    fb = (F.col("b_below") + F.col("b")) / F.col("nb")
    return run.groupBy("feature").agg(F.max(F.abs(fa - fb)).alias("ks_stat"), F.first("na").alias("n_a"), F.first("nb").alias("n_b"))


def ks_p_value(stats: DataFrame, terms: int = 100) -> DataFrame:
    """Asymptotic two-sided p-value from the alternating exponential series."""
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = en * F.col("ks_stat")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, j: acc + F.when(
        j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * F.col("__lam") * F.col("__lam")))
    out = stats.withColumn("__lam", lam)
    return out.withColumn("p_value", F.when(F.col("__lam") < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))).drop("__lam")


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with the share of rows at or below them."""
    counts = ordered.value_counts(df, keys, value, "c")
    run = ordered.running_totals(counts, keys, value, ["c"])
    tot = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    return run.join(tot, list(keys)).select(*keys, value, ((F.col("c_below") + F.col("c")) / F.col("n")).alias("ecdf"))


# ---- ambiguous subset ------------------------------------------------------------------------

APP = APPS.index("Zoom")  # fixed value: the application whose two modes overlap


def threshold_counts(df: DataFrame, cutoffs: Sequence[float] = (200, 250, 300, 400, 500), app: int = APP) -> DataFrame:
    """Size of the ambiguous subset for several length limits; one pass."""
    longest = F.greatest(*lens())
    own = F.floor(F.col("label_id") / 2) == app
    aggs = []
    for c in cutoffs:
        hit = own & (longest < c)
        aggs += [tally(hit).alias(f"n_{c}"), tally(hit & (F.col("label_id") % 2 == 0)).alias(f"v_{c}"),
                 tally(hit & (F.col("label_id") % 2 == 1)).alias(f"d_{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("threshold_bytes"), F.col(f"n_{c}").alias("flows"),
                              F.col(f"v_{c}").alias("voice"), F.col(f"d_{c}").alias("video")) for c in cutoffs])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def ceiling_sweep(df: DataFrame, limit: float = 300, app: int = APP, steps: int = 100) -> DataFrame:
    """Best macro-F1 when the ambiguous subset is answered with one class for a fraction p of it."""
    own = F.floor(F.col("label_id") / 2) == app
    amb = own & (F.greatest(*lens()) < limit)
    voice = F.col("label_id") % 2 == 0
    c = df.agg(n_rows("n"), tally(amb & voice).alias("nv"), tally(amb & ~voice).alias("nd"),
               tally(own & voice).alias("tv"), tally(own & ~voice).alias("td"))
    s = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")).withColumn("p", F.col("step") / steps)
    p, nv, nd, tv, td = (F.col(x) for x in ("p", "nv", "nd", "tv", "td"))
    f1 = lambda tp, fp, tot: F.coalesce(F.try_divide(2 * tp, tp + fp + tot), F.lit(0.0))
    fv = f1(nv * p, nd * p, tv)
    fd = f1(td - nd + nd * (1 - p), nv * (1 - p), td)
    s = s.withColumns({"f1_voice": fv, "f1_video": fd})
    s = s.withColumn("macro_f1", (N_CLASSES - 2 + F.col("f1_voice") + F.col("f1_video")) / N_CLASSES)
    best = F.max_by(F.struct("p", "macro_f1", "f1_voice", "f1_video"), F.struct(F.round("macro_f1", 12), -F.col("step")))
    return s.groupBy("n", "nv", "nd").agg(best.alias("b")).select(
        F.col("b.p").alias("voice_fraction"), F.col("b.macro_f1").alias("macro_f1"), F.col("b.f1_voice").alias("f1_voice"),
        F.col("b.f1_video").alias("f1_video"), ((F.col("n") - F.least("nv", "nd")) / F.col("n")).alias("accuracy"),
        (F.col("nv") + F.col("nd")).alias("ambiguous_flows"))


def majority_oracle(df: DataFrame, key: str) -> DataFrame:
    """Accuracy of answering each key with its most frequent class."""
    per = df.groupBy(key, "label_id").agg(n_rows()).groupBy(key).agg(F.max("n").alias("hit"), F.sum("n").alias("n"))
    return per.agg(n_rows("keys"), (F.sum("hit") / F.sum("n")).alias("oracle_accuracy"))


# ---- feature ranking -------------------------------------------------------------------------

def long_features(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select(*keep, "r.*")


def anova_f(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One-way ANOVA F per feature: class moments first, then one row per class is combined."""
    keys = list(keys)
    per = long_features(df, columns, "label_id", *keys).groupBy(*keys, "feature", "label_id").agg(
        n_rows(), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    tot = per.groupBy(*keys, "feature").agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), n_rows("k"))
    return (per.join(tot, keys + ["feature"]).groupBy(*keys, "feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.first("nn").alias("nn"), F.first("k").alias("k"))
        .select(*keys, "feature", F.coalesce(F.try_divide(
            F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("nn") - F.col("k"))), F.lit(0.0)).alias("anova_f")))


def binned_information(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information between the class and each feature cut at its rank deciles.

    This is a binned estimator, not a neighbour-based one.
    """
    long = long_features(df, columns, "label_id")
    counts = long.groupBy("feature", "value", "label_id").agg(n_rows())
    per_value = counts.groupBy("feature", "value").agg(F.sum("n").alias("c"))
    run = ordered.running_totals(per_value, ["feature"], "value", ["c"])
    total = per_value.groupBy("feature").agg(F.sum("c").alias("nn"))
    binned = (run.join(F.broadcast(total), "feature")  # one row per feature name
              .select("feature", "value", "nn", F.floor(F.col("c_below") * bins / F.col("nn")).alias("bin")))
    cell = counts.join(binned, ["feature", "value"]).groupBy("feature", "bin", "label_id").agg(F.sum("n").alias("n"), F.first("nn").alias("nn"))
    wb, wl = Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "label_id")
    cell = cell.withColumn("nb", F.sum("n").over(wb)).withColumn("nl", F.sum("n").over(wl))
    term = F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nb") * F.col("nl")))
    return cell.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1: shifted by eight, then the asymptotic series."""
    z = n + 8.0
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    return reduce(lambda a, i: a - 1 / (n + float(i)), range(8), series)


def neighbour_information(df: DataFrame, columns: Sequence[str], k: int = 3, rows: int = ordered.SLICE_ROWS) -> DataFrame:
    """Mutual information between the class and each feature from neighbours on the feature's axis.

    The radius of a row is the distance to its k-th neighbour in its class (all others, if the class has fewer); m counts
    the rows of any class strictly inside the radius, itself included, or equal to it if the radius is 0.  With n rows, c in
    the class: digamma(n) + mean(digamma(k) - digamma(c) - digamma(m)), not below 0.  Rows alone in their class, and null or
    NaN values or classes, take no part; no noise is added to tied values.  A feature without rows gives no row.

    Classes are numbered along the axis in slices; k rows beyond each border are copied, so a window holds one slice.
    m comes from running counts at both ends of the radius.
    """
    axis, rows = ["feature", "label_id"], max(rows, k)
    long = long_features(df, columns, "label_id").filter(F.col("label_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = long.groupBy(*axis).agg(n_rows("c")).filter("c > 1")  # features x classes
    at = ordered.ordinal(long.join(sizes, axis), axis, ["value"], "o", rows)
    part = lambda o: F.floor(o / rows)
    at = at.withColumn("own", part(F.col("o"))).withColumn("slice", F.explode(F.array_distinct(F.array(*[part(F.col("o") + x) for x in (-k, 0, k)]))))
    w = Window.partitionBy(*axis, "slice").orderBy("o")
    away = [F.abs(f("value", i).over(w) - F.col("value")) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    near = F.array_sort(F.filter(F.array(*away), lambda x: x.isNotNull()))
    at = at.withColumn("kk", F.least(F.lit(k), F.col("c") - 1)).withColumn("r", F.try_element_at(near, F.col("kk").cast("int"))).filter("slice = own")  # border copies may lack neighbours
    # rows of equal value, radius and class are one case with a count
    cases = at.groupBy(*axis, "c", "kk", "value", "r").agg(n_rows("times"))
    lo, hi = F.col("value") - F.col("r"), F.col("value") + F.col("r")
    counts = at.groupBy("feature", "value").agg(n_rows("here"))
    marks = counts.unionByName(cases.select("feature", F.explode(F.array(lo, hi)).alias("value"), F.lit(0).cast("long").alias("here"))).groupBy("feature", "value").agg(F.sum("here").alias("here"))
    run = cut(ordered.running_totals(marks, ["feature"], "value", ["here"], rows))
    left = run.select("feature", F.col("value").alias("lo"), (F.col("here_below") + F.col("here")).alias("upto"), F.col("here").alias("same"))
    right = run.select("feature", F.col("value").alias("hi"), F.col("here_below").alias("under"))
    found = cases.withColumn("lo", lo).withColumn("hi", hi).join(left, ["feature", "lo"]).join(right, ["feature", "hi"])
    found = found.withColumn("m", F.when(F.col("r") == 0, F.col("same")).otherwise(F.greatest(F.col("under") - F.col("upto"), F.lit(1))))
    term = F.col("times") * (digamma(F.col("kk")) - digamma(F.col("c")) - digamma(F.col("m")))
    return found.groupBy("feature").agg(F.greatest(digamma(F.sum("times")) + F.sum(term) / F.sum("times"), F.lit(0.0)).alias("mutual_info"))


# ---- lookups ---------------------------------------------------------------------------------

def pure_keys(train: DataFrame, key: str, *extra: str) -> DataFrame:
    """Keys whose rows all carry one class."""
    return (train.groupBy(*extra, key).agg(F.min("label_id").alias("lo"), F.max("label_id").alias("hi"))
            .withColumn("pure", F.col("lo") == F.col("hi")))


def lookup_summary(train: DataFrame, test: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Key counts in train and how many test rows they match; both sides shrink to keys before the join.

    ``by`` separates independent runs (such as tolerances), which then share one job.
    """
    by = list(by)
    keys = pure_keys(train, key, *by)
    probe = test.groupBy(*by, key).agg(n_rows())
    # one row per key of either side
    j = probe.join(keys, [*by, key], "full")
    n, pure = F.coalesce("n", F.lit(0)), F.col("pure")
    m = j.groupBy(*by).agg(tally(pure.isNotNull()).alias("distinct_train_tuples"), tally(pure).alias("pure_train_tuples"), F.sum(n).alias("test_rows"),
                           F.sum(F.when(pure.isNotNull(), n).otherwise(0)).alias("test_rows_matched"), F.sum(F.when(pure, n).otherwise(0)).alias("test_rows_matched_pure"))
    return m.select(*by, "distinct_train_tuples", "pure_train_tuples", "test_rows_matched", "test_rows_matched_pure",
                    (F.col("test_rows_matched") / F.col("test_rows")).alias("matched_share"),
                    (F.col("test_rows_matched_pure") / F.col("test_rows")).alias("matched_pure_share"))


def fold_answers(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, fold, answer): the single class seen under the key in all *other* folds, if there is one.

    ``cells`` is (key, fold, label_id, n).  No self join: a class is absent elsewhere exactly when its count
    in the fold equals its count in the key, so the answer follows from small per-key sums.
    """
    key = list(key)
    c = cells.groupBy(*key, "fold", "label_id").agg(F.sum("n").alias("nf"))
    # one row per key: at most classes x folds entries
    per = c.groupBy(*key).agg(F.collect_list(F.struct("fold", "label_id", "nf")).alias("cells"), F.collect_set("fold").alias("folds"))
    held = per.select(*key, "cells", F.explode("folds").alias("fold"))
    seen = F.array_distinct(F.transform(F.filter("cells", lambda x: x["fold"] != F.col("fold")), lambda x: x["label_id"]))
    return held.select(*key, "fold", seen.alias("seen")).filter(F.size("seen") == 1).select(*key, "fold", F.col("seen")[0].alias("answer"))


def fold_lookup(train: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Coverage and accuracy when each fold looks its keys up in the other folds."""
    by = list(by)
    per = train.groupBy(*by, key, "fold", "label_id").agg(n_rows())
    j = per.join(fold_answers(per, [*by, key]), [*by, key, "fold"], "left")
    return (j.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("answer").isNotNull(), F.col("n")).otherwise(0)).alias("rows_with_lookup"),
                               F.sum(F.when(F.col("answer") == F.col("label_id"), F.col("n")).otherwise(0)).alias("correct"))
            .select(*by, "rows_with_lookup", (F.col("rows_with_lookup") / F.greatest("rows", F.lit(1))).alias("coverage"),
                    (F.col("correct") / F.greatest("rows_with_lookup", F.lit(1))).alias("accuracy_when_available")))


def lookup_override(train: DataFrame, key: str, model_pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Replace the model answer where a pure key exists; ``model_pred`` is (flow_id, pred)."""
    by = list(by)
    rows = train.select("flow_id", *by, key, "fold", "label_id").join(model_pred, "flow_id")
    cell = rows.groupBy(*by, key, "fold", "label_id", "pred").agg(n_rows())
    j = cell.join(fold_answers(cell, [*by, key]), [*by, key, "fold"], "left")
    y, p, a, n = F.col("label_id"), F.col("pred"), F.col("answer"), F.col("n")
    w = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    s = j.groupBy(*by).agg(F.sum("n").alias("rows"), w(a.isNotNull()).alias("rows_covered"), w(a.isNotNull() & (p == y)).alias("mc"),
                           w(a.isNotNull() & (a == y)).alias("lc"), w(p == y).alias("m"), w(F.coalesce(a, p) == y).alias("o"),
                           w(F.coalesce(a, p) != p).alias("rows_changed"))
    return s.select(*by, "rows_covered", (F.col("rows_covered") / F.col("rows")).alias("coverage"),
                    F.try_divide("mc", "rows_covered").alias("model_accuracy_on_covered"),
                    F.try_divide("lc", "rows_covered").alias("lookup_accuracy_on_covered"),
                    (F.col("o") / F.col("rows")).alias("overall_accuracy"),
                    ((F.col("o") - F.col("m")) / F.col("rows")).alias("delta_vs_model"), "rows_changed")
