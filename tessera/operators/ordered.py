"""Order statistics that never put a whole group on one task.

A plain window over a hot key sorts that key's rows in a single task.  The helpers here split every
group into slices of its order first, add up slice totals (a few rows per key), and run the window
inside ``(key, slice)`` only.  Slices are a column the caller names, or ranges whose number grows with the
rows; ranges are written with the rows, so any recomputation finds the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut

#: Rows that one task orders.
SLICE_ROWS = 200_000

def ordinal_in_slots(df: DataFrame, keys: Sequence[str], slots: Sequence[str],
                     order: Sequence[Column | str], out: str) -> DataFrame:
    """Zero-based row number per key.

    ``slots`` must be non-decreasing along ``order``; rows are numbered inside a slot and shifted by
    the number of rows in earlier slots of the same key.
    """
    keys, slots = list(keys), list(slots)
    sizes = df.groupBy(*keys, *slots).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*slots).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, *slots, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = Window.partitionBy(*keys, *slots).orderBy(*order)
    return (df.join(starts, keys + slots)
            .withColumn(out, F.row_number().over(local) - 1 + F.col("__start"))
            .drop("__start"))


def crowded(df: DataFrame, keys: Sequence[str], rows: int = SLICE_ROWS) -> DataFrame | None:
    """Keys with more than ``rows`` rows, written once; None where there are none."""
    many = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows).select(*keys))
    return None if many.isEmpty() else many


def ordinal_by_size(df: DataFrame, keys: Sequence[str], slots: Sequence[str], order: Sequence[Column | str], out: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``ordinal_in_slots`` for keys with more than ``rows`` rows only; the others are numbered in one exchange by key."""
    many = crowded(df, keys, rows)
    few = df if many is None else df.join(many, list(keys), "left_anti")
    numbered = few.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    if many is None:
        return numbered
    return numbered.unionByName(ordinal_in_slots(df.join(many, list(keys), "left_semi"), keys, slots, order, out))


def sliced(df: DataFrame, order: Sequence[Column | str], out: str = "__slice", rows: int = SLICE_ROWS) -> DataFrame:
    """Adds a slice number that does not decrease along ``order``; slices hold about ``rows`` rows, whatever the keys.

    Range splitters come from a sample of the rows, so a key of any size is cut where its rows lie.  The numbers are
    written once with the rows, and a lost executor cannot move a border.  Rows equal in ``order`` share a slice.
    """
    base = cut(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-base.count() // rows))
    return cut(base.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id()))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Zero-based row number per key along ``order``; no key is sorted in one task."""
    cols = [*keys, *order]
    return ordinal_in_slots(sliced(df, cols, rows=rows), keys, ["__slice"], order, out).drop("__slice")


def running_totals(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                   rows: int = SLICE_ROWS) -> DataFrame:
    """Exclusive running sums in value order; ``df`` holds one row per (keys, value).

    Adds ``<s>_below`` for every column in ``sums``: its total over smaller values of the same key.
    """
    keys, sums = list(keys), list(sums)
    cutup = sliced(df, [*keys, value], rows=rows)
    totals = cutup.groupBy(*keys, "__slice").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__slice", *[
        F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}_start") for s in sums])
    local = (Window.partitionBy(*keys, "__slice").orderBy(value)
             .rowsBetween(Window.unboundedPreceding, -1))
    out = cutup.join(starts, keys + ["__slice"])
    for s in sums:
        out = out.withColumn(f"{s}_below", F.coalesce(F.sum(s).over(local), F.lit(0)) + F.col(f"__{s}_start"))
    return out.drop("__slice", *[f"__{s}_start" for s in sums])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(out))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key, exact, without holding a group in memory."""
    keys = list(keys)
    counts = value_counts(df.filter(F.col(value).isNotNull()), keys, value, "__c")
    run = running_totals(counts, keys, value, ["__c"])
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    run = run.join(total, keys) if keys else run.withColumn("__total", total.scalar())
    return ranked_percentiles(run, keys, value, probs)


def percentile_ranks(total: Column, p: float | Column) -> tuple[Column, Column]:
    """The two ranks between which a percentile is interpolated."""
    at = (total - 1) * (p if isinstance(p, Column) else F.lit(p))
    return F.floor(at), F.ceil(at)


def ranked_percentiles(run: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles per key from values with __c (times), __c_below (rows with smaller values) and __total."""
    keys = list(keys)
    ranks = {n: percentile_ranks(F.col("__total"), p) for n, p in probs.items()}
    at = lambda r: F.max(F.when((F.col("__c_below") <= r) & (r < F.col("__c_below") + F.col("__c")), F.col(value)))
    aggs = [F.max("__total").alias("__total")]
    for name, (low, high) in ranks.items():
        aggs += [at(low).alias(f"__lo_{name}"), at(high).alias(f"__hi_{name}")]
    picked = run.groupBy(*keys).agg(*aggs)
    cols = [(F.col(f"__lo_{n}") + ((F.col("__total") - 1) * F.lit(p) - ranks[n][0])
             * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n) for n, p in probs.items()]
    return picked.select(*keys, *cols)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """One row per (keys, value) with the tie-averaged rank of that value."""
    run = running_totals(value_counts(df, keys, value, "__c"), keys, value, ["__c"])
    return run.select(*keys, value, (F.col("__c_below") + (F.col("__c") + 1) / 2).alias(out))


def rank_auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column,
             out: str = "auc") -> DataFrame:
    """Area under the ROC curve per key by the Mann-Whitney form; ties count half."""
    keys = list(keys)
    counts = df.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("__c"), F.sum(F.when(positive, 1).otherwise(0)).alias("__p"))
    run = running_totals(counts, keys, score, ["__c"])
    return (run.groupBy(*keys).agg(
        F.sum(F.col("__p") * (F.col("__c_below") + (F.col("__c") + 1) / 2)).alias("__s"),
        F.sum("__p").alias("__np"), F.sum("__c").alias("__n"))
        .select(*keys, F.try_divide(
            F.col("__s") - F.col("__np") * (F.col("__np") + 1) / 2,
            (F.col("__np") * (F.col("__n") - F.col("__np"))).cast("double")).alias(out)))
