"""Folds, class weights and controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.draws import hash_text
from tessera.operators.ordered import ordinal


def seeded_ordinal(df: DataFrame, keys: Sequence[str], row: str, seed: int, out: str) -> DataFrame:
    """Position of each row in a seeded permutation of its key's rows.

    The permutation orders by a text hash that every engine has; slices grow with the rows.
    """
    return ordinal(df.withColumn("__h", hash_text(seed, row)), keys, ["__h", row], out).drop("__h")


def permuted_folds(df: DataFrame, row: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Fold = position in a seeded permutation modulo k: sizes differ by one row at most."""
    return seeded_ordinal(df, [], row, seed, "__o").withColumn("fold", (F.col("__o") % k).cast("int")).drop("__o")


def stratified_folds(df: DataFrame, row: str, label: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Repeated stratified folds: within a class and repeat, fold sizes differ by one at most."""
    reps = df.select(row, label).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = ordinal(reps.withColumn("__h", hash_text(seed, row, "repeat")), ["repeat", label], ["__h", row], "__o")
    return d.select(row, label, "repeat", ((F.col("__o") + F.col("repeat")) % k).cast("int").alias("fold"))


def group_folds(df: DataFrame, row: str, group: str, label: str, k: int = 5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """Stratified group folds: a group never straddles folds and class mixes stay close.

    Groups shrink to (size, dominant class) first.  Within a dominant class they are dealt from large to
    small in snake order, so neighbouring sizes land in different folds.
    """
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(group).agg(F.sum("n").alias("size"), F.max_by(label, F.struct("n", -F.col(label))).alias("__main"))
    g = g.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    g = g.withColumn("__h", hash_text(seed, group, "repeat")).withColumn("__neg", -F.col("size"))
    g = ordinal(g, ["repeat", "__main"], ["__neg", "__h", group], "__o")
    turn, lap = F.col("__o") % k, F.floor(F.col("__o") / k)
    snake = F.when(lap % 2 == 0, turn).otherwise(k - 1 - turn)
    g = g.select(group, "repeat", F.pmod(snake + F.col("__main"), F.lit(k)).cast("int").alias("fold"))
    return df.select(row, group, label).join(g, group)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * count) per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    return per.withColumn("weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")))


def prior_accuracy(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("prior_accuracy"))


def shuffled_labels(df: DataFrame, row: str, label: str, seed: int) -> DataFrame:
    """Every row gets the label of the row at the same position of another permutation."""
    a = seeded_ordinal(df, [], row, seed, "__o")
    b = seeded_ordinal(df.select(row, label), [], row, seed + 1, "__o").select("__o", F.col(label).alias("shuffled"))
    return a.join(b, "__o").drop("__o")
