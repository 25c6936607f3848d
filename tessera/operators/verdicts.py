"""Verdict tables: wide sinks, gold export checks, scoring and vote arbitration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.vocabulary import N_CHECKPOINTS, VERDICTS

tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))


def cp_names(n: int = N_CHECKPOINTS) -> list[str]:
    return [f"CP{i}" for i in range(1, n + 1)]


def wide(long: DataFrame, value: str, n: int = N_CHECKPOINTS) -> DataFrame:
    """One row per case, blank where a checkpoint has no answer; the column list is fixed, so no extra pass."""
    out = long.groupBy("case_id").agg(*[
        F.coalesce(F.max(F.when(F.col("cp") == i, F.col(value))), F.lit("")).alias(f"CP{i}") for i in range(1, n + 1)])
    return out


def long_form(table: DataFrame, value: str = "verdict") -> DataFrame:
    """Wide CSV back to (case_id, cp, verdict); blanks are unanswered and dropped."""
    long = table.unpivot(["case_id"], cp_names(), "__cp", value)
    return (long.withColumn("cp", F.substring("__cp", 3, 9).cast("int")).drop("__cp").filter(F.col(value) != ""))


def missing_cases(expected: DataFrame, done: DataFrame) -> DataFrame:
    return expected.select("case_id").distinct().join(done, "case_id", "left_anti")


def grid_problems(long: DataFrame, value: str, n: int = N_CHECKPOINTS) -> DataFrame:
    """Per case: checkpoints without an answer and answers outside the allowed values; empty when clean."""
    per = long.groupBy("case_id").agg(F.countDistinct(F.when(F.col("cp").between(1, n), F.col("cp"))).alias("answered"),
                                      tally(~F.col(value).isin(*VERDICTS)).alias("invalid"))
    return per.select("case_id", (n - F.col("answered")).alias("missing"), "invalid").filter("missing > 0 or invalid > 0")


def score_cells(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold cells with the prediction beside them; a missing prediction is wrong."""
    j = gold.join(pred, ["case_id", "cp"], "left")
    return j.withColumn("ok", F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)))


def accuracy_report(cells: DataFrame) -> DataFrame:
    """Overall, per element, per checkpoint and per case, as one grouping-sets aggregate."""
    view = cells.select("element", "cp", "case_id", F.when(F.col("ok"), 1).otherwise(0).alias("hit"))
    g = view.groupingSets([[], [F.col("element")], [F.col("cp")], [F.col("case_id")]], F.col("element"), F.col("cp"), F.col("case_id"))
    out = g.agg(F.sum("hit").alias("correct"), F.count(F.lit(1)).alias("total"), F.grouping("element").alias("ge"),
                F.grouping("cp").alias("gc"), F.grouping("case_id").alias("gs"))
    level = (F.when(F.col("ge") == 0, "element").when(F.col("gc") == 0, "cp").when(F.col("gs") == 0, "case").otherwise("overall"))
    name = F.coalesce(F.col("element"), F.col("cp").cast("string"), F.col("case_id").cast("string"), F.lit("all"))
    return out.select(level.alias("level"), name.alias("name"), "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"))


def case_spread(cells: DataFrame) -> DataFrame:
    """Mean, population deviation and extremes of the per-case accuracy."""
    per = cells.groupBy("case_id").agg(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("acc"))
    return per.agg(F.count(F.lit(1)).alias("cases"), F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("std"), F.min("acc").alias("min"), F.max("acc").alias("max"))


def macro_scores(cells: DataFrame) -> DataFrame:
    """Macro F and macro accuracy over the three verdict values, next to the micro accuracy."""
    sides = F.explode(F.array(F.struct(F.col("gold").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("c")),
                              F.struct(F.col("pred").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("c"))))
    x = cells.select("ok", sides.alias("s")).select("ok", "s.*").groupBy("v").agg(
        F.sum("a").alias("actual"), F.sum("c").alias("called"), tally(F.col("ok") & (F.col("a") == 1)).alias("tp"))
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("actual") + F.col("called")).cast("double")), F.lit(0.0))
    r = F.try_divide(F.col("tp").cast("double"), F.col("actual").cast("double"))
    return x.filter("actual > 0").agg((F.sum("tp") / F.sum("actual")).alias("micro_accuracy"), F.avg(f).alias("macro_f"), F.avg(r).alias("macro_accuracy"))


def arbitrate(df: DataFrame, votes: Sequence[str], confidence: str = "confidence", confident: float = 0.8) -> DataFrame:
    """Three-vote rule per cell.

    A confident first vote passes.  Otherwise: fewer than three votes -> first available (or ``0``); three
    equal -> unanimous; two equal -> majority; else the first vote, marked for a tie-break.
    """
    v = [F.col(c) for c in votes]
    given = F.array_compact(F.array(*v))
    n = F.size(given)
    majority: Column = F.lit(None).cast("string")
    top: Column = F.lit(0)
    for value in VERDICTS:
        c = F.size(F.filter("__given", lambda x: x == value))
        top = F.greatest(top, c)
        majority = F.when(c >= 2, F.lit(value)).otherwise(majority)
    df = df.withColumn("__given", given).withColumn("__n", n)
    df = df.withColumn("__top", top).withColumn("__maj", majority)
    sure = v[0].isNotNull() & (F.col(confidence) >= confident)
    first = F.coalesce(F.try_element_at("__given", F.lit(1)), F.lit("0"))
    return (df.withColumn("verdict", F.when(sure, v[0]).when(F.col("__n") < 3, first).when(F.col("__top") >= 2, F.col("__maj")).otherwise(v[0]))
            .withColumn("source", F.when(sure, "single_high_confidence").when(F.col("__n") < 3, "incomplete_escalation_votes")
                        .when(F.col("__top") == 3, "unanimous").when(F.col("__top") == 2, "majority").otherwise("split_pending_tiebreak"))
            .withColumn("final_confidence", F.when(sure, F.col(confidence)).when(F.col("__n") < 3, 0.3).when(F.col("__top") == 3, 1.0)
                        .when(F.col("__top") == 2, 0.7).otherwise(0.4))
            .drop("__given", "__n", "__top", "__maj"))
