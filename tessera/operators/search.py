"""Search records: last write per key, finalists, ablations, spec grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

n_rows = lambda name="n": F.count(F.lit(1)).alias(name)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: an aggregate with a map-side combine, so a key repeated everywhere stays cheap."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def family_counts(record: DataFrame) -> DataFrame:
    return record.groupBy("model").agg(n_rows("points"), F.max("group_acc").alias("best_group_acc"))


def members(record: DataFrame, min_score: float, require_test: bool = False, has_test: str = "has_test") -> DataFrame:
    out = record.filter(F.col("group_acc") >= min_score)
    return out.filter(F.col(has_test)) if require_test else out


def best_row(record: DataFrame, score: str = "group_acc", tie: str = "hash") -> DataFrame:
    return record.orderBy(F.desc(score), tie).limit(1)


def finalists(record: DataFrame, per_family: int, top: int, score: str = "group_acc", tie: str = "hash") -> DataFrame:
    """Best rows of each family, then the best overall."""
    w = Window.partitionBy("model").orderBy(F.desc(score), tie)
    kept = record.withColumn("family_rank", F.row_number().over(w)).filter(F.col("family_rank") <= per_family)
    return kept.orderBy(F.desc(score), tie).limit(top)


def ablation(record: DataFrame, block: str = "target_feats", score: str = "group_acc") -> DataFrame:
    """Best score with and without a feature block per feature set, and total fit hours."""
    return record.groupBy("features").agg(
        F.max(F.when(F.col(block), F.col(score))).alias("best_with"), F.max(F.when(~F.col(block), F.col(score))).alias("best_without"),
        (F.sum("fit_seconds") / 3600).alias("fit_hours"))


def spec_grid(base: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """Every combination of the axis values for every base row, made by generators."""
    for name, values in axes.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base


def spec_text(columns: Sequence[str]) -> Column:
    """Canonical JSON text with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def spec_key(columns: Sequence[str], length: int = 16) -> Column:
    return F.substring(F.sha1(spec_text(columns)), 1, length)


def spec_list(base: DataFrame, axes: dict[str, Sequence], length: int = 16) -> DataFrame:
    """Base columns, params, spec_key: every point of the axes for every base row.

    ``params`` is JSON with sorted keys, so lists with different axes have one schema; the key covers it and the base columns.
    """
    params = F.struct(*sorted(axes))
    whole = F.struct(*[params.alias(c) if c == "params" else F.col(c) for c in sorted([*base.columns, "params"])])
    key = F.substring(F.sha1(F.to_json(whole)), 1, length)
    return spec_grid(base, axes).select(*base.columns, F.to_json(params).alias("params"), key.alias("spec_key"))


def stage_specs(features: DataFrame, stages: dict[str, dict[str, Sequence]]) -> DataFrame:
    """Specs of several stages, one per family, over the same feature sets."""
    lists = [spec_list(features.select(F.lit(model).alias("model"), *features.columns), axes) for model, axes in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), lists)


def switched(points: DataFrame, switches: dict[str, Sequence]) -> DataFrame:
    """Each point under every setting of the switches, which replace its own: ablation lists and seed bags."""
    return spec_grid(points.drop(*switches), switches)


def open_specs(specs: DataFrame, record: DataFrame, key: str = "spec_key") -> DataFrame:
    """Specs without a result in the record yet."""
    return specs.join(record.select(key).distinct(), key, "left_anti")


def appended(record: DataFrame, results: DataFrame, key: str = "hash", order: str = "seq") -> DataFrame:
    """The record with new results written after its last row; a repeated key keeps its last write, columns of one side are null on the other."""
    top = record.agg(F.coalesce(F.max(order), F.lit(0)).alias("m")).scalar()
    return last_per_key(record.unionByName(results.withColumn(order, top + 1), allowMissingColumns=True), key, order)
