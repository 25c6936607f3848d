"""Feature cache and label-file checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.operators.flows import feature_frame
from tessera.session import scratch_path


def feature_cache(flows: DataFrame, keep: Sequence[str], path: str | None = None) -> DataFrame:
    """Write the wide feature frame once as Parquet and return its meta row, computed from the file."""
    spark = flows.sparkSession
    path = path or scratch_path(spark, "features")
    feature_frame(flows, keep).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    return stored.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.lit(len(stored.columns) - len(keep)).cast("bigint").alias("n_features"),
                      F.countDistinct("gkey").alias("n_groups"))
