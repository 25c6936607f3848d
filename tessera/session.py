"""Session settings, shared scratch folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; all of them are session-level and idempotent."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session, where driver and
    executors are one process, may fall back to a temporary folder.
    """
    ctx = spark.sparkContext
    current = ctx.getCheckpointDir()
    if current:
        return current
    named = ctx.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not ctx.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ctx.setCheckpointDir(named)
    return ctx.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one run under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage in reliable storage, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def recut(df: DataFrame) -> DataFrame:
    """``cut`` for rounds of joins: the planner's size estimate goes too.

    The estimate of a join is the product of its sides', and a checkpoint keeps it, so its digits would double with
    every round until planning alone takes minutes and all of the driver's memory.
    """
    spark, kept = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)
