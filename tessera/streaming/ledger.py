"""The append-only call log followed as a stream.

The stream's own progress record plays the part of the per-case checkpoint files: a restart goes on after
the last finished batch, and a batch that was cut off is done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.ledger import call_status


def follow_log(spark: SparkSession, log_path: str, out_path: str, progress_path: str, max_tokens: int, files_per_batch: int = 100) -> DataFrame:
    """Process every log file that arrived since the last run and append its calls with their status."""
    schema = spark.read.parquet(log_path).schema
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    query = (call_status(log, max_tokens).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", progress_path)
             .trigger(availableNow=True).outputMode("append").start())
    query.awaitTermination()
    return spark.read.parquet(out_path)
