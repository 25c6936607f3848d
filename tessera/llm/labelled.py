"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most labelled documents that a classifier is fitted on; beyond it a hash of the id picks them.
FIT_DOCS = 20_000


def fold(doc_id: Column) -> Column:
    """The remainder of the id's checksum; rows with 1 are held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 1


def fit_labels(labels: DataFrame, column: str, most: int = FIT_DOCS) -> DataFrame:
    """(doc_id, label) of at most about ``most`` learnable rows; ids whose rows disagree or are null are left out."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id is not null")
    agreed = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top"), F.count("y").alias("n"), F.count(F.lit(1)).alias("rows"))
    agreed = agreed.filter("y = top and n = rows and y in (0, 1)").select("doc_id", "y")
    n = agreed.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1)))
    return agreed.filter(share)
