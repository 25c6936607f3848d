"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import tune

#: Rows in one Arrow batch; texts are long, so batches are short.
BATCH_ROWS = 400
#: The six white-space characters that part words, as a Java character class.
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def text_session(spark: SparkSession) -> SparkSession:
    """Session settings for operators that send whole texts to Python workers."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to their kinds; a missing one is null. Extra columns cannot clash afterwards."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def row_key(doc_id: str = "doc_id", text: str = "text", *more: str) -> list[Column]:
    """Two longs that tell rows apart by content; only rows that repeat each other whole share them."""
    null = [F.col(c).isNull() for c in (doc_id, text, *more)]
    return [F.xxhash64(F.col(doc_id), *map(F.col, more), *null).alias("k1"), F.xxhash64(F.col(text), F.col(doc_id)).alias("k2")]


def normal_line(line: Column) -> Column:
    """A line in lower case with single spaces and no outer ones."""
    return F.trim(F.regexp_replace(F.lower(line), f"{SPACE}+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def line_entries(text: str = "text") -> Column:
    """Array of (h, w), one per line that holds a word: hash of the line, its words."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), normal_line), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))
    return hashed


def context(entries: str) -> Column:
    """Hash of all lines of a text, the context of each of them.

    It tells boilerplate from copies: a copied document repeats its lines in the same text, a footer stands in another
    text on every site.  Direct neighbours would not do: the inner lines of a footer have the same ones everywhere.
    """
    return F.xxhash64(entries)


def drop_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose hash is listed; other lines stay as they are."""
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(hashes, line_hash(x)), F.lit(False)))
    return F.when(F.size(hashes) > 0, F.array_join(rest, "\n")).otherwise(text)


def tokenizer_path(name: str) -> str:
    """A vocabulary file that every worker has installed."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)
