"""Flow, box and label files: typed reads, checks and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.operators.flows import label_text
from tessera.operators.ordered import ordinal
from tessera.session import scratch_path
from tessera.vocabulary import FLOW_COLUMNS, LABELS

FLOW_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in FLOW_COLUMNS] + [T.StructField("label", T.StringType())])
BOX_SCHEMA = T.StructType([T.StructField("template_image", T.StringType()), T.StructField("photo_image", T.StringType())]
                          + [T.StructField(c, T.IntegerType()) for c in ("left_x", "top_y", "right_x", "bottom_y")])


# ---- flow files ------------------------------------------------------------------------------

def write_flow_csv(df: DataFrame, path: str) -> None:
    df.select(*FLOW_COLUMNS, "label").write.mode("overwrite").option("header", True).csv(path)


def read_flow_csv(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """Typed read; a header that misses an expected column fails before any row is scanned."""
    want = FLOW_COLUMNS + (["label"] if labelled else [])
    head = spark.read.option("header", True).csv(path).columns
    missing = [c for c in want if c not in head]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    types = dict((f.name, f) for f in FLOW_SCHEMA.fields)
    schema = T.StructType([types.get(c, T.StructField(c, T.StringType())) for c in head])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).select(*want)


def flow_violations(df: DataFrame) -> DataFrame:
    """One pass: unknown labels, first packets not at time zero, null cells."""
    t = lambda c: F.sum(F.when(c, 1).otherwise(0))
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in FLOW_COLUMNS), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), t(~F.col("label").isin(*LABELS)).alias("unknown_labels"),
                  t(F.abs(F.col("relative_time_0")) > 1e-8).alias("t0_not_zero"), F.sum(nulls).alias("null_cells"))


# ---- label file ------------------------------------------------------------------------------

def label_file(rows: DataFrame, row: str, path: str | None = None) -> DataFrame:
    """Headerless ``index,label`` file numbered 1..N in row order, read back."""
    spark = rows.sparkSession
    path = path or scratch_path(spark, "labels")
    numbered = ordinal(rows, [], [row], "__o")
    (numbered.select((F.col("__o") + 1).alias("idx"), label_text(F.col("pred")).alias("label"))
     .repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").csv(path))
    return spark.read.schema("idx BIGINT, label STRING").csv(path)


def label_file_checks(df: DataFrame) -> DataFrame:
    """Row count, gaps or repeats in the index, labels outside the vocabulary."""
    # 1..n is the only set of n whole numbers with these extremes, sum and sum of squares that has no repeat or gap
    i = F.col("idx").cast("decimal(38,0)")
    n = F.col("n_rows").cast("decimal(38,0)")
    odd = (F.col("s1") * 2 != n * (n + 1)) | (F.col("s2") * 6 != n * (n + 1) * (2 * n + 1))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.sum(i).alias("s1"), F.sum(i * i).alias("s2"),
                  F.sum(F.when(F.col("label").isin(*LABELS), 0).otherwise(1)).alias("outside_vocabulary"),
                  F.countDistinct("label").alias("distinct_labels")).select(
        "n_rows", (F.abs(F.col("lo") - 1) + F.abs(F.col("hi") - F.col("n_rows")) + odd.cast("bigint")).alias("index_gaps"),
        "outside_vocabulary", "distinct_labels")


# ---- box files -------------------------------------------------------------------------------

def image_names(df: DataFrame) -> DataFrame:
    n = F.lpad(F.col("image_id").cast("string"), 3, "0")
    n = F.when(F.col("image_id") >= 1000, F.col("image_id").cast("string")).otherwise(n)
    return df.withColumn("template_image", F.concat(F.lit("template/pair_template_"), n, F.lit(".png")))


def photo_name(template: Column) -> Column:
    return F.replace(F.replace(template, F.lit("template/"), F.lit("photo/")), F.lit("_template_"), F.lit("_photo_"))


def write_box_csv(boxes: DataFrame, path: str) -> None:
    """Corners rounded half to even; rows ordered by image across the output files."""
    out = image_names(boxes).select(
        "template_image", photo_name(F.col("template_image")).alias("photo_image"),
        *[F.rint(c).cast("int").alias(n) for c, n in (("x1", "left_x"), ("y1", "top_y"), ("x2", "right_x"), ("y2", "bottom_y"))])
    out.repartitionByRange("template_image", "left_x", "top_y").sortWithinPartitions("template_image", "left_x", "top_y").write.mode("overwrite").option("header", True).csv(path)


def read_box_csv(spark: SparkSession, path: str) -> DataFrame:
    """Boxes with the integer image id from the file name."""
    raw = spark.read.schema(BOX_SCHEMA).option("header", True).csv(path)
    return raw.withColumn("image_id", F.regexp_extract("template_image", r"_(\d+)\.", 1).cast("bigint"))


def box_submission(candidates: DataFrame, threshold: float, path: str | None = None) -> DataFrame:
    """Keep scores at or above the threshold, write the box file, read it back."""
    spark = candidates.sparkSession
    path = path or scratch_path(spark, "boxes")
    write_box_csv(candidates.filter(F.col("score") >= threshold), path)
    return read_box_csv(spark, path)


def pooled_candidates(folds: list[DataFrame]) -> DataFrame:
    """All folds as one pool; an image predicted by two folds is an error."""
    pool = folds[0]
    for f in folds[1:]:
        pool = pool.unionByName(f)
    # a join-free guard: the flag travels with the rows of the image
    multi = pool.groupBy("image_id").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).filter("lo <> hi")
    clash = multi.limit(1).count()
    if clash:
        raise ValueError("two folds predict the same image")
    return pool
