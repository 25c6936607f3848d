"""Images with few boxes are paired in one exchange, the others over cells, bands and rounds; both give the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes as B, ordered, raster
from tests.test_skew import random_boxes, sequential_match


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(7)
    gt = random_boxes(rng, 200, 12)
    gt.insert(1, "box_id", np.arange(len(gt)))
    pred = pd.concat([gt[["image_id", *B.GEO]] + [0, 1, 2, 1, 2], random_boxes(rng, 150, 14)], ignore_index=True)
    pred["cand_id"], pred["score"] = np.arange(len(pred)), np.round(rng.random(len(pred)), 2)
    return pred, gt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("of", [
    lambda p, g: B.iou_join(p, g), lambda p, g: B.best_truth(p, g), lambda p, g: B.best_candidate(g, p), lambda p, g: B.flag_matches(p, g),
    lambda p, g: B.hard_negatives(B.best_truth(p, g), 2), lambda p, g: B.hard_negatives(B.best_truth(p, g), 2, sizes=p)])
def test_small_and_large_images_agree(spark, sides, monkeypatch, of):
    p, g = (spark.createDataFrame(d) for d in sides)
    small = rows(of(p, g))
    monkeypatch.setattr(B, "IMAGE_ROWS", 20)
    mixed = rows(of(p, g))
    monkeypatch.setattr(B, "IMAGE_ROWS", 0)
    assert small and small == mixed == rows(of(p, g))


def test_rounds_equal_sequential(spark, sides, monkeypatch):
    pred, gt = sides
    monkeypatch.setattr(B, "IMAGE_ROWS", 20)
    got = {(r.image_id, r.cand_id, r.box_id) for r in B.greedy_match(spark.createDataFrame(pred), spark.createDataFrame(gt)).collect()}
    assert got == sequential_match(pred, gt)


def test_equal_overlap_takes_the_lowest_free_box(spark):
    gt = spark.createDataFrame([(1, b, x, 0.0, x + 10, 10.0) for b, x in ((1, 0.0), (2, 4.0), (3, 0.0))], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame([(1, c, 2.0, 0.0, 12.0, 10.0, 0.9 - c / 10) for c in range(4)], "image_id long, cand_id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert {r.cand_id: r.box_id for r in B.greedy_match(pred, gt).collect()} == {0: 1, 1: 2, 2: 3}


@pytest.mark.parametrize("of", [lambda t: B.flag_matches(t.pred, t.gt), lambda t: B.best_truth(t.pred, t.gt), lambda t: B.iou_join(t.pred, t.gt)])
def test_one_exchange_by_image_a_side(spark, tables, of):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(of(tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") <= 2 and "cx" not in text


def test_numbers_by_size(spark):
    pdf = pd.DataFrame({"k": [0] * 60 + list(range(1, 21)) * 2, "slot": [i // 7 for i in range(60)] + [0] * 20 + [1] * 20, "id": range(100)})
    want = pdf.groupby("k").cumcount().tolist()
    for limit in (10, 1000):
        got = ordered.ordinal_by_size(spark.createDataFrame(pdf), ["k"], ["slot"], ["slot", "id"], "rn", rows=limit).toPandas().sort_values("id")
        assert got["rn"].tolist() == want


def test_fused_images_equal_blocks(spark, sides, monkeypatch):
    p = spark.createDataFrame(sides[0]).withColumn("score", F.col("score") + 0.01)
    small = rows(B.fuse_boxes(p, 3), 6)
    monkeypatch.setattr(B, "FEW_BOXES", 0)
    assert small == rows(B.fuse_boxes(p, 3), 6)
    for limit in (20, 0):
        monkeypatch.setattr(B, "IMAGE_ROWS", limit)
        assert small == rows(B.fuse_boxes(p, 3), 6)


def test_small_images_write_nothing_between_steps(spark, tables):
    text = plan(B.fuse_boxes(tables.pred, 3))
    assert "ExistingRDD" not in text and text.count("Exchange hashpartitioning") == 1


def test_windows_share_the_exchange_by_image(spark, tables):
    images = tables.gt.select("image_id").distinct().withColumns({"w": F.lit(500), "h": F.lit(400)})
    text = plan(B.training_windows(images, tables.gt, 4, 192, seed=3))
    assert text.count("Exchange hashpartitioning") <= 2


# ---- pixels ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def inked(spark):
    px = (spark.range(5).select(F.col("id").alias("image_id")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(19)))))
    px = px.withColumns({"t_ink": ((F.col("x") * 7 + F.col("y") * 3) % 9).cast("double"), "p_ink": ((F.col("x") * 7 + F.col("y") * 3) % 9 + F.when((F.col("x") + F.col("image_id")) % 5 == 0, 40).otherwise(0)).cast("double")})
    boxes = spark.range(60).select((F.col("id") % 6).alias("image_id"), F.col("id").alias("box_id"), (F.col("id") % 17).cast("double").alias("x1"), (F.col("id") * 5 % 19).cast("double").alias("y1"))
    return boxes.withColumns({"x2": F.col("x1") + F.col("box_id") % 4, "y2": F.col("y1") + 1 + F.col("box_id") % 9}), px


@pytest.mark.parametrize("of", [lambda b, r: raster.box_ink(b, r), lambda b, r: raster.polarity_filter(b, r, 3.9), lambda b, r: raster.snap_to_ink(b, r, 20, 20)])
def test_bands_agree(inked, monkeypatch, of):
    small = rows(of(*inked))
    for limit in (9, 0):
        monkeypatch.setattr(raster, "IMAGE_ROWS", limit)
        assert small and rows(of(*inked)) == small


def test_ink_of_boxes(inked):
    boxes, px = (d.toPandas() for d in inked)
    got = {(r.image_id, r.box_id): r.p_mean for r in raster.box_ink(*inked).collect()}
    want = {}
    for b in boxes.itertuples():
        own = px[(px.image_id == b.image_id) & (px.x >= b.x1) & (px.x < b.x2) & (px.y >= b.y1) & (px.y < b.y2)]
        if len(own):
            want[b.image_id, b.box_id] = own.p_ink.mean()
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_pixels_are_not_broadcast(tables):
    for df in (raster.box_ink(tables.raster_boxes, tables.raster), raster.snap_to_ink(tables.raster_boxes, tables.raster, 12, 12)):
        text = plan(df)
        assert "ShuffledHashJoin" in text and "BroadcastExchange" not in text
