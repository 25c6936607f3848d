"""A key with a third of all rows, exact results, and plans that split it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes as B, ordered, raster


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(0)
    n = 3000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 200, n))
    pdf = pd.DataFrame({"key": key, "slot": 0, "v": np.round(rng.gamma(1.0, 50.0, n), 1), "id": np.arange(n)})
    pdf["slot"] = (pdf["v"] // 10).astype(int)
    return pdf


def test_ordinal(spark, hot):
    got = ordered.ordinal_in_slots(spark.createDataFrame(hot), ["key"], ["slot"], ["v", "id"], "rn").toPandas().sort_values("id")
    want = hot.sort_values(["v", "id"]).groupby("key").cumcount().sort_index()
    assert (got["rn"].to_numpy() == want.to_numpy()).all()


def test_percentiles_and_ranks(spark, hot):
    df = spark.createDataFrame(hot)
    p = ordered.exact_percentiles(df, ["key"], "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}).toPandas().set_index("key").sort_index()
    want = hot.groupby("key")["v"].quantile([0.1, 0.5, 0.99]).unstack()
    assert np.allclose(p.to_numpy(), want.to_numpy())
    whole = ordered.exact_percentiles(df, [], "v", {"q": 0.37}).first()["q"]
    assert np.isclose(whole, hot["v"].quantile(0.37))
    r = df.join(ordered.average_ranks(df, ["key"], "v"), ["key", "v"]).toPandas().sort_values("id")
    assert np.allclose(r["avg_rank"], hot.groupby("key")["v"].rank())


def test_running_totals_do_not_depend_on_partitions(spark, hot):
    df = spark.createDataFrame(hot).groupBy("key", "v").agg(F.count("*").alias("n"))
    a = ordered.running_totals(df.repartition(3), ["key"], "v", ["n"]).toPandas().sort_values(["key", "v"])
    b = ordered.running_totals(df.repartition(11), ["key"], "v", ["n"], rows=50).toPandas().sort_values(["key", "v"])
    assert (a["n_below"].to_numpy() == b["n_below"].to_numpy()).all()


def test_slices_grow_with_a_hot_key(spark, hot):
    df = spark.createDataFrame(hot).withColumn("key", F.when(F.rand(3) < 2, 0))
    sizes = [r["count"] for r in ordered.sliced(df, ["key", "v", "id"], rows=100).groupBy("key", "__slice").count().collect()]
    assert sum(sizes) == len(hot) and max(sizes) <= 300 and len(sizes) >= 20
    got = ordered.ordinal(df, ["key"], ["v", "id"], "rn", rows=100).toPandas().sort_values("id")
    want = hot.sort_values(["v", "id"]).reset_index().reset_index().set_index("id")["level_0"].sort_index()
    assert (got["rn"].to_numpy() == want.to_numpy()).all()


def test_busy_users_keep_their_flows_apart(spark):
    from tessera.plans.views import Tables
    t = Tables(spark, "")
    busy = spark.range(30_000).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("event_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
                                      F.timestamp_micros(F.col("id") * 1000).alias("ts")).unionByName(
        spark.range(5).select(F.lit(2).cast("bigint").alias("user_id"), F.col("id").alias("event_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.timestamp_micros(F.col("id")).alias("ts")))
    t.table = lambda name: busy
    ids = t.flow_arrays.select("flow_id")
    assert ids.count() == 6001 == ids.distinct().count()


def test_auc(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"s": np.round(rng.random(400), 2), "y": rng.integers(0, 2, 400)})
    got = ordered.rank_auc(spark.createDataFrame(pdf), [], "s", F.col("y") == 1).first()["auc"]
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert np.isclose(got, want)


# ---- boxes -----------------------------------------------------------------------------------

def random_boxes(rng, n, images, hot_share=0.34):
    img = np.where(rng.random(n) < hot_share, 0, rng.integers(1, images, n))
    x, y = rng.integers(0, 120, n).astype(float), rng.integers(0, 120, n).astype(float)
    return pd.DataFrame({"image_id": img, "x1": x, "y1": y, "x2": x + rng.integers(8, 40, n), "y2": y + rng.integers(8, 40, n)})


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


@pytest.fixture(scope="module")
def box_sets():
    rng = np.random.default_rng(3)
    gt = random_boxes(rng, 300, 12)
    gt.insert(1, "box_id", np.arange(len(gt)))
    shift = gt[["x1", "y1", "x2", "y2"]] + rng.integers(-4, 5, (len(gt), 4))
    pred = pd.concat([shift.assign(image_id=gt["image_id"]), random_boxes(rng, 200, 12)], ignore_index=True)
    pred["cand_id"], pred["score"] = np.arange(len(pred)), np.round(rng.random(len(pred)), 2)
    return pred[["image_id", "cand_id", "x1", "y1", "x2", "y2", "score"]], gt


def sequential_match(pred, gt, thr=0.5):
    hits = set()
    for img, p in pred.groupby("image_id"):
        g = gt[gt.image_id == img].sort_values("box_id")
        free = dict(zip(g.box_id, g[B.GEO].to_numpy()))
        for r in p.sort_values(["score", "cand_id"], ascending=[False, True]).itertuples():
            best, who = 0.0, None
            for bid, geo in free.items():
                v = iou((r.x1, r.y1, r.x2, r.y2), geo)
                if v > best:
                    best, who = v, bid
            if best >= thr:
                del free[who]
                hits.add((img, r.cand_id, who))
    return hits


def test_iou_join(spark, box_sets):
    pred, gt = box_sets
    for cell in (16.0, 64.0):
        got = {(r.image_id, r.cand_id, r.box_id): r.iou for r in B.iou_join(spark.createDataFrame(pred), spark.createDataFrame(gt), cell).collect()}
        want = {}
        for p in pred.itertuples():
            for g in gt[gt.image_id == p.image_id].itertuples():
                v = iou((p.x1, p.y1, p.x2, p.y2), (g.x1, g.y1, g.x2, g.y2))
                if v > 0:
                    want[(p.image_id, p.cand_id, g.box_id)] = v
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_greedy_match_equals_sequential(spark, box_sets):
    pred, gt = box_sets
    got = {(r.image_id, r.cand_id, r.box_id) for r in B.greedy_match(spark.createDataFrame(pred), spark.createDataFrame(gt)).collect()}
    assert got == sequential_match(pred, gt)


def test_copies_share_one_class(spark):
    gt = pd.DataFrame({"image_id": 0, "box_id": range(40), "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0})
    pred = pd.DataFrame({"image_id": 0, "cand_id": range(60), "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0, "score": [i / 100 for i in range(60)]})
    flagged = B.flag_matches(spark.createDataFrame(pred), spark.createDataFrame(gt))
    row = B.global_f1(flagged, spark.createDataFrame(gt)).first()
    assert (row.tp, row.fp, row.fn) == (40, 20, 0)
    assert flagged.filter("tp").agg(F.min("score")).first()[0] == 0.2


def test_sweep_prefix_property(spark, box_sets):
    pred, gt = box_sets
    p, g = spark.createDataFrame(pred), spark.createDataFrame(gt)
    swept = {round(r.threshold, 2): r.tp for r in B.sweep(B.flag_matches(p, g), g.agg(F.count("*").alias("n"))).collect()}
    for thr in (0.3, 0.62, 0.9):
        kept = pred[pred.score >= [x for x in B.threshold_grid() if round(x, 2) == thr][0]]
        assert swept[thr] == len(sequential_match(kept, gt))


def naive_fusion(p, thr, n):
    order = p.sort_values(["score", "cand_id"], ascending=[False, True])
    boxes, scores = order[B.GEO].to_numpy(), order["score"].to_numpy()
    fused, members = [], []
    for i in range(len(boxes)):
        v = [iou(boxes[i], f) for f in fused]
        j = int(np.argmax(v)) if v else -1
        if j >= 0 and v[j] >= thr:
            members[j].append(i)
            fused[j] = (boxes[members[j]] * scores[members[j]][:, None]).sum(0) / scores[members[j]].sum()
        else:
            members.append([i])
            fused.append(boxes[i].copy())
    return sorted((round(float(f[0]), 6), round(float(f[3]), 6), round(float(scores[m].mean() * min(len(m), n) / n), 6), len(m)) for f, m in zip(fused, members))


def test_fusion_in_blocks_equals_whole_image(spark, box_sets):
    pred, _ = box_sets
    pred = pred.assign(score=pred["score"] + 0.01)
    got = B.fuse_boxes(spark.createDataFrame(pred), 3).toPandas()
    for img, p in pred.groupby("image_id"):
        mine = sorted((round(r.x1, 6), round(r.y2, 6), round(r.score, 6), r.members) for r in got[got.image_id == img].itertuples())
        assert np.allclose(mine, naive_fusion(p, 0.55, 3), atol=2e-6)


def test_fusion_score_uses_final_size(spark):
    rows = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.8), (0, 1, 0.0, 0.0, 10.0, 10.0, 0.6), (0, 2, 100.0, 100.0, 110.0, 110.0, 0.9)]
    df = spark.createDataFrame(rows, "image_id long, cand_id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = sorted((round(r.score, 6), r.members) for r in B.fuse_boxes(df, 3).collect())
    assert got == [(0.3, 1), (round(0.7 * 2 / 3, 6), 2)]


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102)]
    nodes = spark.createDataFrame([(i,) for i in list(range(62)) + [100, 101, 102, 200]], "node long")
    got = {r.node: r.label for r in raster.connected(nodes, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[61] == 61 and got[102] == 100 and got[200] == 200


def test_view_round_trip(spark, box_sets):
    pred, _ = box_sets
    df = spark.createDataFrame(pred).withColumns({"hflip": F.col("cand_id") % 2, "vflip": F.floor(F.col("cand_id") / 2) % 2, "transpose": F.floor(F.col("cand_id") / 4) % 2})
    back = B.view_boxes(B.view_boxes(df, F.lit(512.0)), F.lit(512.0), inverse=True)
    assert back.select("cand_id", *B.GEO).exceptAll(df.select("cand_id", *B.GEO)).count() == 0
